"""Class signals and member propagation against a step-by-step loop over random relations."""
import random

from pyspark.sql import functions as F

from tracewell.operators.graph import apply_class_signals, propagate_members
from tracewell.schemas import FINANCIAL_TOKENS, STRATEGIC_TOKENS

KINDS = ("member_of", "joins_group", "finances", "affiliate_of", "advises", "exits_group")
ROLES = (None, "strategic buyer", "financial sponsor", "operating partner with capital", "counsel")


def random_deals(count, seed, nested):
    rng = random.Random(seed)
    actors, relations = [], []
    for d in range(count):
        names = [f"n{i}" for i in range(6)]
        labels = [rng.choice(["Plain", "Apex Capital", "Corporate Holdings", "Mixed Strategic Capital"]) for _ in names]
        for n in names:
            stated = rng.choice(["unknown"] * 4 + ["strategic", "financial", "mixed"])
            actors.append((f"d{d}", "r", n, stated, stated != "unknown"))
        for t in range(rng.randint(1, 12)):
            s = rng.randrange(6 if nested else 4)
            o = rng.randrange(6) if nested else rng.randint(4, 5)
            relations.append((f"d{d}", "r", t, names[s], names[o], labels[s], rng.choice(KINDS), rng.choice(ROLES)))
    return actors, relations


def step_by_step(actors, relations):
    state = {(d, n): {"cls": c, "locked": lock, "s": False, "f": False} for d, _, n, c, lock in actors}
    ordered = sorted(relations, key=lambda r: (r[0], r[2]))

    def settle(actor, value, when):
        if not actor["locked"] and actor["cls"] in when:
            actor["cls"] = value

    for d, _, _, s, o, label, kind, role in ordered:
        if kind not in ("member_of", "joins_group", "finances", "affiliate_of"):
            continue
        text, sub, obj = f"{label} {role or ''}".lower(), state[(d, s)], state[(d, o)]
        if any(t in text for t in STRATEGIC_TOKENS):
            settle(sub, "strategic", ("unknown",))
            obj["s"] = True
            settle(obj, "strategic", ("unknown", "financial"))
        if any(t in text for t in FINANCIAL_TOKENS):
            settle(sub, "financial", ("unknown",))
            obj["f"] = True
            if obj["locked"]:
                continue
            if obj["cls"] == "unknown":
                obj["cls"] = "financial"
            elif obj["cls"] != "financial" and not obj["s"]:
                obj["cls"] = "mixed"
        if obj["s"] and obj["f"]:
            settle(obj, "strategic", ("unknown", "financial", "mixed", "strategic"))
    after_signals = {k: (v["cls"], v["s"], v["f"]) for k, v in state.items()}
    for d, _, _, s, o, _, kind, _ in ordered:
        if kind not in ("member_of", "joins_group"):
            continue
        sub, obj = state[(d, s)], state[(d, o)]
        obj["s"] |= sub["cls"] == "strategic"
        obj["f"] |= sub["cls"] == "financial"
        if obj["s"]:
            settle(obj, "strategic", ("unknown", "financial", "mixed", "strategic"))
        elif obj["f"]:
            settle(obj, "financial", ("unknown",))
    return after_signals, {k: (v["cls"], v["s"], v["f"]) for k, v in state.items()}


def frames(spark, actors, relations):
    a = spark.createDataFrame(actors, "deal_slug string, run_id string, actor_id string, stated_class string, locked boolean")
    r = spark.createDataFrame(relations, "deal_slug string, run_id string, claim_sequence long, subject_actor_id string, object_actor_id string, "
                                         "subject_actor_label string, relation_type string, role_detail string")
    return a, r


def result(df):
    return {(r.deal_slug, r.actor_id): (r.bidder_class, r.has_strategic_member, r.has_financial_member) for r in df.collect()}


def test_signals_and_plain_members(spark):
    actors, relations = random_deals(250, 11, nested=False)
    a, r = frames(spark, actors, relations)
    signals, final = step_by_step(actors, relations)
    marked = apply_class_signals(a, r)
    assert result(marked) == signals
    assert result(propagate_members(marked, r)) == final


def test_nested_groups_reach_the_same_end(spark):
    actors, relations = random_deals(150, 12, nested=True)
    a, r = frames(spark, actors, relations)
    signals, final = step_by_step(actors, relations)
    marked = apply_class_signals(a, r)
    assert result(marked) == signals
    assert result(propagate_members(marked, r)) == final


def test_no_relations(spark):
    a, r = frames(spark, [("d", "r", "n0", "unknown", False)], [("x", "r", 1, "a", "b", "l", "advises", None)])
    rows = propagate_members(apply_class_signals(a, r), r).filter(F.col("deal_slug") == "d").collect()
    assert [(x.bidder_class, x.has_strategic_member) for x in rows] == [("unknown", False)]
