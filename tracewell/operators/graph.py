"""Canonical actors, relations, events and counts from bound claims."""
from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.hashing import cycle_id, stable_id, text_hash
from tracewell.functions.keyset import KeySet
from tracewell.functions.text import actor_key, bidder_class, contains_any, looks_group
from tracewell.operators.binding import FAILED
from tracewell.operators.claims import normalized_value, primary_quote
from tracewell.schemas import (
    FINANCIAL_TOKENS, GROUP_RELATIONS, MEMBER_RELATIONS, SIGNAL_RELATIONS, STRATEGIC_TOKENS,
)
from tracewell.session import Staging, stored

RUN = ["deal_slug", "run_id"]


def deal_id() -> Column:
    return stable_id("deal", F.col("deal_slug"))


def _filled(name: str) -> Column:
    """A label that is neither null nor empty."""
    return F.col(name).isNotNull() & (F.col(name) != "")


def _or(name: str, default: str) -> Column:
    return F.when(_filled(name), F.col(name)).otherwise(default)


# ---- claims --------------------------------------------------------------------------
def judge_claims(claims: DataFrame, rejected: DataFrame) -> DataFrame:
    """G1: claims with their disposition. A claim fails only if nothing of it bound; `rejected` holds those with their first_error.

    Not a stage: a reader joins the few columns and kinds of claims it needs, and only claims that may be among the rejected ones.
    """
    key = RUN + ["claim_id"]
    marked = KeySet(rejected, key).marked(claims, "_may")
    rows = marked.filter("_may").join(rejected, key, "left").unionByName(marked.filter("NOT _may"), allowMissingColumns=True)
    failed = F.col("first_error").isNotNull()
    return rows.select(
        *claims.columns,
        F.when(failed, "rejected_unsupported").otherwise("supported").alias("disposition"),
        F.when(failed, FAILED).otherwise("evidence_refs_bound").alias("reason_code"),
        F.when(failed, F.col("first_error")).otherwise("All evidence refs bound to citation units.").alias("reason"))


def claims_table(claims: DataFrame) -> DataFrame:
    """The claims table."""
    quote = primary_quote(F.col("evidence_refs"))
    return claims.select(
        "claim_id", *RUN, "filing_id", F.lit(None).cast("string").alias("region_id"),
        F.lit("extractor_claims").alias("provider_source_stage"), "claim_type",
        F.coalesce("confidence", F.lit("unknown")).alias("confidence"), "raw_value",
        normalized_value(claims.columns).alias("normalized_value"), quote.alias("quote_text"), text_hash(quote).alias("quote_text_hash"),
        F.lit("current").alias("status"), "claim_sequence", "coverage_obligation_id", "evidence_refs")


def dispositions_table(judged: DataFrame) -> DataFrame:
    return judged.select(
        stable_id("disposition", F.col("run_id"), F.col("claim_id")).alias("disposition_id"), "claim_id", *RUN,
        "disposition", F.lit(True).alias("current"), "reason_code", "reason")


def coverage_links(judged: DataFrame) -> DataFrame:
    linked = judged.filter(_filled("coverage_obligation_id") & (F.col("disposition") == "supported"))
    return linked.select(
        "claim_id", F.col("coverage_obligation_id").alias("obligation_id"), *RUN, "claim_type", F.lit(True).alias("current"))


def coverage_results(links: DataFrame) -> DataFrame:
    """A2: one row per obligation of a run."""
    counted = links.groupBy(*RUN, "obligation_id").agg(F.count(F.lit(1)).cast("int").alias("claim_count"))
    return counted.select(
        stable_id("coverage", F.col("run_id"), F.col("obligation_id")).alias("coverage_result_id"), *RUN, "obligation_id",
        F.lit("claims_emitted").alias("result"), F.lit("claim_present").alias("reason_code"),
        F.lit("At least one current claim is linked to this obligation.").alias("reason"), "claim_count",
        F.lit(True).alias("current"))


# ---- actors --------------------------------------------------------------------------
def actor_mentions(judged: DataFrame) -> DataFrame:
    """Every mention of an actor by a supported claim, in mention order (claim, then part)."""
    kind = F.col("claim_type")
    none = F.lit(None).cast("string")

    def mention(part: int, label: str, actor_kind: Column, observability: Column, actor_class: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), F.col(label).alias("label"), actor_kind.alias("kind"),
            observability.alias("observability"), actor_class.alias("actor_class"))

    org, named = F.lit("organization"), F.lit("named")
    group = F.when(F.col("relation_type").isin(*GROUP_RELATIONS), "group").otherwise("organization")
    bid_kind = F.when(looks_group(F.col("bidder_label")), "group").otherwise("organization")
    mentions = (
        F.when(kind == "actor", F.array(mention(
            0, "actor_label", _or("actor_kind", "organization"), _or("observability", "named"), bidder_class(F.col("actor_class")))))
        .when(kind == "actor_relation", F.array(
            mention(0, "subject_label", org, named, none), mention(1, "object_label", group, named, none)))
        .when(kind == "event", F.array(mention(0, "actor_label", org, named, none)))
        .when(kind == "bid", F.array(mention(0, "bidder_label", bid_kind, named, none)))
    )
    rows = judged.filter(F.col("disposition") == "supported").select(
        *RUN, "claim_id", "claim_type", "claim_sequence", F.explode(mentions).alias("m"))
    rows = rows.select(*RUN, "claim_id", "claim_type", "claim_sequence", "m.*").filter(_filled("label"))
    return rows.withColumn("actor_key", actor_key(F.col("label")))


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """One row per actor of a run. First mention gives label and id; ordered minima only."""
    order = F.struct("claim_sequence", "part")

    def first(value: str, condition: Column | None = None) -> Column:
        pair = F.struct(order.alias("o"), F.col(value).alias("v"))
        return F.min(F.when(condition, pair) if condition is not None else pair)["v"]

    classed = F.col("actor_class").isNotNull() & (F.col("actor_class") != "unknown")
    merged = mentions.groupBy(*RUN, "actor_key").agg(
        F.min(order).alias("first_mention"),
        first("label").alias("actor_label"),
        first("kind", F.col("kind") != "organization").alias("_kind"),
        first("observability", F.col("observability") != "named").alias("_obs"),
        first("actor_class", classed).alias("_class"))
    return merged.select(
        *RUN, "actor_key", "first_mention", stable_id("actor", F.col("deal_slug"), F.col("actor_label")).alias("actor_id"), "actor_label",
        F.coalesce("_kind", F.lit("organization")).alias("actor_kind"), F.coalesce("_obs", F.lit("named")).alias("observability"),
        F.coalesce("_class", F.lit("unknown")).alias("stated_class"), F.col("_class").isNotNull().alias("locked"))


def relations_table(judged: DataFrame, actors: DataFrame) -> DataFrame:
    """Relation rows, one per supported claim with both ends (equal rows are kept)."""
    rows = judged.filter((F.col("disposition") == "supported") & (F.col("claim_type") == "actor_relation"))
    rows = rows.filter(_filled("subject_label") & _filled("object_label"))
    rows = rows.withColumn("_s", actor_key(F.col("subject_label"))).withColumn("_o", actor_key(F.col("object_label")))
    end = lambda p: actors.select(
        *RUN, F.col("actor_key").alias(f"_{p[0]}"), F.col("actor_id").alias(f"{p}_actor_id"), F.col("actor_label").alias(f"{p}_actor_label"))
    rows = rows.join(end("subject"), RUN + ["_s"]).join(end("object"), RUN + ["_o"])
    relation_id = stable_id(
        "relation", F.col("deal_slug"), F.col("subject_actor_id"), F.col("object_actor_id"), F.col("relation_type"),
        F.col("effective_date_first"), F.col("role_detail"))
    return rows.select(
        relation_id.alias("relation_id"), *RUN, deal_id().alias("deal_id"), "subject_actor_id", "object_actor_id",
        "subject_actor_label", "object_actor_label", "relation_type", "role_detail",
        cycle_id(F.col("deal_slug")).alias("cycle_id_first_observed"), F.lit(None).cast("string").alias("cycle_id_last_observed"),
        "effective_date_first", "effective_date_last", F.coalesce("confidence", F.lit("unknown")).alias("confidence"),
        "claim_id", "claim_sequence")


# ---- class signals -------------------------------------------------------------------
def class_signals(relations: DataFrame) -> DataFrame:
    """Signals of each relation on its two ends: (actor_id, claim_sequence, phase).

    phase 1 subject strategic, 2 object strategic, 3 subject financial, 4 object financial.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("subject_actor_label", F.lit("")), F.coalesce("role_detail", F.lit(""))))
    rows = relations.filter(F.col("relation_type").isin(*SIGNAL_RELATIONS))
    strategic, financial = contains_any(text, STRATEGIC_TOKENS), contains_any(text, FINANCIAL_TOKENS)
    signal = lambda phase, end, on: F.when(on, F.struct(F.lit(phase).alias("phase"), F.col(end).alias("actor_id")))
    signals = F.array_compact(F.array(
        signal(1, "subject_actor_id", strategic), signal(2, "object_actor_id", strategic),
        signal(3, "subject_actor_id", financial), signal(4, "object_actor_id", financial)))
    return rows.select(*RUN, "claim_sequence", F.explode(signals).alias("s")).select(*RUN, "claim_sequence", "s.phase", "s.actor_id")


def apply_class_signals(actors: DataFrame, relations: DataFrame) -> DataFrame:
    """Actor class and member flags after all relation signals.

    The signal-by-signal rules have a closed form. Only an actor without a stated class is
    open, so it starts unknown; then a strategic member makes it strategic in the end, whatever
    else arrives; a financial member alone makes it financial, or mixed where the actor had
    become strategic by its own role first; without members its first own signal decides.
    So three order-free minima per actor replace an ordered fold.
    """
    order = F.struct("claim_sequence", "phase")
    first_phase = F.min(F.struct(order.alias("o"), "phase"))["phase"]
    signals = class_signals(relations).groupBy(*RUN, "actor_id").agg(
        F.bool_or(F.col("phase") == 2).alias("has_s"), F.bool_or(F.col("phase") == 4).alias("has_f"), first_phase.alias("first_phase"))
    rows = actors.join(signals, RUN + ["actor_id"], "left")
    has_s, has_f = F.coalesce("has_s", F.lit(False)), F.coalesce("has_f", F.lit(False))
    open_class = (
        F.when(has_s, "strategic")
        .when(has_f, F.when(F.col("first_phase") == 1, "mixed").otherwise("financial"))
        .when(F.col("first_phase") == 1, "strategic").when(F.col("first_phase") == 3, "financial").otherwise("unknown"))
    return rows.select(
        *actors.columns, F.when(F.col("locked"), F.col("stated_class")).otherwise(open_class).alias("bidder_class"),
        has_s.alias("has_strategic_member"), has_f.alias("has_financial_member"))


_NEVER = 2**62


def propagate_members(actors: DataFrame, relations: DataFrame) -> DataFrame:
    """Pass member classes on to groups, in claim order.

    A member passes on the class it has when its relation comes up. A plain member's class never
    changes, so one join and two minima settle its group. A member that is itself a group may
    turn later: for those the moment of turning (`s_at`, `f_at`) is relaxed along the nested
    relations until nothing changes; every round is one join over the nested relations only.
    """
    keys = RUN + ["actor_id"]
    edges = relations.filter(F.col("relation_type").isin(*MEMBER_RELATIONS)).select(
        *RUN, F.col("subject_actor_id").alias("member"), F.col("object_actor_id").alias("actor_id"), F.col("claim_sequence").alias("t"))
    never = F.lit(_NEVER).cast("long")
    always = F.lit(-1).cast("long")
    fixed = actors.select(
        *keys, "locked", (F.col("bidder_class") == "unknown").alias("blank"),
        F.when(F.col("bidder_class") == "strategic", always).otherwise(never).alias("s_at"),
        F.when(F.col("bidder_class") == "financial", always).otherwise(never).alias("f_at"))
    groups = edges.select(*keys).distinct().withColumn("is_group", F.lit(True))
    # plain members: class known from the start
    state = fixed.join(groups, keys, "left").withColumn("is_group", F.coalesce("is_group", F.lit(False)))

    def arrivals(members: DataFrame, along: DataFrame) -> DataFrame:
        m = members.select(*RUN, F.col("actor_id").alias("member"), "s_at", "f_at")
        passed = along.join(m, RUN + ["member"])
        strategic = F.when(F.col("s_at") < F.col("t"), F.col("t"))
        financial = F.when((F.col("f_at") < F.col("t")) & (F.col("t") <= F.col("s_at")), F.col("t"))
        return passed.groupBy(*keys).agg(F.min(strategic).alias("s_in"), F.min(financial).alias("f_in"))

    plain_edges = edges.join(groups.select(*RUN, F.col("actor_id").alias("member")), RUN + ["member"], "left_anti")
    nested_edges = edges.join(groups.select(*RUN, F.col("actor_id").alias("member")), RUN + ["member"], "left_semi")
    from_plain = arrivals(state, plain_edges)

    def settle(base: DataFrame, inputs: DataFrame) -> DataFrame:
        rows = base.join(inputs, keys, "left")
        s_at = F.when(F.col("locked"), F.col("s_at")).otherwise(F.least(F.col("s_at"), F.coalesce("s_in", never)))
        open_f = ~F.col("locked") & F.col("blank") & (F.coalesce("f_in", never) < s_at)
        f_at = F.when(open_f, F.least(F.col("f_at"), F.col("f_in"))).otherwise(F.col("f_at"))
        return rows.select(
            *base.columns[:base.columns.index("s_at")], s_at.alias("s_at"), f_at.alias("f_at"),
            *[c for c in base.columns if c not in base.columns[:base.columns.index("s_at")] + ["s_at", "f_at"]],
            F.col("s_in").isNotNull().alias("s_seen"), F.col("f_in").isNotNull().alias("f_seen"))

    inputs = _relax(state, nested_edges, from_plain, arrivals, settle, keys)
    done = settle(state, inputs).select(*keys, "s_at", "f_at", "s_seen", "f_seen")
    rows = actors.join(done, keys)
    turned_s = ~F.col("locked") & (F.col("s_at") < never)
    turned_f = ~F.col("locked") & (F.col("bidder_class") == "unknown") & (F.col("f_at") < never)
    return rows.select(
        *[c for c in actors.columns if c not in ("bidder_class", "has_strategic_member", "has_financial_member")],
        F.when(turned_s, "strategic").when(turned_f, "financial").otherwise(F.col("bidder_class")).alias("bidder_class"),
        (F.col("has_strategic_member") | F.col("s_seen")).alias("has_strategic_member"),
        (F.col("has_financial_member") | F.col("f_seen")).alias("has_financial_member"))


def _relax(state, nested_edges, from_plain, arrivals, settle, keys) -> DataFrame:
    """Earliest arrivals at each group when members may be groups themselves."""
    both = lambda a, b: a.unionByName(b).groupBy(*keys).agg(F.min("s_in").alias("s_in"), F.min("f_in").alias("f_in"))
    nested_edges = stored(nested_edges)
    if nested_edges.isEmpty():
        return from_plain
    state = stored(state)  # every round below starts from it
    # First the strategic moments to their fixed point, then the financial ones, which depend on them.
    inputs = stored(from_plain)
    known = inputs
    for which in ("s_in", "f_in"):
        while True:  # ends: arrivals only move earlier, and there are finitely many
            members = settle(state, known).filter("is_group")
            step = both(inputs, arrivals(members, nested_edges))
            if which == "s_in":  # financial arrivals are not final yet: keep only what plain members give
                step = step.select(*keys, "s_in").join(inputs.select(*keys, "f_in"), keys, "left")
            step = stored(step)
            old = known.select(*keys, F.col(which).alias("_old"))
            changed = not step.join(old, keys, "left").filter(~F.col(which).eqNullSafe(F.col("_old"))).isEmpty()
            known = step
            if not changed:
                break
    # One more pass so that both moments are read off the settled members.
    return both(inputs, arrivals(settle(state, known).filter("is_group"), nested_edges))


def actors_table(actors: DataFrame) -> DataFrame:
    return actors.select(
        "actor_id", *RUN, deal_id().alias("deal_id"), "actor_label", "actor_kind", "observability", "bidder_class",
        F.lit(None).cast("string").alias("lead_arranger_label"), F.lit(None).cast("int").alias("member_count_known"),
        "has_strategic_member", "has_financial_member", F.lit(False).alias("has_sovereign_wealth_member"))


# ---- events, counts ------------------------------------------------------------------
def events_table(judged: DataFrame) -> DataFrame:
    """Events, with bids as events."""
    rows = judged.filter((F.col("disposition") == "supported") & F.col("claim_type").isin("event", "bid"))
    bid = F.col("claim_type") == "bid"
    number = lambda n: F.when(bid, F.col(n))
    event_id = stable_id("event", F.col("deal_slug"), F.col("claim_type"), F.col("claim_sequence"), F.col("raw_value"))
    bid_text = F.when(_filled("description"), F.col("description")).otherwise(
        F.concat(F.lit("Bid submitted by "), F.coalesce("bidder_label", F.lit("None"))))
    return rows.select(
        event_id.alias("event_id"), *RUN, deal_id().alias("deal_id"), cycle_id(F.col("deal_slug")).alias("cycle_id"),
        F.when(bid, "bid").otherwise(_or("event_type", "process")).alias("event_type"),
        F.when(bid, F.when(F.col("bid_stage") == "final", "final_round_bid").otherwise("first_round_bid")).otherwise(F.col("event_subtype")).alias("event_subtype"),
        F.when(bid, F.col("bid_date")).otherwise(F.col("event_date")).alias("event_date"),
        F.when(bid, bid_text).otherwise(F.col("description")).alias("description"),
        *[number(n).alias(n) for n in ("bid_value", "bid_value_lower", "bid_value_upper", "bid_value_unit", "consideration_type")],
        F.when(bid, _or("bid_stage", "unspecified")).alias("bid_stage"),
        "claim_id", "claim_sequence", F.col("claim_type").alias("_from"),
        F.when(bid, F.col("bidder_label")).otherwise(F.col("actor_label")).alias("_label"), "actor_role", "role_detail")


def event_links(events: DataFrame, actors: DataFrame) -> DataFrame:
    """Event -> actor links; an event without an actor has none."""
    bid = F.col("_from") == "bid"
    rows = events.filter(_filled("_label")).withColumn("actor_key", actor_key(F.col("_label")))
    rows = rows.join(actors.select(*RUN, "actor_key", "actor_id", "actor_label"), RUN + ["actor_key"])
    stated = F.when(bid, "bid_submitter").otherwise(F.col("actor_role"))
    default = F.when(F.col("event_type") == "bid", "bid_submitter").otherwise("participant")
    return rows.select(
        stable_id("link", F.col("event_id"), F.col("actor_id"), stated).alias("link_id"), *RUN, "event_id", "actor_id", "actor_label",
        F.when(stated.isNotNull() & (stated != ""), stated).otherwise(default).alias("role"),
        F.when(bid, F.lit(None).cast("string")).otherwise(F.col("role_detail")).alias("role_detail"), "claim_id", "claim_sequence")


def counts_table(judged: DataFrame) -> DataFrame:
    """G10."""
    rows = judged.filter((F.col("disposition") == "supported") & (F.col("claim_type") == "participation_count"))
    return rows.select(
        stable_id("participation_count", F.col("deal_slug"), F.col("claim_sequence"), F.col("raw_value")).alias("participation_count_id"),
        *RUN, deal_id().alias("deal_id"), cycle_id(F.col("deal_slug")).alias("cycle_id"), "process_stage", _or("actor_class", "unknown").alias("actor_class"),
        "count_min", "count_max", "count_qualifier", F.coalesce("confidence", F.lit("unknown")).alias("confidence"), "claim_id", "claim_sequence")


# ---- lineage -------------------------------------------------------------------------
def row_claims(mentions: DataFrame, actors: DataFrame, relations: DataFrame, events: DataFrame, counts: DataFrame) -> DataFrame:
    """(row_table, row_id) -> the claims a row comes from; `seen` (claim, part) orders them as they came in."""
    named = mentions.join(actors.select(*RUN, "actor_key", "actor_id"), RUN + ["actor_key"])
    # A relation with only one end makes an actor but links nothing.
    whole = relations.select(*RUN, "claim_id")
    linked = named.filter(F.col("claim_type") != "actor_relation").unionByName(
        named.filter(F.col("claim_type") == "actor_relation").join(whole, RUN + ["claim_id"], "left_semi"))
    pick = lambda df, table, row_id, part: df.select(*RUN, "claim_id", "claim_sequence", F.lit(table).alias("row_table"), F.col(row_id).alias("row_id"), part.alias("part"))
    rows = (
        pick(linked, "actors", "actor_id", F.col("part"))
        .unionByName(pick(relations, "actor_relations", "relation_id", F.lit(2)))
        .unionByName(pick(events, "events", "event_id", F.lit(0)))
        .unionByName(pick(counts, "participation_counts", "participation_count_id", F.lit(0))))
    return rows.select(*RUN, "row_table", "row_id", F.struct("claim_sequence", "part").alias("seen"), "claim_id")


def row_evidence(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(row_table, row_id) -> evidence, one link per row of `row_claims` and bound reference; repeats are kept."""
    return rows.join(evidence.select(*RUN, "claim_id", "evidence_id", "ordinal"), RUN + ["claim_id"]).select(
        *RUN, "row_table", "row_id", "evidence_id", "ordinal", "seen", "claim_id")


def row_links(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """What a row shows of each of its bound references, and the first claim that cites the same place: no evidence id is needed.

    Every claim with a bound reference is supported, so the first one is the best.
    """
    cited = evidence.select(*RUN, "claim_id", "ordinal", "quote_text", "source_page", "first_claim")
    own = F.struct(F.col("seen.claim_sequence").alias("claim_sequence"), F.col("claim_id"))
    return rows.join(cited, RUN + ["claim_id"]).select(
        *RUN, "row_table", "row_id", "ordinal", "seen", "quote_text", "source_page", F.coalesce("first_claim", own).alias("rank"))


def deals_table(runs: DataFrame) -> DataFrame:
    """One row per (deal, run); runs(deal_slug, run_id, target_name)."""
    none = lambda kind: F.lit(None).cast(kind)
    return runs.select(
        deal_id().alias("deal_id"), *RUN,
        F.when(_filled("target_name"), stable_id("actor", F.col("deal_slug"), F.col("target_name"))).alias("target_actor_id"), "target_name",
        none("string").alias("announcement_date"), none("string").alias("effective_date"), none("boolean").alias("all_cash"))


def cycles_table(runs: DataFrame) -> DataFrame:
    return runs.select(
        cycle_id(F.col("deal_slug")).alias("cycle_id"), *RUN, deal_id().alias("deal_id"), F.lit(1).alias("cycle_sequence"),
        F.lit("primary").alias("cycle_label"), F.lit(None).cast("string").alias("start_date"), F.lit(None).cast("string").alias("end_date"))


class Tables(MutableMapping):
    """Tables by name, each made when it is first asked for: a reader of one table does not pay for the others."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def later(self, name: str, make: Callable[[], DataFrame]) -> None:
        """Adds a table that is made when it is first asked for."""
        self._makers[name] = make
        self._made.pop(name, None)

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self._makers[name], self._made[name] = lambda: df, df

    def __delitem__(self, name: str) -> None:
        del self._makers[name]
        self._made.pop(name, None)

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


Given = DataFrame | Callable[[], DataFrame]


def build_graph(
    claims: Given, rejected: Given, evidence: Given, runs: Given, spans: Given, flags: Given, staging: Staging | None = None,
) -> Tables:
    """Every table of the graph, for all deals and runs at once.

    A table, or a function that gives one, may be passed; stages and functions run when a table that needs them is asked for.
    """
    keep = (staging or Staging()).keep
    given = {"claims": claims, "evidence": evidence, "runs": runs, "spans": spans, "flags": flags}
    own = Tables({name: (df if callable(df) else lambda df=df: df) for name, df in given.items()} | {
        "rejected": lambda: keep("rejected", rejected() if callable(rejected) else rejected),
        "judged": lambda: judge_claims(own["claims"], own["rejected"]),
        "mentions": lambda: actor_mentions(own["judged"]),
        "merged": lambda: keep("merged", merge_mentions(own["mentions"])),
        "relations": lambda: keep("relations", relations_table(own["judged"], own["merged"])),
        "actors": lambda: keep("actors", propagate_members(apply_class_signals(own["merged"], own["relations"]), own["relations"])),
        "events": lambda: keep("events", events_table(own["judged"])),
        "counts": lambda: counts_table(own["judged"]),
        "links": lambda: coverage_links(own["judged"]),
        "row_claims": lambda: row_claims(own["mentions"], own["merged"], own["relations"], own["events"], own["counts"]),
        "lineage": lambda: keep("row_evidence", row_evidence(own["row_claims"], own["evidence"])),
    })
    return Tables({
        "claims": lambda: claims_table(own["claims"]), "claim_evidence": lambda: own["evidence"], "claim_dispositions": lambda: dispositions_table(own["judged"]),
        "claim_coverage_links": lambda: own["links"], "coverage_results": lambda: coverage_results(own["links"]), "evidence": lambda: own["spans"],
        "deals": lambda: deals_table(own["runs"]), "process_cycles": lambda: cycles_table(own["runs"]), "actors": lambda: actors_table(own["actors"]),
        "actor_relations": lambda: own["relations"], "events": lambda: own["events"].drop("_from", "_label", "actor_role", "role_detail"),
        "event_actor_links": lambda: event_links(own["events"], own["merged"]), "participation_counts": lambda: own["counts"],
        "row_evidence": lambda: own["lineage"], "row_links": lambda: row_links(own["row_claims"], own["evidence"]), "review_flags": lambda: own["flags"],
        "merged_actors": lambda: own["merged"],
    })
