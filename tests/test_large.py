"""What runs over sixty times the tables showed: rows judged, made and moved once."""
from __future__ import annotations

import json

from conftest import claim, payload_of, refs, run_deals

from pyspark.sql import functions as F

from tracewell.operators import review
from tracewell.operators.claims import payload_violations, plainly_valid
from tracewell.sources import sinks

PAGES = ["Party A signed an NDA.\n\nParty B made a bid."]


def _graph(spark):
    """Two claims that cite one place, the later one a row of its own; a claim of several references, one of which fails."""
    a, b = "page_1_paragraph_1", "page_1_paragraph_2"
    payload = payload_of(
        actor_claims=[claim("actor", evidence=refs("Party A signed", unit=a)), claim("actor", evidence=refs("nowhere", unit=b) + refs("Party B", unit=b), actor_label="Party B")],
        event_claims=[claim("event", evidence=refs("Party A signed", unit=a), actor_label="Party A"), claim("event", evidence=refs("missing", unit=a))],
        bid_claims=[claim("bid", evidence=refs("Party B", unit=b) + refs("a bid", unit=b), bidder_label="Party B")])
    return run_deals(spark, {"d": {"payload": payload, "pages": PAGES}, "e": {"payload": payload, "pages": PAGES}})


def test_review_rows_of_an_intake_are_made_once(spark):
    """The rows of the review were made anew for their positions, after the ledger had its own; rows that are numbered were compared whole."""
    graph = _graph(spark)
    rows = graph["review_rows"]
    assert rows.inputFiles() and all("/review-" in f for f in rows.inputFiles())
    assert [r.position for r in rows.filter("deal_slug = 'd'").orderBy("position").collect()] == list(range(1, 6))
    for table in ("review_rows", "spans"):
        whole = sinks.storable(graph[sinks.GRAPH_KEY.get(table, table)], table)
        assert not whole._jdf.queryExecution().logical().toString().startswith("Distinct") and whole.count() == whole.distinct().count()


def test_rows_find_their_claims_along_their_links(spark):
    """A row's quotes and first claim came by three joins over evidence ids; along its links they are the same."""
    graph = _graph(spark)
    along = sorted(map(tuple, review.row_sources(graph).collect()))
    looked_up = sorted(map(tuple, review.row_sources({n: graph[n] for n in ("claims", "claim_dispositions", "claim_evidence", "evidence", "row_evidence")}).collect()))
    assert along == looked_up and len(along) == 8
    first = {r.claim_id for r in graph["claims"].collect() if r.claim_type == "actor" and r.deal_slug == "d" and "Party A" in r.raw_value}
    event = [r for r in review.row_sources(graph).collect() if r.deal_slug == "d" and r.row_table == "events" and r.bound_source_quote == "Party A signed"]
    assert {r.claim_id for r in event} == first
    assert "evidence_id" not in review.row_sources(graph)._jdf.queryExecution().optimizedPlan().toString()


def test_references_are_numbered_in_their_claims(spark):
    graph = _graph(spark)
    evidence = {(r.claim_id, r.ordinal) for r in graph["claim_evidence"].filter("deal_slug = 'd'").collect()}
    assert sorted(o for _, o in evidence) == [1, 1, 1, 1, 2]


def test_plainly_valid_payloads_are_not_taken_apart(spark):
    good = [claim("actor", "q"), claim("event", "q é \" \\ \n x"), claim("bid", "q", bid_value=21.5), claim("participation_count", "q")]
    body = json.loads(payload_of(actor_claims=good[:1], event_claims=good[1:2], bid_claims=good[2:3], participation_count_claims=good[3:]))
    mixed = json.dumps({k: [dict(reversed(c.items())) for c in v] for k, v in reversed(body.items())}, indent=1)
    whole = claim("bid", "q", bid_value=21)
    texts = {
        "good": json.dumps(body), "mixed": mixed, "whole": payload_of(bid_claims=[whole]), "tail": json.dumps(body) + " 1", "twice": json.dumps(body)[:-1] + ', "bid_claims": []}',
        "null claim": payload_of(actor_claims=[None]), "null ref": payload_of(actor_claims=[claim("actor", evidence=[None])]), "null": None, "list": "[]",
        "number": payload_of(actor_claims=[claim("actor", "q", actor_label=7)]), "none": payload_of(actor_claims=[claim("actor", "q", actor_kind=None)]),
        "blank": payload_of(actor_claims=[claim("actor", " \t")]), "range": payload_of(bid_claims=[claim("bid", "q", bid_value_lower=2.5, bid_value_upper=1.5)]),
        "below": payload_of(participation_count_claims=[claim("participation_count", "q", count_min=-1)])}
    rows = spark.createDataFrame([(n, "r", t) for n, t in texts.items()], "deal_slug string, run_id string, payload string")
    plain = {r[0] for r in rows.filter(plainly_valid(F.col("payload"))).collect()}
    assert plain == {"good", "mixed"}
    assert {r.deal_slug for r in payload_violations(rows).collect()} == set(texts) - {"good", "mixed", "whole"}


def _events(spark, tmp_path):
    import datetime
    day = datetime.datetime(2024, 1, 2)
    kinds = ("view", "click", "purchase", "signup", "error")
    rows = [(i, day, 1 + i % 3, kinds[i % 5], float(i % 7), json.dumps({"k": i % 100})) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(
        str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_codes_of_the_ledger_need_no_review(spark, tmp_path):
    """The list of codes was read off whole ledger rows: quotes, flags and the search behind them were made for it."""
    from tracewell.plans import catalog
    folder = _events(spark, tmp_path)
    codes = [r.event_code for r in catalog.QUERIES["distinct_codes"](spark, folder).collect()]
    assert {name for _, f, name in catalog._STAGED if f == folder} == {"claims", "units", "bound"}
    ledger = catalog.QUERIES["ledger_rows"](spark, folder)
    assert codes == sorted({r.event_code for r in ledger.select("event_code").collect()}) and len(codes) > 10


def test_key_sets_lose_no_key(spark):
    from tracewell.functions.keyset import KeySet
    rows = spark.range(0, 50000).selectExpr("if(id % 1000 = 7, NULL, id) as a", "concat('x', id % 13) as b")
    keys = rows.filter("a % 100 = 3 OR a IS NULL")
    kept = KeySet(keys, ["a", "b"]).kept(rows)
    assert kept.columns == ["a", "b"] and keys.exceptAll(kept).isEmpty() and kept.count() < keys.count() + 500
    assert KeySet(keys.limit(0), ["a", "b"]).kept(rows).isEmpty()


def test_only_claims_that_may_be_rejected_are_joined(spark):
    from tracewell.operators.graph import judge_claims
    claims = spark.range(0, 20000).selectExpr("concat('d', id % 5) as deal_slug", "'r' as run_id", "concat('c', id) as claim_id", "id as claim_sequence")
    rejected = claims.filter("claim_sequence % 500 = 1").selectExpr("deal_slug", "run_id", "claim_id", "'why' as first_error")
    judged = judge_claims(claims, rejected)
    assert judged.filter("disposition = 'rejected_unsupported' AND reason = 'why' AND claim_sequence % 500 = 1").count() == 40
    assert judged.count() == 20000 and judged.filter("disposition = 'supported'").count() == 19960
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") >= 2


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_that_hold_no_key_of_a_quote_stay_where_they_are(spark):
    """Every place of every text was moved to meet the keys of quotes of three and four tokens, every token those of shorter ones."""
    from tracewell.operators.contains import candidate_texts, hashed_quotes, verified
    texts = [f"the a{i} of b{i} and c{i} so" for i in range(200)] + ["x  of y", " of "]
    quotes = ["a7 of b7", "7 of b7 and", " of b3 ", "x  of y", "c9 so", "17"]
    q = spark.createDataFrame([("d", x) for x in quotes], "deal_slug string, quote_text string")
    t = spark.createDataFrame([("d", x) for x in texts], "deal_slug string, text string").withColumn("text_hash", F.sha2("text", 256))
    hashed = hashed_quotes(q, ["deal_slug"])
    met = candidate_texts(hashed, t, ["deal_slug"])
    assert _plan(met).count("_bits") > 0
    got = sorted((r.quote_text, r.text_hash) for r in verified(met, hashed, t, ["deal_slug"]).collect())
    sha = {r.text: r.text_hash for r in t.collect()}
    assert got == sorted((x, sha[y]) for x in quotes for y in texts if x in y)


def test_only_texts_near_a_reference_are_looked_at(spark):
    """All units of a deal were moved with their texts, several times, to be placed."""
    from tracewell.operators.binding import stitched_units
    units = spark.createDataFrame(
        [(d, f"page_{i}_paragraph_1", f"Entry {i} of {d}: " + "word " * 200 + f"end {i}", i) for d in ("a", "b", "c") for i in range(60)],
        "deal_slug string, unit_id string, text string, sequence int")
    refs = spark.createDataFrame([("a", "page_7_paragraph_1", "end 7\n\nEntry 8 of"), ("b", None, "end 50\nEntry 51"), ("b", None, "not there at all")],
                                 "deal_slug string, citation_unit_id string, quote_text string")
    found = stitched_units(refs, units)
    assert {(r.deal_slug, tuple(r.stitched)) for r in found.collect()} == {
        ("a", ("page_7_paragraph_1", "page_8_paragraph_1")), ("b", ("page_50_paragraph_1", "page_51_paragraph_1"))}
    assert _plan(found).count("_bits") > 0 and "Window" not in _plan(found)
