"""Payload shape checks and claim rows."""
import json

import pytest
from conftest import FAMILIES, claim, payload_of, refs

from tracewell.operators.claims import explode_claims, is_claim_payload, payload_violations, relation_support, typed_claims
from pyspark.sql import functions as F


def broken(**changes):
    c = claim("actor", "q")
    c.update(changes)
    return payload_of(actor_claims=[c])


def without(name):
    c = claim("bid", "q")
    del c[name]
    return payload_of(bid_claims=[c])


def families(**extra):
    return json.dumps({**{f: [] for f in FAMILIES}, **extra})


CASES = {
    "good": (payload_of(actor_claims=[claim("actor", "q")], bid_claims=[claim("bid", "q", bid_value=21)], event_claims=[claim("event", "q")],
                        actor_relation_claims=[claim("actor_relation", "q")], participation_count_claims=[claim("participation_count", "q")]), []),
    "fenced": ("```json\n{}\n```", [("$", "malformed JSON")]),
    "list": ("[]", [("$", "expected JSON object")]),
    "missing": (json.dumps({f: [] for f in FAMILIES[1:]}), [("$", "expected claim object; missing actor_claims")]),
    "not array": (families(actor_claims={}), [("$.actor_claims", "expected array; got dict")]),
    "owned top": (families(coverage_results=[]), [("$", "includes engine-owned fields: coverage_results"), ("$.coverage_results", "unexpected field coverage_results")]),
    "snapshot": (families(schema_version="deal_graph_v2"), [
        ("$", "claim payload must not be a canonical output snapshot"), ("$.schema_version", "unexpected field schema_version")]),
    "enum": (broken(actor_class="s"), [("$.actor_claims[0].actor_class", "value 's' not in allowed enum")]),
    "type": (broken(actor_label=None), [("$.actor_claims[0].actor_label", "expected string; got NoneType")]),
    "owned claim": (broken(bidder_class="x"), [
        ("$.actor_claims[0]", "includes engine-owned fields: bidder_class"), ("$.actor_claims[0].bidder_class", "unexpected field bidder_class")]),
    "empty refs": (broken(evidence_refs=[]), [("$.actor_claims[0].evidence_refs", "array length 0 below minItems 1")]),
    "long quote": (broken(evidence_refs=refs("x" * 1501)), [("$.actor_claims[0].evidence_refs[0].quote_text", "string length 1501 exceeds maxLength 1500")]),
    "blank quote": (broken(evidence_refs=refs("ok") + refs("  ")), [("$.actor_claims[0].evidence_refs[1].quote_text", "must not be blank")]),
    "extra ref field": (broken(evidence_refs=[{**refs("q")[0], "page": 1}]), [("$.actor_claims[0].evidence_refs[0].page", "unexpected field page")]),
    "family": (broken(claim_type="bid"), [("$.actor_claims[0].claim_type", "value 'bid' not in allowed enum")]),
    "required": (without("bid_stage"), [("$.bid_claims[0].bid_stage", "missing required field")]),
    "range": (payload_of(bid_claims=[claim("bid", "q", bid_value_lower=3, bid_value_upper=2.5)]), [("$.bid_claims[0]", "bid_value_lower cannot exceed bid_value_upper")]),
    "counts": (payload_of(participation_count_claims=[claim("participation_count", "q", count_min=-1, count_max=-2)]), [
        ("$.participation_count_claims[0]", "count_min cannot exceed count_max"),
        ("$.participation_count_claims[0].count_min", "must not be negative"), ("$.participation_count_claims[0].count_max", "must not be negative")]),
}


@pytest.fixture(scope="module")
def payloads(spark):
    return spark.createDataFrame([(n, "r", p) for n, (p, _) in CASES.items()], "deal_slug string, run_id string, payload string")


def test_violations(payloads):
    got = {}
    for r in payload_violations(payloads).collect():
        got.setdefault(r.deal_slug, []).append((r.path, r.message))
    assert {n: sorted(got.get(n, [])) for n in CASES} == {n: sorted(e) for n, (_, e) in CASES.items()}


def test_payload_predicate(payloads):
    got = {r[0]: r[1] for r in payloads.select("deal_slug", is_claim_payload(F.col("payload"))).collect()}
    assert got["good"] and got["enum"] and not (got["list"] or got["fenced"] or got["missing"] or got["not array"])


def test_claims_are_numbered_in_family_order(spark):
    payload = payload_of(
        bid_claims=[claim("bid", "b1", bid_value=21.5), claim("bid", "b2")], actor_claims=[claim("actor", "a1"), claim("actor", "a2")],
        actor_relation_claims=[claim("actor_relation", "Party S joined group O and provided capital", subject_label="S", object_label="O", relation_type="finances")])
    df = explode_claims(spark.createDataFrame([("d", "r", payload)], "deal_slug string, run_id string, payload string"))
    rows = sorted(df.collect(), key=lambda r: r.claim_sequence)
    assert [(r.claim_sequence, r.claim_type, r.claim_index) for r in rows] == [
        (1, "actor", 0), (2, "actor", 1), (3, "actor_relation", 0), (4, "bid", 0), (5, "bid", 1)]
    raw = json.loads(rows[3].raw_value)
    assert list(raw) == sorted(raw) and raw["bid_value"] == 21.5 and raw["bid_date"] is None
    assert len({r.claim_id for r in rows}) == 5
    assert typed_claims(df, "bid").columns == ["deal_slug", "run_id", "claim_id", "bidder_label", "bid_date", "bid_value", "bid_value_lower",
                                               "bid_value_upper", "bid_value_unit", "consideration_type", "bid_stage"]
    assert relation_support(df).first().unsupported == []
