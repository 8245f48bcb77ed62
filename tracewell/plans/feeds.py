"""Adapters: the given tables read as pages, claims, quotes and runs, whole tables only.

`events` is a filing of one two-paragraph page per event (deal = user) plus the claims made
about it; `documents` are one-page filings; `orders` are runs of the deal of their customer.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.functions.hashing import stable_json
from tracewell.operators.claims import identify_claims
from tracewell.schemas import (
    ACTOR_CLASS, CLAIM_FAMILIES, CLAIM_FIELDS, COUNT_QUALIFIER, EVENT_SUBTYPE, FAMILY_BY_TYPE, PROCESS_STAGE, RELATION_TYPE)

SUBJECTS = ("Party A", "party  a", "Apex Capital", "Strategic Foods", "Remaining Bidders", "Kite Advisors")
GROUPS = ("Sponsor Group", "Delta/Echo")
PHRASES = (
    "Party A submitted an unsolicited proposal", "the board contacted several potential buyers",
    "the bidder withdrew because the price was below its prior indication", "an activist holder approached the company",
    "the offer was under the current market price", "no strategic fit was found by either side",
    "financing could not be arranged in time", "the Company authorized its advisor to contact parties",
    "a confidential leak ended the talks early", "representatives contacted the remaining bidders",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, *columns: str, name: str) -> DataFrame:
    """Some columns of `table`."""
    return table(spark, folder, name).select(*columns)


def one_of(values, index: str) -> str:
    """SQL: the index-th of a list of literals (0-based); a Python None is NULL."""
    items = ",".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"element_at(array({items}), cast({index} as int) + 1)"


def event_feed(spark: SparkSession, folder: str) -> DataFrame:
    """events with k, deal, day and the label and text pieces every adapter shares."""
    e = text_table(spark, folder, "event_id", "ts", "user_id", "event_type", "value", "props", name="events").selectExpr(
        "event_id", "ts", "user_id", "event_type", "value", "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k")
    return e.selectExpr(
        "*", "concat('deal_', user_id) as deal_slug", "'r1' as run_id", "date_format(ts, 'yyyy-MM-dd') as day",
        f"{one_of(SUBJECTS, 'event_id % 6')} as label", f"{one_of(GROUPS, 'event_id % 2')} as group_label", f"{one_of(PHRASES, 'k % 10')} as phrase")


def event_pages(feed: DataFrame) -> DataFrame:
    return feed.selectExpr(
        "deal_slug", "event_id as page_pos", "cast(event_id as int) as number",
        "concat('Entry ', event_id, ': ', phrase, '.\\n\\nThe filing notes ', event_type, ' activity of ', label, '.') as content")


REFS = """
concat(
  array(named_struct(
    'citation_unit_id', concat('page_', event_id, if(k % 20 = 9, '_paragraph_9', '_paragraph_1')),
    'quote_text', CASE k % 20 WHEN 19 THEN concat('not in the text of entry ', event_id)
      WHEN 3 THEN concat('Entry ', event_id, ': ', phrase, '.\\n\\nThe filing notes') WHEN 17 THEN concat('The filing notes ', event_type, ' activity of') ELSE phrase END)),
  if(k % 4 = 0 OR k % 20 = 19,
     array(named_struct('citation_unit_id', concat('page_', event_id, '_paragraph_2'), 'quote_text', concat('The filing notes ', event_type, ' activity of'))),
     array()))
"""


def event_claims(feed: DataFrame) -> DataFrame:
    """The claims about the events: one per event, and a second one for some sign-ups."""
    kinds = (
        "CASE event_type WHEN 'signup' THEN if(k % 5 = 0, array('actor', 'event'), array('actor')) WHEN 'click' THEN array('actor_relation') "
        "WHEN 'view' THEN array('event') WHEN 'purchase' THEN array('bid') ELSE array('participation_count') END")
    rows = feed.selectExpr("*", f"explode({kinds}) as claim_type", f"{REFS} as evidence_refs")
    on = lambda kind, value, cast="string": f"CASE WHEN claim_type = '{kind}' THEN cast({value} as {cast}) END"
    fields = {
        "actor_label": "CASE WHEN claim_type = 'actor' THEN label WHEN claim_type = 'event' AND k % 4 <> 3 THEN label END",
        "actor_kind": on("actor", one_of(("organization", "organization", "person", "cohort"), "k % 4")),
        "observability": on("actor", one_of(("named", "anonymous_handle"), "k % 2")),
        "actor_class": (f"CASE WHEN claim_type = 'actor' THEN if(k < 6, {one_of(('financial', 'strategic', 'mixed'), 'k % 3')}, 'unknown') "
                        f"WHEN claim_type = 'participation_count' THEN {one_of(ACTOR_CLASS, 'k % 4')} END"),
        "subject_label": on("actor_relation", "label"), "object_label": on("actor_relation", "group_label"),
        "relation_type": on("actor_relation", one_of(RELATION_TYPE, "k % 11")),
        "role_detail": on("actor_relation", one_of(("strategic buyer", "financial sponsor", None, "legal counsel"), "event_id % 4")),
        "effective_date_first": on("actor_relation", "CASE k % 3 WHEN 0 THEN day WHEN 1 THEN substring(day, 1, 7) END"),
        "event_type": on("event", "'process'"), "event_subtype": on("event", f"if(k >= 95, 'board_meeting', {one_of(EVENT_SUBTYPE, 'k % 18')})"),
        "event_date": on("event", "if(k % 5 = 4, NULL, day)"), "description": on("event", "concat('Entry ', event_id)"),
        "actor_role": on("event", "if(k % 2 = 0, 'potential buyer', NULL)"),
        "bidder_label": on("bid", "label"), "bid_date": on("bid", "day"), "bid_value": on("bid", "if(k % 3 = 0, value, NULL)", "double"),
        "bid_value_lower": on("bid", "if(k % 3 = 1, value, NULL)", "double"), "bid_value_upper": on("bid", "if(k % 3 = 1, value * 2, NULL)", "double"),
        "bid_value_unit": on("bid", one_of(("per_share", "enterprise_value", None), "k % 3")),
        "consideration_type": on("bid", one_of(("cash", "stock", "mixed", None), "k % 4")),
        "bid_stage": on("bid", one_of(("initial", "revised", "final", "unspecified"), "k % 4")),
        "process_stage": on("participation_count", one_of(PROCESS_STAGE, "k % 6")), "count_min": on("participation_count", "k % 9", "int"),
        "count_max": on("participation_count", "CASE k % 3 WHEN 1 THEN k % 9 WHEN 2 THEN k % 9 + 2 END", "int"),
        "count_qualifier": on("participation_count", one_of(COUNT_QUALIFIER, "k % 5")),
        "confidence": one_of(("high", "high", "medium", "low"), "event_id % 4"), "coverage_obligation_id": "concat('obl_', k % 7)",
        "evidence_refs": "evidence_refs"}
    assert set(fields) == set(CLAIM_FIELDS)
    rank = "CASE claim_type WHEN 'actor' THEN 0 WHEN 'actor_relation' THEN 1 WHEN 'event' THEN 2 WHEN 'bid' THEN 3 ELSE 4 END"
    wide = rows.selectExpr(
        "deal_slug", "run_id", "claim_type", "cast(event_id as int) as claim_index", f"{rank} * 1000000000000 + event_id as claim_sequence",
        *[f"{sql} as {name}" for name, sql in fields.items()])
    raw = F.lit(None).cast("string")
    family = F.lit(None).cast("string")
    for name, spec in CLAIM_FAMILIES.items():
        is_kind = F.col("claim_type") == spec["claim_type"]
        raw = F.when(is_kind, stable_json(F.struct(*sorted(spec["fields"])))).otherwise(raw)
        family = F.when(is_kind, F.lit(FAMILY_BY_TYPE[spec["claim_type"]])).otherwise(family)
    return identify_claims(wide.withColumns({"raw_value": raw, "family": family}))


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is a one-page filing."""
    return text_table(spark, folder, "doc_id", "source", "text", name="documents").selectExpr(
        "concat('doc_', doc_id) as deal_slug", "doc_id", "source", "0 as page_pos", "1 as number", "text as content")


def run_feed(spark: SparkSession, folder: str) -> DataFrame:
    """orders as archived runs of the deal of their customer."""
    return table(spark, folder, "orders").selectExpr(
        "concat('deal_', o_custkey) as deal_slug", "concat('run_', o_orderkey) as run_id", "o_orderkey", "o_custkey",
        "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00Z') as finished_at",
        "CASE o_orderstatus WHEN 'F' THEN 'passed_clean' WHEN 'O' THEN 'needs_review' ELSE 'high_burden' END as outcome",
        "o_orderpriority <> '1-URGENT' as stability_eligible", "if(o_custkey % 7 = 0 AND o_orderkey % 2 = 0, 'model-b', 'model-a') as model",
        "o_totalprice", "concat('rules_', o_custkey % 3) as rulebook_version")


def progress_feed(spark: SparkSession, folder: str) -> DataFrame:
    """customers as the stored state of deals."""
    status = one_of(("passed_clean", "needs_review", "high_burden", "failed_system", "stale_after_failure", "pending", None, "verified_old"), "c_custkey % 8")
    text = lambda sql: f"cast({sql} as string)"
    return table(spark, folder, "customer").selectExpr(
        "concat('deal_', c_custkey) as deal_slug", "c_custkey", "c_custkey % 5 = 0 as is_reference", f"{status} as status", "cast(c_custkey % 13 as int) as flag_count",
        text("if(c_custkey % 6 = 0, NULL, '2024-01-01T00:00:00Z')") + " as last_run", text("concat('run_', c_custkey)") + " as last_run_id",
        text("if(c_custkey % 10 = 0, 'reviewer', NULL)") + " as last_verified_by", text("NULL") + " as last_verified_at",
        text("if(c_custkey % 10 = 0, concat('run_', c_custkey), NULL)") + " as last_verified_run_id", "c_custkey % 11 = 0 as verified",
        text("if(c_custkey % 10 = 0, 'report.md', NULL)") + " as verification_report", text("c_mktsegment") + " as notes",
        text("concat('rules_', c_custkey % 3)") + " as rulebook_version",
        "cast(array() as array<struct<ts:string,run_id:string,version:string>>) as rulebook_version_history")
