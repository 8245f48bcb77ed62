"""The 48-column review projection."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.hashing import make_id, stable_json
from tracewell.functions.ranking import ordinal
from tracewell.functions.text import cell, join_cell
from tracewell.operators.integrity import is_current
from tracewell.schemas import REVIEW_FIELDS, REVIEW_NUMERIC, SUPPORTED_DISPOSITIONS

RUN = ["deal_slug", "run_id"]
ROW = RUN + ["row_table", "row_id"]
DEFAULT_ACTION = "Review the source support and canonical row fields."
REJECTED_ACTION = "Review the supplied citation unit and quote, or reject the claim."
_METADATA = ("suggested_action", "evidence_ref_index", "provided_citation_unit_id", "provided_quote_text", "diagnostic_subcode")


# ---- flags ---------------------------------------------------------------------------
def metadata_fields(flags: DataFrame) -> Column:
    """The five metadata fields the projection reads, from a struct or from JSON text; null if no object."""
    kind = dict(flags.dtypes)["metadata"]
    meta = F.col("metadata")
    if kind == "string":
        is_object = F.schema_of_variant(F.try_parse_json(meta)).startswith("OBJECT")
        fields = [F.get_json_object(meta, f"$.{n}").alias(n) for n in _METADATA]
        return F.when(is_object, F.struct(*fields))
    return F.when(meta.isNotNull(), F.struct(*[meta[n].cast("string").alias(n) for n in _METADATA]))


def live_flags(flags: DataFrame) -> DataFrame:
    """V9: current flags that are not resolved."""
    status = F.col("status") if "status" in flags.columns else F.lit(None).cast("string")
    return flags.filter(is_current(flags) & (F.coalesce(status, F.lit("")) != "resolved"))


def flag_sets(flags: DataFrame) -> DataFrame:
    """Per flagged row: its distinct issues in flag order, and the first metadata object.

    Equal issues are merged before they are gathered, so a row gathers issues, not flags.
    """
    live = live_flags(flags).select(*ROW, "flag_order", "code", "reason", metadata_fields(flags).alias("m"))
    merged = live.groupBy(*ROW, "code", "reason", F.col("m.diagnostic_subcode").alias("subcode")).agg(
        F.min("flag_order").alias("at"), F.min(F.when(F.col("m").isNotNull(), F.struct("flag_order", "m"))).alias("first_m"))
    return merged.groupBy(*ROW).agg(
        F.array_sort(F.collect_list(F.struct("at", "code", "reason", "subcode"))).alias("issues"), F.min("first_m")["m"].alias("meta"))


def issue_codes(issues: Column, extra: Column | None = None) -> Column:
    """distinct codes in order, then extra codes, then diagnostic subcodes."""
    codes = F.transform(issues, lambda i: i["code"])
    subcodes = F.transform(issues, lambda i: i["subcode"])
    parts = [codes] + ([F.array(extra)] if extra is not None else []) + [subcodes]
    kept = F.filter(F.concat(*parts), lambda v: v.isNotNull() & (v != ""))
    return F.array_join(F.array_distinct(kept), "; ")


def issue_reasons(issues: Column, extra: Column | None = None) -> Column:
    reasons = F.transform(issues, lambda i: i["reason"])
    if extra is not None:
        reasons = F.concat(reasons, F.array(extra))
    return F.array_join(F.array_distinct(F.filter(reasons, lambda v: v.isNotNull() & (v != ""))), ",")


# ---- claims of rows ------------------------------------------------------------------
def current_dispositions(dispositions: DataFrame) -> DataFrame:
    return dispositions.filter(is_current(dispositions)).select(
        *RUN, "claim_id", "disposition", "reason_code", F.col("reason").alias("disposition_reason"))


def best_claims(claims: DataFrame, dispositions: DataFrame, evidence: DataFrame) -> DataFrame:
    """J8, first half: for each evidence id the claim a row would cite through it.

    Supported before unsupported, then lowest sequence. The order belongs to the claim alone,
    so the best claim of a row is the best of its evidences' best: no row-claim pairs arise.
    """
    supported = F.coalesce(F.col("disposition").isin(*SUPPORTED_DISPOSITIONS), F.lit(False))
    ranked = claims.select(*RUN, "claim_id", "claim_sequence").join(
        current_dispositions(dispositions), RUN + ["claim_id"], "left")
    ranked = ranked.select(*RUN, "claim_id", F.struct((~supported).alias("unsupported"), "claim_sequence", "claim_id").alias("rank"))
    return evidence.select(*RUN, "claim_id", "evidence_id").join(ranked, RUN + ["claim_id"]).groupBy(*RUN, "evidence_id").agg(F.min("rank").alias("rank"))


def row_sources(graph: dict[str, DataFrame]) -> DataFrame:
    """Per canonical row its source claim and its evidence cells (repeats kept).

    A graph that was built from claims has them along its links; of stored tables they are looked up by evidence.
    """
    if "row_links" in graph and "first_claim" in graph["claim_evidence"].columns:
        return _grouped_links(graph["row_links"].withColumn("known", F.lit(True)))
    return _grouped_links(_looked_up_links(graph))


def _looked_up_links(graph: dict[str, DataFrame]) -> DataFrame:
    best = best_claims(graph["claims"], graph["claim_dispositions"], graph["claim_evidence"])
    info = graph["evidence"].select(*RUN, "evidence_id", "quote_text", "source_page", F.lit(True).alias("known")).join(
        best, RUN + ["evidence_id"], "full")
    return graph["row_evidence"].select(*ROW, "evidence_id", "ordinal", "seen").join(info, RUN + ["evidence_id"], "left")


def _grouped_links(rows: DataFrame) -> DataFrame:
    link = F.when(F.col("known"), F.struct("ordinal", "seen", "quote_text", "source_page"))
    grouped = rows.groupBy(*ROW).agg(F.min("rank")["claim_id"].alias("claim_id"), F.array_sort(F.collect_list(link)).alias("links"))
    return grouped.select(
        *ROW, "claim_id",
        join_cell(F.transform("links", lambda x: x["quote_text"])).alias("bound_source_quote"),
        join_cell(F.transform("links", lambda x: x["source_page"].cast("string"))).alias("bound_source_page"))


def claim_summary(raw: Column, claim_type: Column) -> Column:
    """one line about a claim, by type."""
    get = lambda name: F.get_json_object(raw, f"$.{name}")
    text = lambda name: F.coalesce(get(name), F.lit(""))
    number = lambda name: F.when(get(name).cast("double") == 0, "").otherwise(text(name))
    shown = lambda name: F.coalesce(get(name), F.lit("None"))
    some = lambda name: F.coalesce(get(name), F.lit("")) != ""
    value = (
        F.when(some("bid_value"), get("bid_value"))
        .when(some("bid_value_lower") | some("bid_value_upper"), F.concat(shown("bid_value_lower"), F.lit("-"), shown("bid_value_upper")))
        .otherwise("value unspecified"))
    date = F.when(some("event_date"), get("event_date")).otherwise("undated")
    return (
        F.when(claim_type == "actor", F.trim(F.concat(F.lit("actor "), text("actor_label"), F.lit(" ("), text("actor_kind"), F.lit(")"))))
        .when(claim_type == "actor_relation", F.trim(F.concat_ws(" ", text("subject_label"), text("relation_type"), text("object_label"))))
        .when(claim_type == "bid", F.trim(F.concat_ws(" ", text("bidder_label"), text("bid_stage"), F.lit("bid"), value)))
        .when(claim_type == "participation_count", F.trim(F.concat(
            text("process_stage"), F.lit(" "), text("actor_class"), F.lit(" count "), number("count_min"), F.lit("-"), number("count_max"))))
        .when(claim_type == "event", F.trim(F.concat_ws(" ", date, text("event_subtype"), text("actor_label"))))
        .otherwise(raw))


def claim_label(claim_type: Column) -> Column:
    """F25."""
    return F.when(claim_type.endswith("_claim"), claim_type).otherwise(F.concat(claim_type, F.lit("_claim")))


def claim_cells(claims: DataFrame) -> DataFrame:
    """F27 and the other cells a row takes from its claim."""
    if "evidence_refs" in claims.columns:
        refs = F.col("evidence_refs")
    else:
        refs = F.from_json("raw_value", "struct<evidence_refs:array<struct<citation_unit_id:string,quote_text:string>>>")["evidence_refs"]
    column = lambda name: join_cell(F.transform(refs, lambda r: r[name]))
    none = F.lit("")
    return claims.select(
        *RUN, "claim_id", claim_label(F.col("claim_type")).alias("claim_type"), claim_summary(F.col("raw_value"), F.col("claim_type")).alias("claim_summary"),
        "confidence", F.coalesce(column("citation_unit_id"), none).alias("citation_unit_id"), F.coalesce(column("quote_text"), none).alias("supplied_quote"))


# ---- branches ------------------------------------------------------------------------
def _branch(df: DataFrame, rank: int, table: str, row_id: str, order: list[Column], own: dict[str, Column], extra: dict[str, Column]) -> DataFrame:
    """Rows of one canonical table with their own cells; `order` is (block, finer block, within...)."""
    coarse, fine, *within = order
    values = {n: (v if n in REVIEW_NUMERIC else cell(v)) for n, v in own.items()}
    hidden = {"_bidder_class": F.lit(None).cast("string"), "_relation_date": F.lit(None).cast("string"), **extra}
    return df.filter(F.col(row_id).isNotNull()).select(
        *RUN, F.lit(table).alias("row_table"), F.col(row_id).alias("row_id"),
        F.concat(F.lit(str(rank)), coarse).alias("_l1"), fine.alias("_l2"), F.concat_ws("\u0001", *within).alias("_l3"),
        *[v.alias(n) for n, v in values.items()], *[v.alias(n) for n, v in hidden.items()])


def actor_rows(graph: dict[str, DataFrame]) -> DataFrame:
    """P3."""
    label = cell(F.col("actor_label"))
    return _branch(
        graph["actors"], 0, "actors", "actor_id", [F.substring(label, 1, 2), label, F.col("actor_id")],
        {"actor_id": F.col("actor_id"), "actor_label": F.col("actor_label"), "actor_kind": F.col("actor_kind"), "actor_class": F.col("bidder_class")}, {})


def relation_rows(graph: dict[str, DataFrame]) -> DataFrame:
    """P4, J12."""
    classes = graph["actors"].select(*RUN, F.col("actor_id").alias("subject_actor_id"), F.col("bidder_class").alias("_class"))
    rows = graph["actor_relations"].join(classes, RUN + ["subject_actor_id"], "left")
    rid = F.col("relation_id")
    order = [F.substring(rid, 1, 11), F.substring(rid, 1, 13), rid, F.lpad(F.col("claim_sequence").cast("string"), 20, "0") if "claim_sequence" in rows.columns else F.lit("")]
    own = {n: F.col(n) for n in ("relation_id", "relation_type", "subject_actor_id", "subject_actor_label", "object_actor_id", "object_actor_label")}
    own |= {"actor_id": F.col("subject_actor_id"), "actor_label": F.col("subject_actor_label"), "actor_role": F.col("relation_type"), "cycle_id": F.col("cycle_id_first_observed")}
    return _branch(rows, 1, "actor_relations", "relation_id", order, own, {"_bidder_class": F.col("_class"), "_relation_date": F.col("effective_date_first")})


def event_rows(graph: dict[str, DataFrame]) -> DataFrame:
    """Event left join links left join actors."""
    links = graph["event_actor_links"].select(*RUN, "event_id", F.col("actor_id").alias("_a"), "role", "link_id")
    actors = graph["actors"].select(*RUN, F.col("actor_id").alias("_a"), "actor_label", "actor_kind", "bidder_class", F.lit(True).alias("_known"))
    rows = graph["events"].join(links, RUN + ["event_id"], "left").join(actors, RUN + ["_a"], "left")
    eid, date = F.col("event_id"), F.col("event_date")
    order = [F.concat(F.when(date.isNull(), "1").otherwise("0"), cell(date)), F.substring(eid, 1, 8), eid, cell(F.col("link_id"))]
    own = {n: F.col(n) for n in (
        "cycle_id", "event_id", "event_date", "event_type", "event_subtype", "actor_label", "actor_kind", "bid_value", "bid_value_lower",
        "bid_value_upper", "bid_value_unit", "consideration_type", "bid_stage")}
    own |= {"actor_id": F.when(F.col("_known"), F.col("_a")), "actor_role": F.col("role")}
    return _branch(rows, 2, "events", "event_id", order, own, {"_bidder_class": F.col("bidder_class")})


def count_rows(graph: dict[str, DataFrame]) -> DataFrame:
    """P6."""
    cid = F.col("participation_count_id")
    own = {n: F.col(n) for n in ("participation_count_id", "cycle_id", "process_stage", "actor_class", "count_min", "count_max", "count_qualifier")}
    return _branch(graph["participation_counts"], 3, "participation_counts", "participation_count_id", [F.substring(cid, 1, 22), F.substring(cid, 1, 24), cid], own, {})


def rejected_rows(graph: dict[str, DataFrame]) -> DataFrame:
    """Claims nothing of which bound."""
    rejected = graph["claim_dispositions"].filter(F.col("disposition") == "rejected_unsupported").select(
        *RUN, "claim_id", "reason_code", F.col("reason").alias("d_reason"))
    flags = flag_sets(graph["review_flags"].filter("row_table = 'claims'")).select(*RUN, F.col("row_id").alias("claim_id"), "issues", "meta")
    rows = rejected.join(claim_cells(graph["claims"]), RUN + ["claim_id"]).join(flags, RUN + ["claim_id"], "left")
    issues = F.coalesce("issues", F.filter(F.array(F.lit(None).cast(rows.schema["issues"].dataType.elementType)), lambda x: F.lit(False)))
    stated = lambda name, other: F.coalesce(F.nullif(F.col(f"meta.{name}"), F.lit("")), other)
    cid = F.col("claim_id")
    return rows.select(
        *RUN, F.lit("claims").alias("row_table"), cid.alias("row_id"), F.concat(F.lit("4"), F.substring(cid, 1, 8)).alias("_l1"),
        F.substring(cid, 1, 10).alias("_l2"), cid.alias("_l3"), F.lit("rejected_claim").alias("review_status"), "claim_id", "claim_type", "claim_summary",
        cell(F.col("confidence")).alias("confidence"), stated("provided_citation_unit_id", F.col("citation_unit_id")).alias("citation_unit_id"),
        stated("provided_quote_text", F.col("supplied_quote")).alias("supplied_quote"),
        issue_codes(issues, F.col("reason_code")).alias("issue_codes"), issue_reasons(issues, F.col("d_reason")).alias("issue_reasons"),
        stated("suggested_action", F.lit(REJECTED_ACTION)).alias("suggested_action"), cell(F.col("meta.evidence_ref_index")).alias("evidence_ref_index"))


def canonical_rows(graph: dict[str, DataFrame]) -> DataFrame:
    """The four canonical branches with status, claim, quotes and issues.

    Row flags and claim flags are two keyed joins whose issue lists are concatenated.
    """
    branches = [f(graph) for f in (actor_rows, relation_rows, event_rows, count_rows)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    flags = flag_sets(graph["review_flags"])
    own = flags.withColumnsRenamed({"issues": "_own", "meta": "_own_meta"})
    of_claim = flags.filter("row_table = 'claims'").select(*RUN, F.col("row_id").alias("claim_id"), F.col("issues").alias("_claim"), F.col("meta").alias("_claim_meta"))
    rows = rows.join(row_sources(graph), ROW, "left").join(own, ROW, "left").join(of_claim, RUN + ["claim_id"], "left")
    rows = rows.join(claim_cells(graph["claims"]), RUN + ["claim_id"], "left")
    none = F.filter(F.array(F.lit(None).cast(rows.schema["_own"].dataType.elementType)), lambda x: F.lit(False))
    issues = F.concat(F.coalesce("_own", none), F.coalesce("_claim", none))
    rows = rows.withColumn("_issues", issues).withColumn("_meta", F.coalesce("_own_meta", "_claim_meta"))
    flagged = F.size("_issues") > 0
    action = F.coalesce(F.nullif(F.col("_meta.suggested_action"), F.lit("")), F.when(flagged, DEFAULT_ACTION).otherwise(""))
    return rows.select(
        *rows.drop("_own", "_own_meta", "_claim", "_claim_meta", "_issues", "_meta").columns,
        F.when(flagged, "needs_review").otherwise("clean").alias("review_status"), issue_codes(F.col("_issues")).alias("issue_codes"),
        issue_reasons(F.col("_issues")).alias("issue_reasons"), action.alias("suggested_action"),
        cell(F.col("_meta.evidence_ref_index")).alias("evidence_ref_index"))


def review_source(graph: dict[str, DataFrame]) -> DataFrame:
    """All review rows with all 48 cells, plus the hidden columns the ledger reads."""
    rows = canonical_rows(graph).unionByName(rejected_rows(graph), allowMissingColumns=True)
    cells = []
    for name in REVIEW_FIELDS:
        if name in REVIEW_NUMERIC:
            cells.append(F.col(name).cast(REVIEW_NUMERIC[name]).alias(name))
        elif name in rows.columns:
            cells.append(cell(F.col(name)).alias(name))
        else:
            cells.append(F.lit("").alias(name))
    return rows.select(*cells, "row_table", "row_id", "_l1", "_l2", "_l3", "_bidder_class", "_relation_date")


def review_rows(graph: dict[str, DataFrame], review: DataFrame | None = None) -> DataFrame:
    """P1-P7 in review order: `position` is the 1-based place in the review of a run, with its id. `review`: its stored source."""
    rows = ordinal(review_source(graph) if review is None else review, RUN, ["_l1", "_l2"], [F.col("_l3")], "position")
    body = stable_json(F.struct(*sorted(REVIEW_FIELDS)))
    return rows.select(
        *REVIEW_FIELDS, "position", make_id("review_row", F.col("deal_slug"), F.col("run_id"), F.col("position"), body).alias("review_row_id"))
