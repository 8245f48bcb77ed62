"""Integrity flags of a graph (Q1, J15, J16, V9): each check finds rows that lack their partner."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.schemas import GRAPH_SCHEMA_VERSION, SUPPORTED_DISPOSITIONS

RUN = ["deal_slug", "run_id"]
CANONICAL_ROWS = {
    "actors": "actor_id", "actor_relations": "relation_id", "events": "event_id", "participation_counts": "participation_count_id",
}


def is_current(df: DataFrame) -> Column:
    """V9: rows without the column, or with null, count as current."""
    return F.coalesce(F.col("current"), F.lit(True)) if "current" in df.columns else F.lit(True)


def _flag(df: DataFrame, code: str, reason: Column | str, table: Column | str | None, row_id: Column | None) -> DataFrame:
    text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return df.select(
        *RUN, F.lit(code).alias("code"), F.lit("hard").alias("severity"), text(reason).alias("reason"),
        text(table).alias("row_table"), (row_id if row_id is not None else F.lit(None).cast("string")).alias("row_id"))


def schema_flags(headers: DataFrame) -> DataFrame:
    wrong = headers.filter(~F.col("schema_version").eqNullSafe(F.lit(GRAPH_SCHEMA_VERSION)))
    return _flag(wrong, "DG_SCHEMA_VERSION", f"Canonical graph snapshot must declare schema_version={GRAPH_SCHEMA_VERSION}.", None, None)


def claim_checks(claims: DataFrame, dispositions: DataFrame, evidence: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per claim what is linked to it. One union and one aggregation instead of three joins,
    so map-side combine absorbs claims with very many links."""
    given = lambda value, kind: F.lit(None).cast(kind) if value is None else value

    def side(df: DataFrame, is_claim=None, obligation=None, disposition=None, evid=None, cover=None) -> DataFrame:
        return df.select(
            *RUN, "claim_id", given(is_claim, "int").alias("is_claim"), given(obligation, "string").alias("obligation"),
            given(disposition, "string").alias("disposition"), given(evid, "int").alias("evid"), given(cover, "int").alias("cover"))

    one = F.lit(1)
    parts = [
        side(claims, is_claim=one, obligation=F.col("coverage_obligation_id")),
        side(dispositions.filter(is_current(dispositions)), disposition=F.coalesce("disposition", F.lit(""))),
        side(evidence, evid=one), side(coverage, cover=one)]
    grouped = reduce(DataFrame.unionByName, parts).groupBy(*RUN, "claim_id").agg(
        F.count("is_claim").alias("n_claim"), F.max("obligation").alias("obligation"),
        F.count("disposition").alias("n_disp"), F.max("disposition").alias("disposition"),
        F.count("evid").alias("n_evid"), F.count("cover").alias("n_cover"))
    single = F.when(F.col("n_disp") == 1, F.col("disposition"))
    return grouped.filter("n_claim > 0").withColumn("disposition", single)


def integrity_flags(graph: dict[str, DataFrame], headers: DataFrame | None = None, obligations: DataFrame | None = None) -> DataFrame:
    """Q1: all hard flags. A run with any must not be released."""
    checks = claim_checks(graph["claims"], graph["claim_dispositions"], graph["claim_evidence"], graph["claim_coverage_links"])
    claim = F.col("claim_id")
    supported = F.col("disposition").isin(*SUPPORTED_DISPOSITIONS)
    needs = F.col("disposition").isNull() | supported
    has_obligation = F.col("obligation").isNotNull() & (F.col("obligation") != "")
    problem = lambda cond, code, reason: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason")))
    found = F.array_compact(F.array(
        problem(F.col("n_disp") != 1, "DG_CLAIM_DISPOSITION_MISSING", "Every claim must have exactly one current disposition."),
        problem(needs & (F.col("n_evid") == 0), "DG_CLAIM_EVIDENCE_MISSING", "Every claim must link to source evidence."),
        problem(needs & has_obligation & (F.col("n_cover") == 0), "DG_CLAIM_COVERAGE_LINK_MISSING",
                "Claims emitted for an obligation must link back to that obligation.")))
    claim_rows = checks.select(*RUN, "claim_id", F.explode(found).alias("p")).select(
        *RUN, F.col("p.code").alias("code"), F.lit("hard").alias("severity"), F.col("p.reason").alias("reason"),
        F.lit("claims").alias("row_table"), claim.alias("row_id"))

    due = checks.filter(supported & has_obligation).select(*RUN, F.col("obligation").alias("obligation_id"))
    if obligations is not None:
        open_ = obligations.filter(is_current(obligations) & (F.coalesce("applicability", F.lit("applicable")) == "applicable"))
        due = due.unionByName(open_.select(*RUN, "obligation_id"))
    results = graph["coverage_results"]
    results = results.filter(is_current(results)).select(*RUN, "obligation_id", F.lit(0).alias("due"), F.lit(1).alias("given"))
    covered = due.select("*", F.lit(1).alias("due"), F.lit(0).alias("given")).unionByName(results).groupBy(*RUN, "obligation_id").agg(
        F.max("due").alias("due"), F.sum("given").alias("given"))
    coverage_rows = _flag(
        covered.filter("due = 1 and given <> 1"), "DG_COVERAGE_RESULT_MISSING",
        "Every current applicable obligation must have exactly one current coverage result.", "coverage_obligations", F.col("obligation_id"))

    rows = reduce(DataFrame.unionByName, [
        graph[t].select(*RUN, F.lit(t).alias("row_table"), F.col(i).alias("row_id")) for t, i in CANONICAL_ROWS.items()])
    unproven = rows.filter("row_id is not null").join(graph["row_evidence"].select(*RUN, "row_table", "row_id"), RUN + ["row_table", "row_id"], "left_anti")
    row_rows = _flag(
        unproven, "DG_ROW_EVIDENCE_MISSING", F.concat(F.lit("Canonical "), F.col("row_table"), F.lit(" row must link to source evidence.")),
        F.col("row_table"), F.col("row_id"))

    links = graph["event_actor_links"]
    orphan = lambda table, key, what: _flag(
        links.join(graph[table].select(*RUN, key), RUN + [key], "left_anti"), "DG_EVENT_LINK_ORPHAN",
        f"Event actor link references a missing {what}.", "event_actor_links", F.col("link_id"))
    parts = [claim_rows, coverage_rows, row_rows, orphan("events", "event_id", "event"), orphan("actors", "actor_id", "actor")]
    if headers is not None:
        parts.append(schema_flags(headers))
    return reduce(DataFrame.unionByName, parts)
