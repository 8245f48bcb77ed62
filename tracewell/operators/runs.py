"""Per-run and per-pool aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.text import blank_to_null, instant
from tracewell.schemas import (
    ALL_STATUSES, FAILURE_STATUSES, GRAPH_SCHEMA_VERSION, LATEST_SCHEMA_VERSION, RUN_SCHEMA_VERSION, TRUSTED_STATUSES, VALIDATION_SCHEMA_VERSION)

RUN = ["deal_slug", "run_id"]


def status_of_burden(burden: Column) -> Column:
    return F.when(burden == 0, "passed_clean").when(burden <= 10, "needs_review").otherwise("high_burden")


def burden_status(runs: DataFrame, review: DataFrame, validation_flags: DataFrame | None = None) -> DataFrame:
    """Review burden and status of every run; hard flags fail it."""
    burden = review.groupBy(*RUN).agg(F.count_if(F.col("review_status") != "clean").alias("review_burden"))
    rows = runs.select(*RUN).join(burden, RUN, "left").withColumn("review_burden", F.coalesce("review_burden", F.lit(0)))
    if validation_flags is not None:
        hard = validation_flags.filter("severity = 'hard'").groupBy(*RUN).agg(
            F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("_codes"))
        rows = rows.join(hard, RUN, "left")
    else:
        rows = rows.withColumn("_codes", F.lit(None).cast("string"))
    failed = F.col("_codes").isNotNull()
    return rows.select(
        *RUN, F.when(failed, "failed_system").otherwise(status_of_burden(F.col("review_burden"))).alias("status"),
        F.when(failed, 0).otherwise(F.col("review_burden")).alias("flag_count"),
        F.when(failed, F.concat(F.lit("graph integrity validation failed: "), F.col("_codes"))).otherwise(
            F.concat(F.lit("review_burden="), F.col("review_burden"))).alias("notes"))


def severity(value: Column) -> Column:
    """A4: blocking counts as hard, and so does anything unknown."""
    return F.when(value.isin("hard", "soft", "info"), value).otherwise("hard")


def count_flags(runs: DataFrame, deal_flags: DataFrame, graph_flags: DataFrame) -> DataFrame:
    """A4: hard/soft/info counts per run from the deal's flags, or from the graph's where a run has none."""
    def tally(flags: DataFrame, prefix: str) -> DataFrame:
        s = severity(F.col("severity"))
        return flags.groupBy(*RUN).agg(*[F.count_if(s == k).alias(f"{prefix}{k}") for k in ("hard", "soft", "info")])

    rows = runs.select(*RUN).join(tally(deal_flags, "d_"), RUN, "left").join(tally(graph_flags, "g_"), RUN, "left")
    return rows.select(*RUN, *[F.coalesce(f"d_{k}", F.when(F.col("d_hard").isNull(), F.col(f"g_{k}")), F.lit(0)).alias(k) for k in ("hard", "soft", "info")])


def distinct_flags(*sources: DataFrame) -> DataFrame:
    """Union of flag sources, exact duplicates within a run removed."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.distinct()


def flag_matrix(flags: DataFrame) -> DataFrame:
    """A5: counts per run, severity and code."""
    word = lambda n: F.coalesce(blank_to_null(F.col(n)), F.lit("unknown")).alias(n)
    return flags.select(*RUN, word("severity"), word("code")).groupBy(*RUN, "severity", "code").agg(F.count(F.lit(1)).alias("flags"))


LOCATION = ("claim_id", "claim_type", "event_id", "actor_id", "coverage_obligation_id", "citation_unit_id", "row_index")
# Info codes that still say something about structure (fixed values).
STRUCTURAL_INFO = (
    "date_phrase_unmapped", "rough_date_mismatch", "source_quote_page_mismatch", "source_quote_not_substring", "source_quote_missing")


def flag_identity(columns: list[str]) -> Column:
    """`location:code` of a flag."""
    parts = [blank_to_null(F.col(c).cast("string")) for c in LOCATION if c in columns]
    where = F.concat_ws("|", *parts) if parts else F.lit("")
    return F.concat(F.coalesce(F.nullif(where, F.lit("")), F.lit("graph")), F.lit(":"), F.coalesce(blank_to_null(F.col("code")), F.lit("unknown")))


def hard_flag_identities(flags: DataFrame) -> DataFrame:
    """A7 in long form: each identity of a run and how often it occurs (sorted by the reader)."""
    return flags.filter("severity = 'hard'").groupBy(*RUN, flag_identity(flags.columns).alias("identity")).agg(F.count(F.lit(1)).alias("times"))


def structural_flags(matrix: DataFrame) -> DataFrame:
    """A8."""
    return matrix.filter(F.col("severity").isin("hard", "soft") | F.col("code").isin(*STRUCTURAL_INFO))


def info_flags(matrix: DataFrame) -> DataFrame:
    return matrix.filter("severity = 'info'")


def validation_summary(runs: DataFrame, flags: DataFrame) -> DataFrame:
    """One validation record per run; runs(deal_slug, run_id, status, flag_count)."""
    counts = flags.groupBy(*RUN).agg(*[F.count_if(F.col("severity") == k).alias(f"{k}_count") for k in ("hard", "soft", "info")])
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return runs.join(counts, RUN, "left").select(
        F.lit(VALIDATION_SCHEMA_VERSION).alias("schema_version"), *RUN, F.col("status").alias("final_status"), "flag_count",
        *[zero(f"{k}_count") for k in ("hard", "soft", "info")])


def latest_pointer(runs: DataFrame) -> DataFrame:
    """The newest run of every deal with its artifact paths; a maximum, not a sort.

    runs(deal_slug, run_id, finished_at, outcome, stability_eligible, has_raw_response, has_validation).
    """
    newest = runs.groupBy("deal_slug").agg(F.max(F.struct(
        "finished_at", "run_id", "outcome", "stability_eligible", "has_raw_response", "has_validation")).alias("r"))
    path = lambda name: F.concat(F.lit("runs/"), F.col("r.run_id"), F.lit(f"/{name}"))
    return newest.select(
        F.lit(LATEST_SCHEMA_VERSION).alias("schema_version"), F.col("deal_slug").alias("slug"), F.col("r.run_id").alias("run_id"),
        F.col("r.outcome").alias("outcome"), F.col("r.stability_eligible").alias("stability_eligible"), path("manifest.json").alias("manifest_path"),
        F.when(F.col("r.has_raw_response"), path("raw_response.json")).alias("raw_response_path"),
        F.when(F.col("r.has_validation"), path("validation.json")).alias("validation_path"))


def latest_runs(runs: DataFrame, count: int) -> DataFrame:
    """The latest `count` runs per deal by (finished_at, run_id); deals with fewer have none.

    `count` is the feature. Adds recency and eligible_runs. The row-number filter becomes a group
    limit before the shuffle, so a deal with very many runs sends only `count` rows per task.
    """
    totals = runs.groupBy("deal_slug").agg(F.count(F.lit(1)).alias("eligible_runs"))
    newest_first = Window.partitionBy("deal_slug").orderBy(F.col("finished_at").desc(), F.col("run_id").desc())
    rows = runs.withColumn("recency", F.row_number().over(newest_first)).filter(F.col("recency") <= count)
    return rows.join(totals, "deal_slug").filter(F.col("eligible_runs") >= count)


def call_summary(calls: DataFrame) -> DataFrame:
    """Attempts, watchdog warnings, first extract prompt hash and token totals per run.

    calls(deal_slug, run_id, pos, phase, prompt_hash, attempts, warnings, *_tokens).
    """
    usable = (F.col("phase") == "extract") & (F.coalesce("prompt_hash", F.lit("")) != "")
    total = lambda n, out: F.coalesce(F.sum(n), F.lit(0)).alias(out)
    return calls.groupBy(*RUN).agg(
        total("attempts", "total_attempts"), total("warnings", "watchdog_warnings"),
        F.min(F.when(usable, F.struct("pos", "prompt_hash")))["prompt_hash"].alias("prompt_hash"),
        total("input_tokens", "total_input_tokens"), total("output_tokens", "total_output_tokens"), total("reasoning_tokens", "total_reasoning_tokens"))


def pool_summary(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """outcomes(status, skipped) -> counts, every status spelled out."""
    status = F.col("status")
    return outcomes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(status.isin(*TRUSTED_STATUSES)).alias("succeeded"),
        F.count_if(F.col("skipped")).alias("skipped"), F.count_if(status.isin(*FAILURE_STATUSES)).alias("failed"),
        *[F.count_if(status == s).alias(s) for s in ALL_STATUSES])


def run_manifests(runs: DataFrame, summary: DataFrame) -> DataFrame:
    """The manifest record of every run: what ran, under which contracts and hashes, at what cost, how it ended.

    runs(deal_slug, run_id, started_at, finished_at, action, outcome, stability_eligible, error, and the seven
    values of the configuration); times are stamps (F35). summary: `call_summary`; a run without a call has
    zero totals, no prompt hash and an empty map of them. Seconds are whole, null if a stamp is missing.
    """
    totals = ("total_input_tokens", "total_output_tokens", "total_reasoning_tokens", "total_attempts", "watchdog_warnings")
    extract = lambda name: F.create_map(F.lit("extract"), F.col(name))
    return runs.join(summary, RUN, "left").select(
        F.lit(RUN_SCHEMA_VERSION).alias("schema_version"), F.col("deal_slug").alias("slug"), "run_id", "started_at", "finished_at", "action",
        "rulebook_version", "extractor_contract_version", "schema_hash", "prompt_hash",
        F.when(F.col("prompt_hash").isNull(), F.create_map().cast("map<string,string>")).otherwise(extract("prompt_hash")).alias("prompt_hashes"),
        "llm_backend", extract("extract_model").alias("models"), "api_endpoint", extract("reasoning_effort").alias("reasoning_efforts"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in totals],
        (instant("finished_at") - instant("started_at")).alias("total_seconds"), "outcome", "stability_eligible", "error")


def output_records(status: DataFrame, flags: DataFrame, runs: DataFrame) -> DataFrame:
    """The header record of every finished run; a run that hard flags failed has none.

    status: `burden_status`; flags(deal_slug, run_id, severity, code); runs(deal_slug, run_id, finished_at,
    rulebook_version). deal_flags: number of flags per code and severity, in that order, so one entry per
    code however many flags a run has; the flags themselves are the flag table.
    """
    kinds = flags.groupBy(*RUN, F.coalesce("code", F.lit("unknown")).alias("code"), severity(F.col("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    lists = kinds.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("code", "severity", "n"))).alias("deal_flags"))
    done = status.filter("status <> 'failed_system'").join(runs.select(*RUN, "finished_at", "rulebook_version"), RUN).join(lists, RUN, "left")
    empty = F.array().cast("array<struct<code:string,severity:string,n:bigint>>")
    return done.select(
        F.lit(GRAPH_SCHEMA_VERSION).alias("schema_version"), *RUN, F.col("finished_at").alias("last_run"), F.col("run_id").alias("last_run_id"),
        "rulebook_version", "status", "flag_count", "notes", F.coalesce("deal_flags", empty).alias("deal_flags"))
