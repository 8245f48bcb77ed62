"""Run state of deals: selection, skipping, upserts, verification."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.schemas import ALL_STATUSES, GRAPH_SCHEMA_VERSION, HISTORY_CAP, TRUSTED_STATUSES


def _pending(status: Column) -> Column:
    return status.isNull() | status.isin("", "pending")


def select_deals(progress: DataFrame, scope: str = "pending", slugs: DataFrame | None = None) -> DataFrame:
    """Explicit list, all, reference, targets, pending, or one status."""
    if slugs is not None:
        return progress.join(slugs.select("deal_slug").distinct(), "deal_slug", "left_semi")
    reference = F.coalesce("is_reference", F.lit(False))
    conditions = {"all": F.lit(True), "reference": reference, "targets": ~reference, "pending": _pending(F.col("status"))}
    return progress.filter(conditions.get(scope, F.col("status") == scope))


def unknown_slugs(progress: DataFrame, slugs: DataFrame) -> DataFrame:
    """Requested deals the state does not know."""
    return slugs.select("deal_slug").distinct().join(progress, "deal_slug", "left_anti")


def skip_plan(progress: DataFrame, rulebook_version: str, re_extract: bool = False) -> DataFrame:
    """What to do with each selected deal: skip, run or blocked, and why."""
    status = F.col("status")
    if re_extract:
        action, reason = F.lit("run"), F.lit("fresh extraction requested")
    else:
        blocked = ~_pending(status) & ~status.isin(*ALL_STATUSES)
        unchanged = F.coalesce(status.isin(*TRUSTED_STATUSES), F.lit(False)) & F.col("rulebook_version").eqNullSafe(F.lit(rulebook_version))
        action = F.when(blocked, "blocked").when(unchanged, "skip").otherwise("run")
        reason = (
            F.when(blocked, F.concat(F.lit("retired or unknown stored status="), status, F.lit("; rerun with --re-extract")))
            .when(unchanged, F.concat(F.lit("status="), status, F.lit(" rulebook unchanged")))
            .otherwise("pending, failure status, or stale rulebook"))
    return progress.select("deal_slug", action.alias("action"), reason.alias("reason"))


def failure_status(failed: DataFrame, progress: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """A failed deal with a prior trusted result becomes stale, any other fails.

    outputs(deal_slug): deals that still have an output; leave out where it need not exist.
    """
    rows = failed.join(progress.select("deal_slug", F.col("status").alias("_prior")), "deal_slug", "left")
    trusted = F.coalesce(F.col("_prior").isin(*TRUSTED_STATUSES), F.lit(False))
    if outputs is not None:
        rows = rows.join(outputs.select("deal_slug", F.lit(True).alias("_has")).distinct(), "deal_slug", "left")
        trusted = trusted & F.coalesce("_has", F.lit(False))
    return rows.withColumn("status", F.when(trusted, "stale_after_failure").otherwise("failed_system")).drop("_prior", "_has")


def capped_history(history: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """The last `cap` entries per deal, as an ordered array; the cap is the feature.

    history(deal_slug, ts, run_id, version). The row-number filter becomes a group limit before the
    shuffle, so a deal with a very long history sends at most `cap` entries per task.
    """
    newest = Window.partitionBy("deal_slug").orderBy(F.col("ts").desc(), F.col("run_id").desc())
    last = history.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= cap)
    return last.groupBy("deal_slug").agg(F.array_sort(F.collect_list(F.struct("ts", "run_id", "version"))).alias("rulebook_version_history"))


def upsert_progress(progress: DataFrame, batch: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """The state after a batch of finished runs (one per deal); unknown deals are created.

    batch(deal_slug, status, flag_count, notes, rulebook_version, last_run, run_id). Verification
    of a reference deal survives a trusted rerun. One full join on the deal.
    """
    b = batch.filter(F.col("status").isin(*ALL_STATUSES)).select(
        "deal_slug", F.lit(True).alias("_b"), *[F.col(c).alias(f"_{c}") for c in ("status", "flag_count", "notes", "rulebook_version", "last_run", "run_id")])
    rows = progress.withColumn("_known", F.lit(True)).join(b, "deal_slug", "full")
    ran = F.coalesce("_b", F.lit(False))
    kept = (
        ran & F.coalesce("is_reference", F.lit(False)) & F.col("_status").isin(*TRUSTED_STATUSES)
        & F.col("verification_report").isNotNull() & F.col("last_verified_by").isNotNull())
    take = lambda new, old: F.when(ran, F.col(new)).otherwise(F.col(old)).alias(old)
    entry = F.struct(F.col("_last_run").alias("ts"), F.col("_run_id").alias("run_id"), F.col("_rulebook_version").alias("version"))
    history = F.coalesce("rulebook_version_history", F.array().cast("array<struct<ts:string,run_id:string,version:string>>"))
    grown = F.concat(history, F.array(entry))
    capped = F.slice(grown, F.greatest(F.size(grown) - (cap - 1), F.lit(1)), cap)
    notes = F.when(kept, F.concat(F.col("_notes"), F.lit("; prior filing-grounded verification metadata preserved"))).otherwise(F.col("_notes"))
    changed = {
        "is_reference": F.coalesce("is_reference", F.lit(False)), "verified": F.when(kept, True).otherwise(F.col("verified")),
        "status": take("_status", "status"), "flag_count": take("_flag_count", "flag_count"), "last_run": take("_last_run", "last_run"),
        "last_run_id": take("_run_id", "last_run_id"), "rulebook_version": take("_rulebook_version", "rulebook_version"),
        "notes": F.when(ran, notes).otherwise(F.col("notes")), "rulebook_version_history": F.when(ran, capped).otherwise(history)}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in progress.columns])


def refused_updates(batch: DataFrame) -> DataFrame:
    """Batch rows whose status is not in the taxonomy; they are not written."""
    return batch.filter(~F.coalesce(F.col("status").isin(*ALL_STATUSES), F.lit(False)))


def verification_eligibility(progress: DataFrame, outputs: DataFrame, grounding_failures: DataFrame | None = None) -> DataFrame:
    """Q3: may a deal be marked verified, and if not the first reason.

    outputs(deal_slug, run_id, schema_version, hard_flags).
    """
    rows = progress.join(outputs.select(
        "deal_slug", F.col("run_id").alias("_run"), F.col("schema_version").alias("_schema"), F.col("hard_flags").alias("_hard"), F.lit(True).alias("_o")), "deal_slug", "left")
    if grounding_failures is not None:
        bad = grounding_failures.groupBy("deal_slug").agg(F.count(F.lit(1)).alias("_bad"))
        rows = rows.join(bad, "deal_slug", "left")
    else:
        rows = rows.withColumn("_bad", F.lit(None).cast("long"))
    current = F.col("last_run_id")
    reason = (
        F.when(F.col("_bad") > 0, "verification report failed checks").when(F.col("_o").isNull(), "missing extraction")
        .when(~F.coalesce("is_reference", F.lit(False)), "slug is not a reference deal")
        .when(~F.coalesce(F.col("status").isin(*TRUSTED_STATUSES), F.lit(False)), "status is not a trusted extraction status")
        .when(current.isNull() | (current == ""), "missing current run_id in progress")
        .when(~F.col("_run").eqNullSafe(current), "extraction run_id does not match progress last_run_id")
        .when(F.coalesce("_hard", F.lit(0)) > 0, F.concat(F.lit("hard flags: "), F.col("_hard")))
        .when(~F.col("_schema").eqNullSafe(F.lit(GRAPH_SCHEMA_VERSION)), F.lit(f"extraction schema_version is not {GRAPH_SCHEMA_VERSION}")))
    return rows.select("deal_slug", reason.isNull().alias("eligible"), reason.alias("reason"))


def mark_verified(progress: DataFrame, eligibility: DataFrame, reviewer: str, now: str, report_folder: str = "reference_verification") -> DataFrame:
    """Q3: stamp the eligible deals."""
    rows = progress.join(eligibility.filter("eligible").select("deal_slug", F.lit(True).alias("_e")), "deal_slug", "left")
    ok = F.coalesce("_e", F.lit(False))
    stamp = {
        "verified": F.lit(True), "last_verified_by": F.lit(reviewer), "last_verified_at": F.lit(now), "last_verified_run_id": F.col("last_run_id"),
        "verification_report": F.concat(F.lit(f"{report_folder}/"), F.col("deal_slug"), F.lit(".md"))}
    return rows.select(*[F.when(ok, stamp[c]).otherwise(F.col(c)).alias(c) if c in stamp else F.col(c) for c in progress.columns])


def status_issues(progress: DataFrame) -> DataFrame:
    """V10 as issues."""
    status = F.col("status")
    return progress.filter(status.isNotNull() & (status != "") & ~status.isin(*ALL_STATUSES)).select(
        "deal_slug", F.concat(F.lit("stored status "), status, F.lit(" is not in the live extraction taxonomy")).alias("message"))

