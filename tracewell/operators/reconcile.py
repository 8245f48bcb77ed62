"""Comparing the stores of a deal: state, output, flag log, archive.

Every check is a keyed outer join of two stores with a list of conditions; each condition that
holds is one issue row. Nothing raises: the issues are the result.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.operators.claims import is_claim_payload
from tracewell.operators.runs import status_of_burden
from tracewell.operators.stability import RETIRED_FIELDS
from tracewell.schemas import (
    ALL_STATUSES, FAILURE_STATUSES, GRAPH_SCHEMA_VERSION, LATEST_SCHEMA_VERSION, PROGRESS_SCHEMA_VERSION, RAW_RESPONSE_SCHEMA_VERSION,
    RUN_SCHEMA_VERSION, TRUSTED_STATUSES, VALIDATION_SCHEMA_VERSION)


def issue(condition: Column, code: str, message: Column | str, severity: str = "error") -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.alias("message")))


def issues(rows: DataFrame, *checks: Column) -> DataFrame:
    found = rows.select("deal_slug", F.explode(F.array_compact(F.array(*checks))).alias("_i"))
    return found.select("deal_slug", "_i.severity", "_i.code", "_i.message")


def differs(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def progress_header_issues(state: DataFrame) -> DataFrame:
    """Schema and stale-key issues of the state file; state(schema_version, rulebook_version, deals_present)."""
    rows = state.withColumn("deal_slug", F.lit(None).cast("string"))
    return issues(
        rows, issue(differs(F.col("schema_version"), F.lit(PROGRESS_SCHEMA_VERSION)), "progress_schema", "state schema_version must be v1"),
        issue(F.col("rulebook_version").isNotNull(), "progress_stale_rulebook_pin", "state must not contain a top-level rulebook_version"),
        issue(~F.col("deals_present"), "progress_deals_missing", "state deals must be an object"))


def membership_issues(progress: DataFrame, references: DataFrame) -> DataFrame:
    """Reference membership, verified targets, status taxonomy."""
    seen = references.select("deal_slug").distinct().join(
        progress.select("deal_slug", "is_reference", F.lit(True).alias("_known")), "deal_slug", "left")
    named = lambda text: F.concat(F.lit("reference slug "), F.col("deal_slug"), F.lit(text))
    refs = issues(
        seen, issue(F.col("_known").isNull(), "missing_reference_slug", named(" is missing from the state")),
        issue(F.col("_known") & ~F.coalesce("is_reference", F.lit(False)), "reference_not_marked", named(" is not marked is_reference=true")))
    status = F.col("status")
    own = issues(
        progress,
        issue(~F.coalesce("is_reference", F.lit(False)) & F.coalesce("verified", F.lit(False)), "target_verified",
              "target deals must not carry verified reference metadata"),
        issue(status.isNotNull() & (status != "") & ~status.isin(*ALL_STATUSES), "status_taxonomy",
              F.concat(F.lit("stored status "), status, F.lit(" is not in the live extraction taxonomy"))))
    return refs.unionByName(own)


def missing_slugs(progress: DataFrame, slugs: DataFrame) -> DataFrame:
    lost = slugs.select("deal_slug").distinct().join(progress, "deal_slug", "left_anti")
    return issues(lost, issue(F.lit(True), "slug_missing", F.concat(F.lit("slug "), F.col("deal_slug"), F.lit(" is not present in the state"))))


def output_issues(progress: DataFrame, outputs: DataFrame) -> DataFrame:
    """R2: output against state.

    outputs(deal_slug, schema_version, has_deal, run_id, last_run, rulebook_version, review_burden,
    has_estimator, has_jsonl, has_csv); review_burden is null where review rows are missing.
    """
    o = outputs.select("deal_slug", F.lit(True).alias("_out"), *[F.col(c).alias(f"o_{c}") for c in outputs.columns if c != "deal_slug"])
    rows = progress.join(o, "deal_slug", "left")
    status, have = F.col("status"), F.coalesce("_out", F.lit(False))
    failed = F.coalesce(status == "failed_system", F.lit(False))
    body = ~failed & have & F.coalesce("o_has_deal", F.lit(True))
    stale = body & F.coalesce(status == "stale_after_failure", F.lit(False))
    live = body & ~stale
    same_run = F.col("o_run_id").eqNullSafe(F.col("last_run_id"))
    # a burden can only be recomputed from complete output
    complete = F.col("o_schema_version").eqNullSafe(F.lit(GRAPH_SCHEMA_VERSION)) & F.col("o_review_burden").isNotNull()
    expected = F.when(complete, status_of_burden(F.col("o_review_burden"))).otherwise("failed_system")
    count = F.when(complete, F.col("o_review_burden")).otherwise(0)
    return issues(
        rows,
        issue(failed & have, "failure_output_present", "failed_system must not leave a trusted latest extraction output"),
        issue(~failed & ~have, "missing_output", F.concat(F.lit("latest output is missing for status="), F.coalesce(status, F.lit("None")))),
        issue(~failed & have & ~F.coalesce("o_has_deal", F.lit(True)), "output_deal_missing", "output deal object is missing"),
        issue(body & differs(F.col("o_schema_version"), F.lit(GRAPH_SCHEMA_VERSION)), "output_schema", f"latest output schema_version must be {GRAPH_SCHEMA_VERSION}"),
        issue(body & F.coalesce("o_has_estimator", F.lit(False)), "estimator_output_present", "trusted extraction output must not contain estimation_bidder_rows"),
        issue(body & F.col("o_review_burden").isNull(), "review_rows_missing", "latest output must contain review_rows"),
        issue(stale & same_run, "reference_artifact_stale", "stale_after_failure must point progress at the failed run while output remains from a prior trusted run"),
        issue(stale & ~same_run, "reference_artifact_stale", "latest trusted output is stale because the newest run failed", "warning"),
        issue(live & ~same_run, "run_id_mismatch", "output last_run_id must match progress last_run_id"),
        issue(live & differs(F.col("o_last_run"), F.col("last_run")), "last_run_mismatch", "output last_run must match progress last_run"),
        issue(live & differs(F.col("o_rulebook_version"), F.col("rulebook_version")), "rulebook_version_mismatch", "output rulebook_version must match progress"),
        issue(live & differs(count, F.col("flag_count")), "flag_count_mismatch", F.concat(
            F.lit("progress flag_count="), F.coalesce(F.col("flag_count").cast("string"), F.lit("None")), F.lit(" but output has "), count)),
        issue(live & differs(expected, status), "status_mismatch", F.concat(
            F.lit("progress status="), F.coalesce(status, F.lit("None")), F.lit(" but output flags imply "), expected)),
        issue(live & ~F.coalesce("o_has_jsonl", F.lit(False)), "review_jsonl_missing", "trusted status requires the review rows file"),
        issue(live & ~F.coalesce("o_has_csv", F.lit(False)), "review_csv_missing", "trusted status requires the review csv file"))


def latest_issues(progress: DataFrame, latest: DataFrame, outputs: DataFrame) -> DataFrame:
    """The latest pointer against state and output.

    latest(deal_slug, schema_version, slug, run_id, outcome, stability_eligible, manifest_path,
    raw_response_path, validation_path, has_final_output_path).
    """
    pointer = latest.select("deal_slug", F.lit(True).alias("_l"), *[F.col(c).alias(f"l_{c}") for c in latest.columns if c != "deal_slug"])
    rows = progress.filter(F.col("status").isin(*ALL_STATUSES)).join(pointer, "deal_slug", "left").join(
        outputs.select("deal_slug", F.lit(True).alias("_out"), F.col("run_id").alias("o_run_id")), "deal_slug", "left")
    status, have = F.col("status"), F.coalesce("_l", F.lit(False))
    trusted, run = status.isin(*TRUSTED_STATUSES), F.col("l_run_id")
    named = have & run.isNotNull() & (run != "")
    off_path = lambda key, name: named & F.col(key).isNotNull() & (F.col(key) != F.concat(F.lit("runs/"), run, F.lit(f"/{name}")))
    return issues(
        rows, issue(~have, "missing_latest_audit", "latest audit pointer is missing or unreadable"),
        issue(have & differs(F.col("l_schema_version"), F.lit(LATEST_SCHEMA_VERSION)), "audit_latest_schema", f"latest schema_version must be {LATEST_SCHEMA_VERSION}"),
        issue(have & differs(F.col("l_slug"), F.col("deal_slug")), "audit_latest_slug_mismatch", "latest slug does not match its deal"),
        issue(have & differs(run, F.col("last_run_id")), "audit_latest_run_id_mismatch", "latest audit run_id must match progress last_run_id"),
        issue(have & trusted & F.coalesce("_out", F.lit(False)) & differs(run, F.col("o_run_id")), "audit_latest_run_id_mismatch",
              "trusted latest audit run_id must match output last_run_id"),
        issue(have & (status == "stale_after_failure") & F.col("o_run_id").eqNullSafe(F.col("last_run_id")), "reference_artifact_stale",
              "stale_after_failure must leave a prior trusted output in place, not refresh it"),
        issue(named & differs(F.col("l_outcome"), status), "audit_outcome_mismatch", F.concat(
            F.lit("latest outcome="), F.coalesce("l_outcome", F.lit("None")), F.lit(" must match progress status="), status)),
        issue(named & status.isin(*FAILURE_STATUSES) & differs(F.col("l_stability_eligible"), F.lit(False)), "failed_stability_eligible",
              "failure runs must have stability_eligible=false"),
        issue(named & trusted & differs(F.col("l_stability_eligible"), F.lit(True)), "trusted_stability_ineligible",
              "trusted extraction runs must have stability_eligible=true"),
        *[issue(off_path(f"l_{k}", n), "audit_path_not_archived", F.concat(F.lit(f"latest {k} must be runs/"), run, F.lit(f"/{n}")))
          for k, n in (("manifest_path", "manifest.json"), ("raw_response_path", "raw_response.json"), ("validation_path", "validation.json"))],
        issue(named & F.col("l_manifest_path").isNull(), "audit_manifest_missing", "latest must reference the run manifest"),
        issue(named & F.coalesce("l_has_final_output_path", F.lit(False)), "audit_latest_retired_field", "latest must not reference retired graph-output pointers"),
        *[issue(named & trusted & F.col(f"l_{k}").isNull(), "audit_required_file_missing", f"finalized run latest must reference {k}")
          for k in ("raw_response_path", "validation_path")])


def file_issues(latest: DataFrame, files: DataFrame) -> DataFrame:
    """Files the pointer references. files(deal_slug, run_id, name, slug, schema_version)."""
    expected = {"manifest.json": RUN_SCHEMA_VERSION, "raw_response.json": RAW_RESPONSE_SCHEMA_VERSION, "validation.json": VALIDATION_SCHEMA_VERSION}
    wanted = latest.select("deal_slug", F.col("run_id"), F.explode(F.array_compact(F.array(*[
        F.when(F.col(k).isNotNull(), F.struct(F.lit(n).alias("name"), F.lit(expected[n]).alias("wanted")))
        for k, n in (("manifest_path", "manifest.json"), ("raw_response_path", "raw_response.json"), ("validation_path", "validation.json"))]))).alias("w"))
    rows = wanted.select("deal_slug", "run_id", "w.name", "w.wanted").join(
        files.select("deal_slug", "run_id", "name", F.col("slug").alias("f_slug"), F.col("schema_version").alias("f_schema"), F.lit(True).alias("_f")),
        ["deal_slug", "run_id", "name"], "left")
    have = F.coalesce("_f", F.lit(False))
    return issues(
        rows, issue(~have, "audit_referenced_file_missing", F.concat(F.col("name"), F.lit(" is referenced but unreadable"))),
        issue(have & differs(F.col("f_slug"), F.col("deal_slug")), "audit_file_identity_mismatch", F.concat(F.col("name"), F.lit(" slug does not match latest"))),
        issue(have & differs(F.col("f_schema"), F.col("wanted")), "audit_file_schema", F.concat(F.col("name"), F.lit(" schema_version must be "), F.col("wanted"))))


def artifact_issues(progress: DataFrame, artifacts: DataFrame, root_entries: DataFrame | None = None) -> DataFrame:
    """Artifacts of trusted runs, and entries that do not belong in an archive root.

    artifacts(deal_slug, run_id, name); root_entries(deal_slug, name).
    """
    trusted = progress.filter(F.col("status").isin(*TRUSTED_STATUSES)).select("deal_slug", F.col("last_run_id").alias("run_id"))
    wanted = {"deal_graph_v2.json": "graph_snapshot_missing", "deal_graph.duckdb": "graph_database_missing"}
    due = trusted.select("*", F.explode(F.array(*[F.lit(n) for n in wanted])).alias("name"))
    lost = due.join(artifacts.select("deal_slug", "run_id", "name"), ["deal_slug", "run_id", "name"], "left_anti")
    out = issues(lost, *[issue(F.col("name") == n, code, f"trusted run must contain {n}") for n, code in wanted.items()])
    if root_entries is not None:
        odd = root_entries.filter(~F.col("name").isin("latest.json", "runs"))
        out = out.unionByName(issues(odd, issue(F.lit(True), "unexpected_audit_root_entry", F.concat(
            F.lit("archive root may contain only latest.json and runs/: "), F.col("name")))))
    return out


def contract_issues(progress: DataFrame, manifests: DataFrame, raws: DataFrame) -> DataFrame:
    """Manifest and raw response against the state; both given as JSON text.

    manifests(deal_slug, manifest), raws(deal_slug, raw): those of the latest run.
    """
    rows = progress.select("deal_slug", "rulebook_version").join(manifests.select("deal_slug", "manifest"), "deal_slug", "left").join(
        raws.select("deal_slug", "raw"), "deal_slug", "left")
    m, r = F.col("manifest"), F.col("raw")
    keys = F.coalesce(F.json_object_keys(m), F.array().cast("array<string>"))
    get = lambda text, name: F.get_json_object(text, f"$.{name}")
    rules, contract = F.col("rulebook_version"), get(m, "extractor_contract_version")
    ruled = F.coalesce(rules != "", F.lit(False))
    checks = [
        issue(m.isNotNull() & F.array_contains(keys, RETIRED_FIELDS[0]), "audit_manifest_stale_field", "manifest must not contain retired structured-output fallback fields"),
        *[issue(m.isNotNull() & F.array_contains(keys, f), "audit_manifest_retired_field", f"manifest must not contain retired {f}") for f in RETIRED_FIELDS[1:]],
        *[issue(get(m, f"{n}.adjudicate").isNotNull(), "audit_manifest_retired_field", f"manifest {n} must not contain retired adjudicate entry") for n in ("models", "reasoning_efforts")],
        issue(m.isNotNull() & (F.coalesce(contract, F.lit("")) == ""), "audit_manifest_contract_missing", "manifest missing required extractor_contract_version"),
        issue(m.isNotNull() & ruled & differs(get(m, "rulebook_version"), rules), "rulebook_version_mismatch", "manifest rulebook_version must match progress"),
        issue(r.isNotNull() & ~is_claim_payload(get(r, "parsed_json")), "raw_response_shape", "raw response must use the live claim-only payload"),
        issue(r.isNotNull() & ruled & differs(get(r, "rulebook_version"), rules), "rulebook_version_mismatch", "raw response rulebook_version must match progress"),
        issue(r.isNotNull() & m.isNotNull() & differs(get(r, "extractor_contract_version"), contract), "extractor_contract_version_mismatch",
              "raw response extractor_contract_version must match manifest")]
    return issues(rows, *checks)


def flag_differences(output_flags: DataFrame, logged_flags: DataFrame, key: list[str]) -> DataFrame:
    """Flags whose number of copies differs between output and log (multiset comparison).

    Both sides are counted and added up in one aggregation: no sort, no pairs, no exceptAll.
    """
    side = lambda df, a, b: df.select(*key, F.lit(a).alias("_o"), F.lit(b).alias("_l"))
    both = side(output_flags, 1, 0).unionByName(side(logged_flags, 0, 1))
    return both.groupBy(*key).agg(F.sum("_o").alias("in_output"), F.sum("_l").alias("in_log")).filter("in_output <> in_log")


def flag_log_issues(output_flags: DataFrame, log: DataFrame, progress: DataFrame) -> DataFrame:
    """The log's entries of the latest run must equal the output's flags.

    log carries deal_slug, run_id, logged_at and the flag columns; those three are not compared.
    """
    flag = [c for c in output_flags.columns if c not in ("deal_slug", "run_id", "logged_at")]
    current = log.join(progress.select("deal_slug", F.col("last_run_id").alias("run_id"), F.col("last_run").alias("logged_at")), ["deal_slug", "run_id", "logged_at"], "left_semi")
    body = F.to_json(F.struct(*sorted(flag)), {"ignoreNullFields": "false"}).alias("flag")
    live = output_flags.join(progress.filter(F.col("status").isin(*TRUSTED_STATUSES)).select("deal_slug"), "deal_slug", "left_semi")
    odd = flag_differences(live.select("deal_slug", body), current.select("deal_slug", body), ["deal_slug", "flag"])
    return issues(odd.select("deal_slug").distinct(), issue(F.lit(True), "flags_jsonl_mismatch", "flag log entries of the latest run must match output flags"))


def summary(all_issues: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: ok, errors, warnings, deals checked."""
    counts = all_issues.agg(F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
    deals = checked.agg(F.count_distinct("deal_slug").alias("n")).scalar()
    return counts.select((F.col("error_count") == 0).alias("ok"), "error_count", "warning_count", deals.alias("checked_slugs"))


def reconcile(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
