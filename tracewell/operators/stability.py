"""Comparing repeated runs of the same deal."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.hashing import digest
from tracewell.functions.text import bid_state, blank_to_null, has_text, is_anonymous_alias, is_cohort_alias, normal_text, row_fingerprint
from tracewell.operators.runs import latest_runs
from tracewell.schemas import (
    FAILURE_STATUSES, GRAPH_SCHEMA_VERSION, MAX_QUOTE_CHARS, PROOF_SCHEMA_VERSION, RUN_SCHEMA_VERSION, TRUSTED_STATUSES)

RUN = ["deal_slug", "run_id"]
CONFIG = ("model", "reasoning_effort", "provider", "prompt_hash", "schema_hash", "rulebook_version", "extractor_contract_version")
TABLE_METRICS = (
    "actors", "actor_relations", "claims", "claim_dispositions", "coverage_results", "events", "event_actor_links", "participation_counts")
# metric column -> what its change is called; order is the order of the reasons (fixed values)
COMPARED = {
    "graph_table_counts": "graph table counts changed", "event_subtype_counts": "event subtype counts changed",
    "actor_kind_counts": "actor kind counts changed", "relation_type_counts": "relation type counts changed",
    "claim_type_counts": "claim type counts changed", "claim_disposition_counts": "claim disposition counts changed",
    "coverage_result_counts": "coverage result counts changed", "anonymous_placeholder_count": "anonymous placeholder counts changed",
    "cohort_like_placeholder_count": "cohort-like placeholder counts changed", "date_diagnostics": "date diagnostics changed",
    "bid_value_representation": "bid-value representation changed", "quote_diagnostics": "quote diagnostics changed",
}
STABLE = "STABLE_FOR_REFERENCE_REVIEW"
UNSTABLE = "UNSTABLE_RULE_OR_VALIDATOR_FIX_NEEDED"
ESCALATE = "UNSTABLE_ARCHITECTURE_ESCALATION_CANDIDATE"
INSUFFICIENT = "INSUFFICIENT_ARCHIVED_RUNS"
RETIRED_FIELDS = (
    "json_schema_used", "tools_contract_version", "repair_loop_contract_version", "obligation_contract_version",
    "repair_turns_used", "repair_loop_outcome", "tool_calls_count")


# ---- archive contract ----------------------------------------------------------------
def manifest_problems(manifests: DataFrame, raw: str = "manifest") -> DataFrame:
    """Contract issues of run manifests given as JSON text; manifests(deal_slug, run_id, manifest)."""
    text = F.col(raw)
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    get = lambda path: F.get_json_object(text, f"$.{path}")
    problem = lambda cond, msg: F.when(cond, msg)
    required = (
        "slug", "run_id", "outcome", "stability_eligible", "finished_at", "models.extract", "reasoning_efforts.extract", "api_endpoint",
        "prompt_hash", "schema_hash", "rulebook_version", "extractor_contract_version")
    checks = [problem(~get("schema_version").eqNullSafe(F.lit(RUN_SCHEMA_VERSION)), f"schema_version is not {RUN_SCHEMA_VERSION}")]
    for path in required:
        value = get(path)
        checks.append(problem(value.isNull(), f"missing required {path}"))
        checks.append(problem(value == "", f"empty required {path}"))
    checks += [problem(F.array_contains(keys, name), f"contains retired {name}") for name in RETIRED_FIELDS]
    checks += [problem(get(f"{n}.adjudicate").isNotNull(), f"{n} contains retired adjudicate entry") for n in ("models", "reasoning_efforts")]
    return manifests.select(*RUN, F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def eligible_runs(manifests: DataFrame) -> DataFrame:
    """Archived runs that may enter a proof; parsed manifests with outcome and flags."""
    keep = (F.col("schema_version") == RUN_SCHEMA_VERSION) & F.col("outcome").isin(*TRUSTED_STATUSES) & F.col("stability_eligible")
    return manifests.filter(keep)


def live_snapshots(headers: DataFrame) -> DataFrame:
    return headers.filter(F.col("schema_version") == GRAPH_SCHEMA_VERSION)


# ---- metrics -------------------------------------------------------------------------
def _histogram(df: DataFrame, key: Column, name: str) -> DataFrame:
    """A sorted array<struct<key, n>> per run: key counts first, then one small array per run."""
    counts = df.groupBy(*RUN, key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias(name))


def _word(name: str, default: str = "null") -> Column:
    return F.coalesce(blank_to_null(F.col(name).cast("string")), F.lit(default))


def date_diagnostics(review: DataFrame, flags: DataFrame) -> DataFrame:
    """A9, long form: (run, key, n)."""
    rows = review.select(*RUN, F.when(has_text(F.col("event_date")), "dated").otherwise("undated").alias("key"))
    code = F.coalesce("code", F.lit(""))
    marks = F.array_compact(F.array(
        F.when(code == "date_phrase_unmapped", "accepted_date_inference_flags"),
        F.when(code.contains("rough") & code.contains("date"), "rough_date_mismatch_flags")))
    return rows.unionByName(flags.select(*RUN, F.explode(marks).alias("key")))


def quote_diagnostics(review: DataFrame, flags: DataFrame) -> DataFrame:
    """A10, long form."""
    quote, page = F.col("bound_source_quote"), F.col("bound_source_page")
    marks = F.array_compact(F.array(
        F.when(~has_text(quote), "missing_quote"), F.when(F.length(quote) > MAX_QUOTE_CHARS, "overlength_quote"),
        F.when(~has_text(page), "missing_page")))
    code = F.coalesce("code", F.lit(""))
    flag_marks = F.array_compact(F.array(
        F.when(code.contains("page") & code.contains("quote"), "page_mismatch"),
        F.when(code.contains("substring") | code.contains("verbatim"), "substring_failure")))
    return review.select(*RUN, F.explode(marks).alias("key")).unionByName(flags.select(*RUN, F.explode(flag_marks).alias("key")))


def bid_representation(review: DataFrame) -> DataFrame:
    """A11, long form."""
    cols = [F.col(c) for c in ("bid_value", "bid_value_lower", "bid_value_upper", "bid_value_unit", "consideration_type")]
    return review.select(*RUN, bid_state(*cols).alias("key"))


def run_metrics(runs: DataFrame, graph: dict[str, DataFrame], flags: DataFrame) -> DataFrame:
    """One row per run with every metric the comparison needs.

    Row fingerprints are kept as one digest of the sorted fingerprints' own counts, so a run
    with very many rows still aggregates in parallel.
    """
    review = graph["review_rows"]
    alias = normal_text(F.col("actor_label"))
    totals = review.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("review_status") != "clean").alias("review_item_count"),
        F.count_if(is_anonymous_alias(alias)).alias("anonymous_placeholder_count"),
        F.count_if(is_cohort_alias(alias)).alias("cohort_like_placeholder_count"))
    prints = fingerprint_digest(review)
    tables = reduce(DataFrame.unionByName, [graph[t].groupBy(*RUN).agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.lit(t)) for t in TABLE_METRICS])
    table_counts = tables.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("graph_table_counts"))
    flag_matrix = _histogram(flags, F.concat_ws(":", _word("severity", "unknown"), _word("code", "unknown")), "flag_counts")
    parts = [
        totals, prints, table_counts, flag_matrix,
        _histogram(review, _word("event_subtype"), "event_subtype_counts"), _histogram(graph["actors"], _word("actor_kind"), "actor_kind_counts"),
        _histogram(graph["actor_relations"], _word("relation_type"), "relation_type_counts"),
        _histogram(graph["claims"], _word("claim_type"), "claim_type_counts"),
        _histogram(graph["claim_dispositions"], _word("disposition"), "claim_disposition_counts"),
        _histogram(graph["coverage_results"], F.concat_ws(":", _word("obligation_id"), _word("result")), "coverage_result_counts"),
        _histogram(date_diagnostics(review, flags), F.col("key"), "date_diagnostics"),
        _histogram(bid_representation(review), F.col("key"), "bid_value_representation"),
        _histogram(quote_diagnostics(review, flags), F.col("key"), "quote_diagnostics"),
        flags.filter("severity = 'hard'").groupBy(*RUN).agg(F.count(F.lit(1)).alias("hard_flags"))]
    out = reduce(lambda a, b: a.join(b, RUN, "left"), parts, runs)
    zero = ("row_count", "review_item_count", "anonymous_placeholder_count", "cohort_like_placeholder_count")
    out = out.fillna(0, list(zero))
    return out.withColumn("graph_status", F.when(F.col("hard_flags") > 0, "hard_flags").otherwise("no_hard_flags")).drop("hard_flags")


def fingerprint_digest(review: DataFrame) -> DataFrame:
    """Order-free identity of a run's review rows: distinct fingerprints with counts, hashed
    in 256 buckets first, so no run is gathered as a whole."""
    row = {c: F.col(c) for c in review.columns}
    prints = review.select(*RUN, row_fingerprint(F.col("deal_slug"), row).alias("fp"))
    counted = prints.groupBy(*RUN, F.sha2("fp", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat_ws("=", "h", F.col("n").cast("string"))
    buckets = counted.groupBy(*RUN, F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("d"))
    return buckets.groupBy(*RUN).agg(digest(F.collect_list(F.concat_ws("=", "b", "d"))).alias("row_fingerprints"))


# ---- classification ------------------------------------------------------------------
def classify_deals(deals: DataFrame, selected: DataFrame, eligible: DataFrame, required: int, compared: dict[str, str] | None = None) -> DataFrame:
    """One row per deal; differences between runs are only reasons, config drift is instability.

    deals(deal_slug); selected: metrics of the latest runs; eligible(deal_slug, eligible_runs).
    """
    compared = COMPARED if compared is None else compared
    present = {c: r for c, r in compared.items() if c in selected.columns}
    many = lambda *cols: F.count_distinct(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})) > 1
    config = [c for c in CONFIG if c in selected.columns]
    aggs = [many(*config).alias("config_changed"), *[many(c).alias(f"_c_{c}") for c in present]]
    aggs.append(many("row_fingerprints").alias("_fp") if "row_fingerprints" in selected.columns else F.lit(False).alias("_fp"))
    aggs.append((F.count_distinct("row_count") > 1).alias("_rows"))
    if "flag_counts" in selected.columns:
        info = F.filter("flag_counts", lambda x: x["key"].startswith("info:"))
        selected = selected.withColumn("_info", F.coalesce(F.to_json(info), F.lit("[]")))
        aggs.append((F.count_distinct("_info") > 1).alias("info_changed"))
    else:
        aggs.append(F.lit(False).alias("info_changed"))
    order = F.struct("finished_at", "run_id")
    aggs += [
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "run_id", "outcome", "review_item_count"))).alias("_runs"),
        F.bool_or(F.col("outcome") == "high_burden").alias("_high"), F.bool_or(F.col("outcome") == "needs_review").alias("_review")]
    grouped = selected.groupBy("deal_slug").agg(*aggs)
    rows = deals.join(eligible, "deal_slug", "left").join(grouped, "deal_slug", "left")
    rows = rows.withColumn("eligible_runs", F.coalesce("eligible_runs", F.lit(0)))
    short = F.col("eligible_runs") < required
    changes = F.array_compact(F.array(
        F.when(F.col("_fp"), "row fingerprints changed").when(F.col("_rows"), "row counts changed"),
        *[F.when(F.col(f"_c_{c}"), reason) for c, reason in present.items()]))
    varied = F.when(F.size(changes) > 0, F.concat(F.lit("metric variability observed: "), F.array_join(F.array_distinct(changes), "; ")))
    stable = F.array_compact(F.array(
        varied, F.when(F.col("info_changed"), "info-only flag volume changed but substantive metrics were stable"),
        F.lit("selected archived runs passed live evidence, graph, and review contract checks")))
    reasons = (
        F.when(short, F.array(F.concat(F.col("deal_slug"), F.lit(" has "), F.col("eligible_runs"), F.lit(f" eligible archived runs; need {required}"))))
        .when(F.col("config_changed"), F.array(F.lit("model/reasoning/provider or prompt/schema/rulebook/extractor contract changed")))
        .otherwise(stable))
    return rows.select(
        "deal_slug", F.when(short, INSUFFICIENT).when(F.col("config_changed"), UNSTABLE).otherwise(STABLE).alias("classification"), reasons.alias("reasons"),
        "eligible_runs", F.lit(required).alias("required_runs"),
        F.when(short, "insufficient_runs").when(F.col("_high"), "high_burden").when(F.col("_review"), "needs_review").otherwise("passed_clean").alias("status"),
        F.when(~short & ~F.col("config_changed"), F.col("info_changed")).otherwise(False).alias("info_only_changed"),
        F.when(~short, F.transform("_runs", lambda r: r["run_id"])).otherwise(F.array().cast("array<string>")).alias("selected_runs"),
        F.when(~short, F.transform("_runs", lambda r: r["outcome"])).otherwise(F.array().cast("array<string>")).alias("selected_statuses"),
        F.when(~short, F.transform("_runs", lambda r: r["review_item_count"])).otherwise(F.array().cast("array<bigint>")).alias("review_item_counts"))


def analyze(deals: DataFrame, metrics: DataFrame, required: int) -> DataFrame:
    """X2 over all eligible runs: latest `required` per deal, classified."""
    eligible = metrics.groupBy("deal_slug").agg(F.count(F.lit(1)).alias("eligible_runs"))
    return classify_deals(deals, latest_runs(metrics, required), eligible, required)


def overall(results: DataFrame) -> DataFrame:
    """The worst classification over all deals, by precedence."""
    seen = lambda c: F.bool_or(F.col("classification") == c)
    return results.agg(
        F.when(seen(INSUFFICIENT), INSUFFICIENT).when(seen(UNSTABLE), UNSTABLE).when(seen(ESCALATE), ESCALATE).otherwise(STABLE).alias("classification"),
        F.count(F.lit(1)).alias("deals"))


def overall_reasons(results: DataFrame) -> DataFrame:
    """Every reason, one row each."""
    return results.select("deal_slug", F.posexplode("reasons").alias("pos", "reason")).select(
        "deal_slug", "pos", F.concat_ws(": ", "deal_slug", "reason").alias("reason"))


def proof_rows(results: DataFrame) -> DataFrame:
    """The per-deal part of the proof."""
    high = F.size(F.filter("selected_statuses", lambda s: s == "high_burden"))
    dirs = F.transform("selected_runs", lambda r: F.concat(F.lit("output/audit/"), F.col("deal_slug"), F.lit("/runs/"), r))
    return results.select(
        F.col("deal_slug").alias("slug"), "classification", "status", F.col("eligible_runs").alias("eligible_archived_runs"),
        F.col("required_runs").alias("required_archived_runs"), "reasons", "selected_runs", "selected_statuses", "review_item_counts",
        high.alias("high_burden_count"), dirs.alias("selected_run_dirs"))


def proof_header(results: DataFrame, requested_runs: int) -> DataFrame:
    """The proof's head, one row."""
    return overall(results).select(
        F.lit(PROOF_SCHEMA_VERSION).alias("schema_version"), "classification", F.lit(True).alias("content_variation_allowed"),
        F.lit(requested_runs).alias("requested_runs"), "deals")


def report_rows(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """The metrics of the selected runs, one row per run."""
    chosen = results.select("deal_slug", "classification", F.explode("selected_runs").alias("run_id"))
    return metrics.join(chosen, RUN)


# ---- release gate --------------------------------------------------------------------
NAMED = 10  # part of the feature: a blocker names the first ten missing references and counts the rest


def missing_references(references: DataFrame) -> DataFrame:
    """The expected references without verified metadata, one row each."""
    ok = (
        F.coalesce("is_reference", F.lit(False)) & F.coalesce("verified", F.lit(False))
        & F.col("verification_report").isNotNull() & F.col("last_verified_run_id").isNotNull())
    return references.filter(~ok).select("deal_slug").distinct()


def release_gate(references: DataFrame, proof: DataFrame, header: DataFrame, release: bool, run_dirs: DataFrame | None = None) -> DataFrame:
    """May target deals run? One row: open, and the reasons if not.

    references(deal_slug, is_reference, verified, verification_report, last_verified_run_id): every
    expected reference. proof: `proof_rows`; header: `proof_header`. run_dirs(path) lists existing
    run folders; leave out to skip that check.
    """
    missing = missing_references(references)
    named = missing.orderBy("deal_slug").limit(NAMED).agg(F.array_join(F.array_sort(F.collect_list("deal_slug")), ", ").alias("names")).scalar()
    lacking = missing.agg(F.count(F.lit(1))).scalar()
    total = references.agg(F.count_distinct("deal_slug")).scalar()
    p = proof.select("*", F.lit(True).alias("_p")).withColumnRenamed("slug", "deal_slug")
    checked = references.select("deal_slug").join(p, "deal_slug", "full")
    # full join: a proof row without a reference is as wrong as a reference without a proof row
    known = references.select("deal_slug", F.lit(True).alias("_r"))
    checked = checked.join(known, "deal_slug", "left")
    # The head says how many runs each deal needs; a row's own figure would let it vouch for itself.
    need = F.greatest(header.select("requested_runs").scalar(), F.lit(3))
    invalid = lambda a: F.coalesce(F.exists(a, lambda x: x.isNull() | (x == "")), F.lit(True))
    short = lambda a: F.coalesce(F.size(a), F.lit(0)) < need
    told = lambda c: F.coalesce(F.col(c), F.lit("null"))
    say = lambda text: F.concat(F.lit("stability proof slug "), F.col("deal_slug"), F.lit(text))
    reason = (
        F.when(F.col("_p").isNull(), F.concat(F.lit("stability proof missing slug_results entry for "), F.col("deal_slug")))
        .when(F.col("_r").isNull(), "stability proof reference_slugs do not match the reference set")
        .when(~F.col("classification").eqNullSafe(STABLE), F.concat(say(" classification="), told("classification")))
        .when(F.col("status").isin(*FAILURE_STATUSES), F.concat(say(" has blocking status "), F.col("status")))
        .when(~F.coalesce(F.col("status").isin(*TRUSTED_STATUSES), F.lit(False)), say(" status is not an eligible trusted outcome"))
        .when(F.coalesce("eligible_archived_runs", F.lit(0)) < need, say(" has insufficient eligible_archived_runs"))
        .when(short("selected_runs") | invalid("selected_runs"), say(" selected_runs are too few or invalid"))
        .when(short("selected_run_dirs") | invalid("selected_run_dirs"), say(" selected_run_dirs are too few or invalid")))
    bad = checked.select("deal_slug", reason.alias("reason")).filter("reason is not null")
    if run_dirs is not None:
        lost = proof.select(F.col("slug").alias("deal_slug"), F.explode("selected_run_dirs").alias("path")).join(run_dirs, "path", "left_anti")
        bad = bad.unionByName(lost.select("deal_slug", F.concat(F.lit("selected run directory is missing: "), F.col("path")).alias("reason")))
    first_bad = bad.agg(F.min(F.struct("deal_slug", "reason"))["reason"].alias("proof_reason")).scalar()
    row = header.select(
        "*", total.alias("references"), (total - lacking).alias("verified"), named.alias("names"), first_bad.alias("proof_reason"))
    head_reason = (
        F.when(~F.col("schema_version").eqNullSafe(PROOF_SCHEMA_VERSION), f"stability proof schema_version is not {PROOF_SCHEMA_VERSION}")
        .when(~F.col("classification").eqNullSafe(STABLE), F.concat(F.lit("stability proof classification="), told("classification")))
        .when(~F.coalesce("content_variation_allowed", F.lit(False)), "stability proof must explicitly allow content variation")
        .when(F.coalesce("requested_runs", F.lit(0)) < 3, "stability proof requested_runs must be at least 3"))
    proof_reason = F.coalesce(head_reason, F.col("proof_reason"))
    unverified = F.col("references") - F.col("verified")
    blockers = F.array_compact(F.array(
        F.when(unverified > 0, F.concat(
            F.lit("all "), F.col("references"), F.lit(" reference deals must have verified=true reference metadata; missing "), F.col("names"),
            F.when(unverified > NAMED, F.concat(F.lit(", ... (+"), unverified - NAMED, F.lit(" more)"))).otherwise(""))), proof_reason,
        F.when(F.lit(not release), "operator must pass --release-targets")))
    return row.select(
        "references", "verified", F.coalesce(proof_reason, F.lit("stability proof accepted")).alias("proof_reason"),
        (F.size(blockers) == 0).alias("is_open"), F.array_join(blockers, "; ").alias("blockers"))
