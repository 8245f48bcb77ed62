"""Runs, stability, gate, state, reconciliation, verification, files and streams."""
import json

import pytest
from conftest import claim, payload_of, refs
from pyspark.sql import functions as F

from tracewell.operators import progress as pr, reconcile as rec, runs, stability, verification as ver
from tracewell.sources import filings, sinks, state as st
from tracewell.streaming.idle import idle_gaps


def metrics(spark, rows):
    base = dict(model="m", reasoning_effort="high", provider="p", prompt_hash="a", schema_hash="b", rulebook_version="r", extractor_contract_version="c",
                outcome="passed_clean", row_count=3, review_item_count=0, row_fingerprints="f", date_diagnostics=[("dated", 1)], flag_counts=[("info:x", 1)])
    data = [{**base, **r} for r in rows]
    return spark.createDataFrame(data, "deal_slug string, run_id string, finished_at string, model string, reasoning_effort string, provider string, prompt_hash string, "
                                 "schema_hash string, rulebook_version string, extractor_contract_version string, outcome string, row_count long, review_item_count long, "
                                 "row_fingerprints string, date_diagnostics array<struct<key:string,n:long>>, flag_counts array<struct<key:string,n:long>>")


def test_stability_classes_and_gate(spark):
    run = lambda d, i, **k: dict(deal_slug=d, run_id=f"{d}{i}", finished_at=f"2024-01-0{i}", **k)
    m = metrics(spark, [run("same", i) for i in (1, 2, 3)] + [run("old", 1, model="older")] + [run("old", i) for i in (2, 3, 4)] + [run("few", 1)]
                + [run("config", 1, prompt_hash="z"), run("config", 2), run("config", 3)]
                + [run("drift", 1, row_fingerprints="g", row_count=4, outcome="needs_review"), run("drift", 2), run("drift", 3, date_diagnostics=[("undated", 1)])]
                + [run("info", 1, flag_counts=[("info:x", 2)]), run("info", 2), run("info", 3)])
    deals = spark.createDataFrame([(d,) for d in ("same", "old", "few", "none", "config", "drift", "info")], "deal_slug string")
    results = stability.analyze(deals, m, 3)
    got = {r.deal_slug: r for r in results.collect()}
    ok = "selected archived runs passed live evidence, graph, and review contract checks"
    assert got["same"].classification == got["old"].classification == stability.STABLE and got["same"].reasons == [ok]
    assert got["old"].selected_runs == ["old2", "old3", "old4"] and got["old"].eligible_runs == 4
    assert got["few"].reasons == ["few has 1 eligible archived runs; need 3"] and got["none"].classification == stability.INSUFFICIENT
    assert got["config"].classification == stability.UNSTABLE
    assert got["drift"].classification == stability.STABLE and got["drift"].status == "needs_review"
    assert got["drift"].reasons[0] == "metric variability observed: row fingerprints changed; date diagnostics changed"
    assert got["info"].info_only_changed and "info-only flag volume changed" in got["info"].reasons[0]
    assert stability.overall(results).first().classification == stability.INSUFFICIENT
    good = results.filter(F.col("deal_slug").isin("same", "old"))
    references = spark.createDataFrame([("same", True, True, "r", "x"), ("old", True, True, "r", "x")],
                                       "deal_slug string, is_reference boolean, verified boolean, verification_report string, last_verified_run_id string")
    gate = lambda refs_, res, release: stability.release_gate(refs_, stability.proof_rows(res), stability.proof_header(res, 3), release).first()
    assert gate(references, good, True).is_open
    assert gate(references, good, False).blockers == "operator must pass --release-targets"
    unverified = references.withColumn("verified", F.col("deal_slug") == "same")
    assert gate(unverified, good, True).blockers.startswith("all ") and gate(unverified, good, True).blockers.count("missing ") == 1
    lacking = gate(references, good.filter("deal_slug = 'same'"), True)
    assert lacking.blockers == "stability proof missing slug_results entry for old"
    # a row that asks for one run of itself, and a row without status, do not open the gate
    own_figure = stability.proof_rows(good).withColumns({
        "required_archived_runs": F.lit(1), "eligible_archived_runs": F.lit(1), "selected_runs": F.slice("selected_runs", 1, 1),
        "selected_run_dirs": F.slice("selected_run_dirs", 1, 1)})
    head = stability.proof_header(good, 3)
    assert "has insufficient eligible_archived_runs" in stability.release_gate(references, own_figure, head, True).first().blockers
    silent = stability.proof_rows(good).withColumns({"status": F.lit(None).cast("string"), "classification": F.lit(None).cast("string")})
    assert not stability.release_gate(references, silent, head, True).first().is_open


def progress(spark, rows):
    base = dict(is_reference=False, status="passed_clean", flag_count=0, last_run="t1", last_run_id="r1", last_verified_by=None, last_verified_at=None,
                last_verified_run_id=None, verified=None, verification_report=None, notes="", rulebook_version="v1", rulebook_version_history=[])
    return spark.createDataFrame([{**base, **r} for r in rows], "deal_slug string, is_reference boolean, status string, flag_count int, last_run string, last_run_id string, "
                                 "last_verified_by string, last_verified_at string, last_verified_run_id string, verified boolean, verification_report string, notes string, "
                                 "rulebook_version string, rulebook_version_history array<struct<ts:string,run_id:string,version:string>>")


def test_skip_upsert_failure_and_verification(spark):
    p = progress(spark, [
        dict(deal_slug="done"), dict(deal_slug="stale", rulebook_version="v0"), dict(deal_slug="new", status=None), dict(deal_slug="odd", status="verified"),
        dict(deal_slug="ref", is_reference=True, verification_report="x.md", last_verified_by="me", rulebook_version_history=[(f"t{i:02d}", f"r{i}", "v") for i in range(10)])])
    plan = {r.deal_slug: r.action for r in pr.skip_plan(p, "v1").collect()}
    assert plan == {"done": "skip", "stale": "run", "new": "run", "odd": "blocked", "ref": "skip"}
    assert {r.action for r in pr.skip_plan(p, "v1", re_extract=True).collect()} == {"run"}
    assert {r.deal_slug for r in pr.select_deals(p, "pending").collect()} == {"new"}
    batch = spark.createDataFrame([("ref", "needs_review", 2, "n", "v2", "t9", "r9"), ("seed", "passed_clean", 0, "n", "v2", "t9", "r8"), ("done", "bogus", 0, "n", "v2", "t9", "r7")],
                                  "deal_slug string, status string, flag_count int, notes string, rulebook_version string, last_run string, run_id string")
    after = {r.deal_slug: r for r in pr.upsert_progress(p, batch).collect()}
    ref = after["ref"]
    assert ref.verified and ref.notes == "n; prior filing-grounded verification metadata preserved" and ref.status == "needs_review"
    assert len(ref.rulebook_version_history) == 10 and ref.rulebook_version_history[-1].run_id == "r9" and ref.rulebook_version_history[0].run_id == "r1"
    assert after["seed"].is_reference is False and after["done"].status == "passed_clean"
    assert [r.deal_slug for r in pr.refused_updates(batch).collect()] == ["done"]
    failed = spark.createDataFrame([("done",), ("new",), ("gone",)], "deal_slug string")
    outputs = spark.createDataFrame([("done",)], "deal_slug string")
    assert {r.deal_slug: r.status for r in pr.failure_status(failed, p, outputs).collect()} == {
        "done": "stale_after_failure", "new": "failed_system", "gone": "failed_system"}
    out = spark.createDataFrame([("ref", "r1", "deal_graph_v2", 0), ("done", "r1", "deal_graph_v2", 0)], "deal_slug string, run_id string, schema_version string, hard_flags int")
    eligible = pr.verification_eligibility(p, out)
    assert {r.deal_slug: r.eligible for r in eligible.collect()}["ref"]
    marked = {r.deal_slug: r for r in pr.mark_verified(p, eligible, "agent", "now").collect()}
    assert marked["ref"].last_verified_run_id == "r1" and marked["done"].verified is None


def test_reconcile_flags_differences(spark):
    p = progress(spark, [dict(deal_slug="ok"), dict(deal_slug="lost"), dict(deal_slug="failed", status="failed_system"), dict(deal_slug="late", status="stale_after_failure", last_run_id="r2")])
    outputs = spark.createDataFrame(
        [(d, "deal_graph_v2", True, "r1", "t1", "v1", 0, False, True, True) for d in ("ok", "failed", "late")],
        "deal_slug string, schema_version string, has_deal boolean, run_id string, last_run string, rulebook_version string, review_burden long, has_estimator boolean, has_jsonl boolean, has_csv boolean")
    got = {(r.deal_slug, r.severity, r.code) for r in rec.output_issues(p, outputs).collect()}
    assert got == {("lost", "error", "missing_output"), ("failed", "error", "failure_output_present"), ("late", "warning", "reference_artifact_stale")}
    references = spark.createDataFrame([("ok",), ("absent",)], "deal_slug string")
    assert {r.code for r in rec.membership_issues(p, references).collect()} == {"reference_not_marked", "missing_reference_slug"}
    flags = spark.createDataFrame([("ok", "r1", "hard", "a"), ("ok", "r1", "hard", "a")], "deal_slug string, run_id string, severity string, code string")
    log = flags.withColumn("logged_at", F.lit("t1"))
    assert rec.flag_log_issues(flags, log, p).count() == 0
    assert [r.code for r in rec.flag_log_issues(flags, log.limit(1), p).collect()] == ["flags_jsonl_mismatch"]
    manifest = json.dumps({"rulebook_version": "v0", "extractor_contract_version": "c", "tool_calls_count": 1})
    raw = json.dumps({"rulebook_version": "v1", "extractor_contract_version": "d", "parsed_json": {}})
    issues = rec.contract_issues(p.filter("deal_slug = 'ok'"), spark.createDataFrame([("ok", manifest)], "deal_slug string, manifest string"),
                                 spark.createDataFrame([("ok", raw)], "deal_slug string, raw string"))
    assert sorted(r.code for r in issues.collect()) == [
        "audit_manifest_retired_field", "extractor_contract_version_mismatch", "raw_response_shape", "rulebook_version_mismatch"]
    total = rec.summary(rec.reconcile([issues, rec.output_issues(p, outputs)]), p).first()
    assert (total.ok, total.error_count, total.warning_count, total.checked_slugs) == (False, 6, 1, 4)


def test_grounding(spark):
    pages = spark.createDataFrame([("d", 1, "alpha beta"), ("d", 2, "gamma")], "deal_slug string, number int, content string")
    evidence = spark.createDataFrame([("d", 0, "page_1_paragraph_1", "alpha"), ("d", 1, "page_2_paragraph_1", "alpha"), ("d", 2, "bad", "x")],
                                     "deal_slug string, ref int, citation_unit_id string, quote_text string")
    assert sorted(r.message for r in ver.ref_failures(evidence, pages).collect()) == [
        "evidence_ref[1] quote_text is not an exact substring of Filing page 2", "evidence_ref[2] has invalid citation_unit_id"]
    review = spark.createDataFrame([("d", "a", "clean", "alpha | gamma", "1 | 2"), ("d", "b", "clean", "alpha | beta", "1"), ("d", "c", "clean", "alpha | beta", "1 | 2"),
                                    ("d", "e", "rejected_claim", "", ""), ("d", "f", "clean", "", "")],
                                   "deal_slug string, review_row_id string, review_status string, bound_source_quote string, bound_source_page string")
    assert sorted(r.message.split()[2] for r in ver.review_failures(review, pages).collect()) == ["c", "f"]


def test_call_summary_and_idle_gaps(spark):
    calls = spark.createDataFrame([("d", "r", 2, "extract", "h2", 1, 0, 5, 5, None), ("d", "r", 1, "extract", "", 2, 1, 1, 1, 1), ("d", "r", 3, "extract", "h3", None, 1, 1, 1, 1)],
                                  "deal_slug string, run_id string, pos int, phase string, prompt_hash string, attempts int, warnings int, input_tokens long, output_tokens long, reasoning_tokens long")
    row = runs.call_summary(calls).first()
    assert (row.total_attempts, row.watchdog_warnings, row.prompt_hash, row.total_input_tokens) == (3, 2, "h2", 7)
    activity = spark.sql("SELECT 'c' AS call, timestamp'2024-01-01 23:58:00' + make_interval(0,0,0,0,0,0,s) AS ts FROM VALUES (0), (10), (110), (240), (700) t(s)")
    g = idle_gaps(activity, ["call"]).first()
    assert (g.activities, g.max_idle_seconds, g.warnings, g.stream_idle, g.total_exceeded) == (5, 460.0, 3, True, True)


def test_run_and_output_records(spark):
    rows = [("d", "r1", "2024-01-01T00:00:00Z", "2024-01-01T00:01:30Z", None), ("d", "r2", "today", "2024-01-01T00:01:30Z", "stopped")]
    given = spark.createDataFrame(rows, "deal_slug string, run_id string, started_at string, finished_at string, error string").selectExpr(
        "*", "'run' as action", "if(error is null, 'passed_clean', 'failed_system') as outcome", "error is null as stability_eligible", "'v1' as rulebook_version", "'c1' as extractor_contract_version",
        "'s' as schema_hash", "'local' as llm_backend", "'m' as extract_model", "cast(null as string) as api_endpoint", "'low' as reasoning_effort")
    calls = spark.createDataFrame([("d", "r1", 1, "extract", "h", 2, 0, 5, 4, 3)],
                                  "deal_slug string, run_id string, pos int, phase string, prompt_hash string, attempts int, warnings int, input_tokens long, output_tokens long, reasoning_tokens long")
    first, second = runs.run_manifests(given, runs.call_summary(calls)).orderBy("run_id").collect()
    assert (first.schema_version, first.slug, first.prompt_hashes, first.models, first.reasoning_efforts) == ("audit_run_v3", "d", {"extract": "h"}, {"extract": "m"}, {"extract": "low"})
    assert (first.total_input_tokens, first.total_reasoning_tokens, first.total_attempts, first.total_seconds, first.error) == (5, 3, 2, 90, None)
    assert (second.prompt_hash, second.prompt_hashes, second.total_attempts, second.total_seconds, second.error) == (None, {}, 0, None, "stopped")

    review = spark.createDataFrame([("d", "r1", "clean"), ("d", "r1", "needs_review")], "deal_slug string, run_id string, review_status string")
    flags = spark.createDataFrame([("d", "r1", "soft", "B"), ("d", "r1", "odd", "A"), ("d", "r1", "soft", "B"), ("d", "r2", "hard", "X")], "deal_slug string, run_id string, severity string, code string")
    status = runs.burden_status(given, review, flags)
    record = runs.output_records(status, flags, given).collect()
    assert [(r.run_id, r.last_run, r.status, r.flag_count, [tuple(f) for f in r.deal_flags]) for r in record] == [
        ("r1", "2024-01-01T00:01:30Z", "needs_review", 1, [("A", "hard", 1), ("B", "soft", 2)])]


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    return tmp_path_factory.mktemp("archive")


def test_sources_and_sinks(spark, archive):
    deal = archive / "filings" / "acme"
    deal.mkdir(parents=True)
    (deal / "pages.json").write_text(json.dumps([{"number": 2, "content": "two"}, {"number": 1, "content": "one"}]))
    pages = filings.read_pages(spark, f"{archive}/filings/*/pages.json")
    assert [(r.deal_slug, r.page_pos, r.number, r.content) for r in pages.orderBy("page_pos").collect()] == [("acme", 0, 2, "two"), ("acme", 1, 1, "one")]
    (deal / "raw.md").write_text(filings.marked_text(pages).first().text)
    back = filings.read_marked_text(spark, f"{archive}/filings/*/raw.md")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pages.collect()))
    (deal / "manifest.json").write_text(json.dumps({"slug": "acme", "target_name": " ", "is_reference": True, "source": {"cik": "1"}}, indent=1))
    manifest = filings.read_manifests(spark, f"{archive}/filings/*/manifest.json").first()
    assert manifest.target_name is None and manifest.source.cik == "1"
    (archive / "seeds.csv").write_text('deal_slug,target_name,acquirer,date_announced,primary_url,is_reference\nacme,"A, ""B""",X,2014,u, TRUE \n')
    seed = filings.read_seeds(spark, f"{archive}/seeds.csv").first()
    assert seed.target_name == 'A, "B"' and seed.is_reference is True
    (archive / "flags.jsonl").write_text('{"deal":"acme","run_id":"r","logged_at":"t","severity":"hard","code":"x"}\n\nnope\n[1]\n')
    entries, bad = st.read_flag_log(spark, f"{archive}/flags.jsonl")
    assert entries.first().code == "x" and sorted((r.line, r.message) for r in bad.collect()) == [
        (3, "flag log line 3 is not valid JSON"), (4, "flag log line 4 is not a JSON object")]
    (archive / "progress.json").write_text(json.dumps({"schema_version": "v2", "rulebook_version": "x", "deals": {"acme": {"status": "pending"}}}))
    deals, header = st.read_progress(spark, f"{archive}/progress.json")
    assert deals.first().status == "pending" and sorted(r.code for r in rec.progress_header_issues(header).collect()) == ["progress_schema", "progress_stale_rulebook_pin"]
    run = archive / "audit" / "acme" / "runs" / "r1"
    run.mkdir(parents=True)
    (run / "calls.jsonl").write_text('{"ts":"1","phase":"extract","prompt_hash":"h","attempts":2,"watchdog":{"warnings":1}}\n\n{bad\n')
    assert runs.call_summary(st.read_calls(spark, f"{archive}/audit/*/runs/*/calls.jsonl")).first().total_attempts == 2
    (run / "manifest.json").write_text(json.dumps({"schema_version": "audit_run_v3", "slug": "acme", "run_id": "r1", "outcome": "passed_clean", "stability_eligible": True}))
    manifests = st.read_run_manifests(spark, f"{archive}/audit/*/runs/*/manifest.json")
    assert stability.eligible_runs(manifests).count() == 1
    assert "missing required finished_at" in {r.problem for r in stability.manifest_problems(manifests).collect()}
    (run / "raw_response.json").write_text(json.dumps({"parsed_json": {"actor_claims": []}}))
    assert st.read_payloads(spark, f"{archive}/audit/*/runs/*/raw_response.json").first().payload == '{"actor_claims":[]}'
    expected = spark.createDataFrame([(f"{run}/manifest.json",), (f"{run}/validation.json",)], "path string")
    assert {r.reason for r in st.read_json_objects(spark, expected, f"{run}/*.json").collect()} == {None, "missing"}
    rows = spark.createDataFrame([("d", "r", "actors", "a1", "e1", 2), ("d", "r", "actors", "a1", "e1", 1), ("d", "r", "actors", "a1", "e2", 1)],
                                 "deal_slug string, run_id string, row_table string, row_id string, evidence_id string, ordinal int")
    assert sorted((r.evidence_id, r.ordinal) for r in sinks.storable(rows, "row_evidence").collect()) == [("e1", 1), ("e2", 1)]
    flags = spark.createDataFrame([("d", "r", "f", "hard", "c", "why", True)], "deal_slug string, run_id string, flag_id string, severity string, code string, reason string, current boolean").withColumn("metadata", F.struct(F.lit(1).alias("a")))
    stored = sinks.storable(flags, "review_flags").first()
    assert stored.current == 1 and stored.metadata == '{"a":1}'


def test_stream_intake_writes_each_payload_once(spark, archive):
    from tracewell.streaming.intake import start_intake
    inbox, out = archive / "inbox", archive / "out"
    inbox.mkdir()
    payload = payload_of(event_claims=[claim("event", evidence=refs("Party A signed"), actor_label="Party A", event_date="2014-01-03")])
    line = lambda deal, run: json.dumps({"deal_slug": deal, "run_id": run, "rulebook_version": "v1", "payload": payload})
    (inbox / "one.json").write_text(line("a", "r1") + "\n")
    pages = spark.createDataFrame([(d, 0, 1, "Party A signed an NDA.") for d in ("a", "b")], "deal_slug string, page_pos int, number int, content string")
    targets = spark.createDataFrame([("a", "T"), ("b", None)], "deal_slug string, target_name string")
    for _ in range(2):
        query = start_intake(spark, str(inbox), pages, targets, str(out), str(archive / "cp"))
        query.awaitTermination()
        (inbox / "two.json").write_text(line("a", "r2") + "\n" + line("b", "r3") + "\n")  # deal a is done under v1
    ledger = spark.read.parquet(f"{out}/ledger")
    assert sorted((r.deal_slug, r.run_id, r.event_code) for r in ledger.collect()) == [("a", "r1", "nda_signed"), ("b", "r3", "nda_signed")]
    assert spark.read.parquet(f"{out}/events").count() == 2
    # a batch without its commit record is not read
    from tracewell.streaming.intake import committed, read_intake
    spark.read.parquet(f"{out}/ledger").drop("batch").write.parquet(f"{out}/ledger/batch=99")
    assert read_intake(spark, str(out), "ledger").count() == 2
    assert sorted((r.payloads, r.issues) for r in committed(spark, str(out)).collect()) == [(1, 0), (1, 0)]
