"""What larger tables showed: ties, stages as files, texts taken apart once."""
from __future__ import annotations

from tracewell.operators.analyst import embed_order, sort_browse
from tracewell.operators.contains import contains_pairs
from tracewell.operators.graph import build_graph
from tracewell.session import Staging


def test_stages_are_compressed_files(spark):
    df = spark.range(1000).selectExpr("id", "repeat('the same long text ', 50) as text")
    kept = Staging().keep("rows", df)
    assert kept.inputFiles() and all(f.endswith(".zstd.parquet") for f in kept.inputFiles())
    assert sorted(kept.collect()) == sorted(df.collect())


def test_long_texts_are_split_once_for_short_quotes(spark):
    """Splitting a text anew for each of its places made quotes of four tokens quadratic in the text."""
    words = " ".join(f"w{i}" for i in range(30000))
    texts = spark.createDataFrame([(words, "h")], "text string, text_hash string")
    quotes = spark.createDataFrame([("w7 w8 w9 w10",), ("9 w30 w3",), ("w8 w7 w9 w10",)], "quote_text string")
    held = contains_pairs(quotes, texts, [])
    assert sorted((r.quote_text, r.plain) for r in held.collect()) == [("9 w30 w3", 1), ("w7 w8 w9 w10", 1)]
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("split(text") for line in plan.splitlines()) == 1


def test_equal_keys_are_browsed_in_key_order(spark):
    rows = spark.range(0, 4000, 1, 16).selectExpr("(id * 37) % 4000 as k", "'n' as name", "'d' as deal_slug", "'1' as event_order", "'5' as code").repartition(16)
    for ordered in (sort_browse(rows, "name", False, True, ["k"]), sort_browse(rows, "code", True, ties=["k"]), embed_order(rows, ["k"])):
        assert [r.k for r in ordered.limit(50).collect()] == list(range(50))


def test_graph_tables_are_made_on_demand(spark):
    """A query about one table of the graph once paid for every stage, the search behind the flags among them."""
    asked = []

    def given(name):
        def make():
            asked.append(name)
            return spark.createDataFrame([("d", "r1", "c1", "e1", 1)], "deal_slug string, run_id string, claim_id string, evidence_id string, ordinal int")
        return make

    runs = spark.createDataFrame([("d", "r1", "T")], "deal_slug string, run_id string, target_name string")
    graph = build_graph(given("claims"), given("outcomes"), given("evidence"), runs, given("spans"), given("flags"))
    assert graph["deals"].count() == 1 and asked == []
    assert graph["claim_evidence"].count() == 1 and graph["claim_evidence"].count() == 1 and asked == ["evidence"]
    assert {"claims", "actors", "row_evidence", "review_flags"} <= set(graph) and asked == ["evidence"]


def test_stitching_looks_at_each_quote_once(spark):
    """The search over runs of units was evaluated again for its filter and for each of its two results."""
    from tracewell.operators.binding import stitched_units
    units = spark.createDataFrame(
        [("d", f"page_{i}_paragraph_1", f"Entry {i}: text of it.", i) for i in range(40)], "deal_slug string, unit_id string, text string, sequence int")
    refs = spark.createDataFrame([("d", "page_7_paragraph_1", "7: text of it.\n\nEntry 8: text")], "deal_slug string, citation_unit_id string, quote_text string")
    found = stitched_units(refs, units, slack=30)
    assert [r.stitched for r in found.collect()] == [["page_6_paragraph_1", "page_7_paragraph_1", "page_8_paragraph_1"]]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 4


def test_intake_takes_keys_without_a_python_call_each(spark, tmp_path):
    """One Python call per key took most of the time of an intake of many small deals; null keys and run ids take part."""
    from tracewell.streaming import intake
    shape = "deal_slug string, run_id string, rulebook_version string, payload string"
    batch = spark.createDataFrame(
        [("a", "r2", "v1", "late"), ("a", "r1", "v1", "b"), ("a", "r1", "v1", "a"), ("b", "r1", "v1", "x"), ("b", "r1", None, "n"), ("c", None, "v1", "y"), ("c", "r0", "v1", "z")], shape)
    taken = spark.createDataFrame([("b", "v1"), ("b", "v1"), ("z", "v1")], "deal_slug string, rulebook_version string")
    new = intake.new_payloads(batch, taken)
    got = sorted((r.deal_slug, r.rulebook_version or "", r.run_id or "", r.payload) for r in new.collect())
    assert got == [("a", "v1", "r1", "a"), ("b", "", "r1", "n"), ("c", "v1", "", "y")]
    assert "Python" not in new._jdf.queryExecution().executedPlan().toString()


def test_lines_equal_their_sql(spark, tmp_path):
    """Lines that end in blanks or hold other white space: query and SQL part texts alike."""
    import duckdb
    from tracewell.plans.catalog import QUERIES
    from tracewell.plans.oracles import TABLE_SQL
    texts = [
        "a b \nc", "last ", "  both  \n\t tab\t\n wide　\n x", " \n\n12\n 34 \n٣\nTable of Contents \nTable  of Contents\nZEQ.=1\n COMMAND=2", "", None,
        "\t", "x\r\ny\r", "\n".join(f"line {i} " for i in range(600)), "é\U0001f600 z \n\U0001f600"]
    spark.createDataFrame([(i, "web", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").coalesce(1).write.parquet(
        str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["citation_units"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({TABLE_SQL['citation_units']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 600


def test_a_bid_bound_of_zero_equals_its_sql(spark, tmp_path):
    """A purchase of value 0 with bounds: its label names them, as the SQL of the ledger does."""
    import datetime
    import duckdb
    from tracewell.plans.catalog import QUERIES
    from tracewell.plans.oracles import GRAPH_SQL
    day = datetime.datetime(2024, 1, 2)
    rows = [(0, day, 1, "purchase", 0.0, '{"k": 1}'), (1, day, 1, "purchase", 2.5, '{"k": 4}'), (2, day, 1, "purchase", 0.0, '{"k": 3}'), (3, day, 2, "view", 1.0, '{"k": 7}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(
        str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["ledger_rows"](spark, str(tmp_path))
    want = con.execute("select " + ", ".join(f'"{c}"' for c in got.columns) + f" from ({GRAPH_SQL['ledger_rows']})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert any("(0.0-0.0)" in r["review_label"] for r in got.collect())


def test_ledger_without_order_numbers_sorts_no_rows(spark, tmp_path):
    """Readers that do not ask for order numbers do not pay for them: no window in their plans."""
    import datetime
    from tracewell.plans.catalog import QUERIES
    rows = [(i, datetime.datetime(2024, 1, 2), 1 + i % 2, "purchase", 2.5, '{"k": 4}') for i in range(4)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(
        str(tmp_path / "events.parquet"))
    for name in ("ledger_rows", "ledger_export"):
        assert "Window" not in QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert [r["rows"] for r in QUERIES["ledger_export"](spark, str(tmp_path)).collect()] == [2]
