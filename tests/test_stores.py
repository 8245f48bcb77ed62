"""Stored tables, numbered lines, closed streams and exact quantiles."""
from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators.analyst import number_profile, order_statistics
from tracewell.sources.state import inventory, list_files, numbered_lines, read_flag_log
from tracewell.sources.tables import KeyedTable
from tracewell.streaming.idle import run_to_end


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    rng = random.Random(1)
    files = {}
    for name, n in (("a", 3000), ("b", 1), ("c", 0), ("d", 700)):
        files[name] = ["".join(rng.choice("xy {}") for _ in range(rng.randint(0, 60))) for _ in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("".join(x + "\n" for x in files[name]))
    conf = {"spark.sql.files.maxPartitionBytes": "7000", "spark.sql.files.openCostInBytes": "100"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        got = sorted((r.path[-7], r.line_no, r.line) for r in rows.collect())
        _, bad = read_flag_log(spark, str(tmp_path))
        numbers = sorted((r.path[-7], r.line) for r in bad.collect())
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert got == sorted((f, i + 1, x) for f, xs in files.items() for i, x in enumerate(xs))
    assert numbers == sorted((f, i + 1) for f, xs in files.items() for i, x in enumerate(xs) if x.strip() and x.replace(" ", "") != "{}")


def test_an_archive_is_listed_without_its_contents(spark, tmp_path):
    for path in ("acme/latest.json", "acme/runs/r1/manifest.json", "acme/runs/r1/raw.json", "acme/notes.txt", "b/runs/r2/x"):
        (tmp_path / "archive" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "archive" / path).write_text("12345")
    files = list_files(spark, f"{tmp_path}/archive")
    assert {r.length for r in files.collect()} == {5}
    artifacts, entries = inventory(files)
    assert sorted(map(tuple, artifacts.collect())) == [("acme", "r1", "manifest.json"), ("acme", "r1", "raw.json"), ("b", "r2", "x")]
    assert sorted(map(tuple, entries.collect())) == [("acme", "latest.json"), ("acme", "notes.txt"), ("acme", "runs"), ("b", "runs")]


def test_sessions_come_whole_and_once(spark, tmp_path):
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 2, None]), start + datetime.timedelta(seconds=rng.randint(0, 20_000))) for _ in range(300)] + [(1, None), (5, start)]
    source = f"{tmp_path}/in"
    spark.createDataFrame(rows, "user long, ts timestamp_ntz").repartition(3).write.parquet(source)
    want = []
    for user in (1, 2, 5, None):
        times = sorted(t for u, t in rows if u == user and t)
        for t in times:
            if want and want[-1][0] == user and (t - want[-1][2]).total_seconds() < 120:
                want[-1] = (user, want[-1][1], t, want[-1][3] + 1)
            else:
                want.append((user, t, t, 1))
    for _ in range(2):  # the second run finds everything done
        got = run_to_end(spark, source, f"{tmp_path}/work", ["user"]).select(
            "user", F.col("started").cast("timestamp_ntz"), F.col("last_activity").cast("timestamp_ntz"), "activities").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "deal string, line int, text string", ["deal"], buckets=400)
    shape = "deal string, line int, text string"
    assert table.read().count() == 0 and table.version() == 0
    rows = [(f"d{i}", j, "old") for i in range(400) for j in range(2)]
    table.upsert(spark.createDataFrame(rows, shape))
    version, touched = table.upsert(spark.createDataFrame([(f"d{i}", 7, "new") for i in range(4)] + [("fresh", 0, "new")], shape))
    assert version == 2 and touched <= 5  # one per cent of the deals, about one per cent of the buckets
    want = sorted([r for r in rows if r[0] not in {"d0", "d1", "d2", "d3"}] + [(f"d{i}", 7, "new") for i in range(4)] + [("fresh", 0, "new")])
    assert sorted(map(tuple, table.read().collect())) == want
    # files of a batch that was not committed are not read
    spark.createDataFrame([("d9", 1, "lost")], shape).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/t/data/version=3")
    assert sorted(map(tuple, table.read().collect())) == want
    table.upsert(spark.createDataFrame([("d5", 1, "x")], shape), lambda stored, batch: stored.unionByName(batch))
    assert [r.text for r in table.read().where("deal = 'd5'").orderBy("line", "text").collect()] == ["old", "old", "x"]


@pytest.mark.parametrize("values", [
    [1e300] + [1.0 + i * 1e-15 for i in range(200)], [0.0, -0.0, 5e-324, -5e-324, float("inf"), float("-inf"), None, float("nan")], [3.5] * 50 + [2.0],
    [None], [], [random.Random(3).gauss(0, 1) * 10 ** random.Random(i).randint(-20, 20) for i in range(500)]])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    own = sorted(v for v in values if v is not None and v == v)
    ranks = sorted({1, len(own) // 4 + 1, len(own) // 2 + 1, len(own)}) if own else []
    n, least, most, found = order_statistics(df, "x", lambda count: ranks)
    assert (n, least, most) == ((len(own), own[0], own[-1]) if own else (0, None, None)) and found == [own[r - 1] for r in ranks]
    profile = [tuple(r) for r in number_profile(df, "x").collect()]
    assert profile == ([("x", len(own), own[0], own[len(own) // 2], own[-1])] if own else [])
