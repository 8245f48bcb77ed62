"""State files, logs and archived runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewell.functions.text import strict_json
from tracewell.schemas import CALL_JSON, PROGRESS_JSON, RUN_MANIFEST_JSON
from tracewell.session import cut_lineage

_RUN_FILE = r"([^/]+)/runs/([^/]+)/[^/]+$"


def _run_of_path() -> list:
    path = F.col("_metadata.file_path")
    return [F.regexp_extract(path, _RUN_FILE, 1).alias("deal_slug"), F.regexp_extract(path, _RUN_FILE, 2).alias("run_id")]


def read_payloads(spark: SparkSession, pattern: str) -> DataFrame:
    """Archived raw responses `.../{deal}/runs/{run}/raw_response.json` -> payload text."""
    text = spark.read.text(pattern, wholetext=True)
    return text.select(*_run_of_path(), F.get_json_object("value", "$.parsed_json").alias("payload"), F.col("value").alias("raw"))


def read_run_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """Manifests of archived runs, parsed and as text."""
    text = spark.read.text(pattern, wholetext=True).select(*_run_of_path(), F.col("value").alias("manifest"))
    rows = text.withColumn("_m", F.from_json("manifest", RUN_MANIFEST_JSON))
    m = lambda n: F.col(f"_m.{n}")
    return rows.select(
        "deal_slug", "run_id", "manifest", m("schema_version"), m("started_at"), m("finished_at"), m("outcome"), m("stability_eligible"),
        F.coalesce(m("models.extract"), F.lit("")).alias("model"), F.coalesce(m("reasoning_efforts.extract"), F.lit("")).alias("reasoning_effort"),
        F.coalesce(m("api_endpoint"), F.lit("")).alias("provider"), m("prompt_hash"), m("schema_hash"), m("rulebook_version"), m("extractor_contract_version"))


def numbered_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, line_no, line): every line of text files with its 1-based number, files of any size.

    A file is read in splits by several tasks, so numbers come in two passes: lines are counted per split,
    the counts summed over the splits before, and a line's number is that base plus its place in the split.
    A task reads a split in file order, so a growing id gives the place. Only counts per split meet.
    """
    split = ["path", "_start"]
    rows = spark.read.text(pattern).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    rows = cut_lineage(rows)  # ids and counts must come from the same reading
    counts = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_lines"), F.min("_id").alias("_first"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*split, "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_base"))
    return rows.join(base, split).select("path", (F.col("_base") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def read_calls(spark: SparkSession, pattern: str) -> DataFrame:
    """Call logs; blank and bad lines are skipped. `pos` orders the calls of a run: by time, then by line."""
    rows = numbered_lines(spark, pattern).withColumn("_c", F.from_json("line", CALL_JSON)).filter(F.coalesce(_is_object(strict_json(F.col("line"))), F.lit(False)))
    path = F.col("path")
    c = lambda n: F.col(f"_c.{n}")
    return rows.select(
        F.regexp_extract(path, _RUN_FILE, 1).alias("deal_slug"), F.regexp_extract(path, _RUN_FILE, 2).alias("run_id"),
        F.struct(c("ts").alias("ts"), F.col("line_no")).alias("pos"), c("phase"), c("prompt_hash"), c("attempts"),
        c("watchdog.warnings").alias("warnings"), c("input_tokens"), c("output_tokens"), c("reasoning_tokens"), c("ts"), c("outcome"))


def _is_object(variant: Column) -> Column:
    return F.schema_of_variant(variant).startswith("OBJECT")


def read_flag_log(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Flag log -> (entries, issues). Bad lines are reported with their 1-based number; files may have any size."""
    lines = numbered_lines(spark, pattern).filter(F.trim("line") != "").withColumn("v", strict_json(F.col("line")))
    good = F.coalesce(_is_object(F.col("v")), F.lit(False))
    field = lambda n: F.get_json_object("line", f"$.{n}")
    entries = lines.filter(good).select(
        field("deal").alias("deal_slug"), field("run_id").alias("run_id"), field("logged_at").alias("logged_at"),
        field("severity").alias("severity"), field("code").alias("code"), F.col("line").alias("entry"), "path", "line_no")
    bad = lines.filter(~good).select(
        F.lit("error").alias("severity"), F.lit("bad_flags_jsonl").alias("code"),
        F.concat(F.lit("flag log line "), F.col("line_no"), F.when(F.col("v").isNull(), " is not valid JSON").otherwise(" is not a JSON object")).alias("message"),
        "path", F.col("line_no").alias("line"))
    return entries, bad


def read_progress(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """State file -> (deals, header)."""
    state = spark.read.schema(PROGRESS_JSON).option("multiLine", True).json(path)
    deals = state.select(F.explode("deals").alias("deal_slug", "_d")).select("deal_slug", "_d.*")
    header = state.select("schema_version", "rulebook_version", F.col("deals").isNotNull().alias("deals_present"))
    return deals, header


def read_json_objects(spark: SparkSession, expected: DataFrame, pattern: str) -> DataFrame:
    """expected(path) -> body or the reason there is none: missing, bad JSON, not an object."""
    text = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("_full"), "value")
    rows = text.withColumn("path", F.regexp_replace("_full", r"^file:/+", "/"))
    joined = expected.join(rows.select("path", "value"), "path", "left")
    variant = strict_json(F.col("value"))
    reason = (
        F.when(F.col("value").isNull(), "missing").when(variant.isNull(), "bad_json")
        .when(~F.schema_of_variant(variant).startswith("OBJECT"), "top-level JSON value is not an object"))
    return joined.select(*expected.columns, F.when(reason.isNull(), F.col("value")).alias("body"), reason.alias("reason"))


def inventory(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File paths of an archive, files(path), as (artifacts, root entries).

    artifacts(deal_slug, run_id, name) are the files `{deal}/runs/{run}/{name}`; root entries (deal_slug, name)
    are what stands directly in a deal's folder, each once. Paths are relative to the archive.
    """
    parts = files.select(F.split(F.regexp_replace("path", "^/+", ""), "/").alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    artifacts = parts.filter((F.size("p") == 4) & (at(1) == "runs")).select(at(0).alias("deal_slug"), at(2).alias("run_id"), at(3).alias("name"))
    return artifacts, parts.filter(F.size("p") >= 2).select(at(0).alias("deal_slug"), at(1).alias("name")).distinct()


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder, paths relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    start = F.lit(f"/{folder.rstrip('/').split('/')[-1]}/")
    return files.select(F.element_at(F.split("path", start, 2), -1).alias("path"), "length")
