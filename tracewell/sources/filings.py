"""Filings on disk: pages, manifests, seeds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.schemas import MANIFEST_JSON, PAGES_JSON, SEEDS_CSV

PAGE_MARK = r"\n<!-- PAGE (\d+) -->\n"


def deal_of_path() -> Column:
    """The folder a file lies in names its deal."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)


def read_pages(spark: SparkSession, pattern: str) -> DataFrame:
    """`{pattern}` -> pages.json files; array order becomes page_pos."""
    from pyspark.sql.types import ArrayType
    text = spark.read.text(pattern, wholetext=True).select(deal_of_path().alias("deal_slug"), "value")
    pages = F.from_json("value", ArrayType(PAGES_JSON))
    rows = text.select("deal_slug", F.posexplode(pages).alias("page_pos", "_p"))
    return rows.select("deal_slug", "page_pos", "_p.number", "_p.content")


def read_marked_text(spark: SparkSession, pattern: str) -> DataFrame:
    """Flat text with page marks -> pages."""
    text = spark.read.text(pattern, wholetext=True).select(deal_of_path().alias("deal_slug"), "value")
    numbers = F.regexp_extract_all("value", F.lit(PAGE_MARK), F.lit(1))
    bodies = F.split("value", r"\n<!-- PAGE \d+ -->\n")
    rows = text.select("deal_slug", numbers.alias("number"), F.slice(bodies, 2, F.size(bodies)).alias("content"))
    rows = rows.select("deal_slug", F.posexplode(F.arrays_zip("number", "content")).alias("page_pos", "_p"))
    return rows.select("deal_slug", "page_pos", F.col("_p.number").cast("int").alias("number"), "_p.content")


def marked_text(pages: DataFrame) -> DataFrame:
    """Pages -> flat text per deal (one file per deal is the format)."""
    piece = F.concat(F.lit("\n<!-- PAGE "), F.col("number"), F.lit(" -->\n"), F.coalesce("content", F.lit("")))
    grouped = pages.groupBy("deal_slug").agg(F.array_sort(F.collect_list(F.struct("page_pos", piece.alias("t")))).alias("p"))
    return grouped.select("deal_slug", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))


def page_content(pages: DataFrame, number: int) -> DataFrame:
    return pages.filter(F.col("number") == number).select("deal_slug", F.coalesce("content", F.lit("")).alias("content"))


def page_numbers(pages: DataFrame) -> DataFrame:
    return pages.select("deal_slug", "number").distinct()


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """S3: manifests with the target name (blank -> null)."""
    rows = spark.read.schema(MANIFEST_JSON).option("multiLine", True).json(pattern)
    return rows.select(
        F.coalesce("slug", deal_of_path()).alias("deal_slug"), F.when(F.trim("target_name") != "", F.col("target_name")).alias("target_name"),
        "acquirer", "date_announced", "is_reference", "source", "artifacts", "fetch",
        F.struct(*[F.col(f.name) for f in MANIFEST_JSON]).alias("manifest"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    rows = spark.read.schema(SEEDS_CSV).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.withColumn("is_reference", F.lower(F.trim("is_reference")) == "true")
