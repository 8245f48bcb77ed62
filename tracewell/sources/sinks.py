"""Writing results (S10-S14): partitioned tables, JSON lines, CSV, append-only logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StructType, VariantType

from tracewell.schemas import LEDGER_FIELDS, REVIEW_FIELDS, STORED_COLUMNS

# Keys under which stored rows are unique; other tables drop exact duplicates.
UNIQUE = {
    "row_evidence": ["deal_slug", "run_id", "row_table", "row_id", "evidence_id"],
    "claim_evidence": ["deal_slug", "run_id", "claim_id", "evidence_id"],
    "claim_coverage_links": ["deal_slug", "run_id", "claim_id", "obligation_id"],
}
#: Rows that were numbered or grouped by a key before: no two of them are equal.
DISTINCT = ("spans", "coverage_results", "actors", "review_rows")
GRAPH_KEY = {"spans": "evidence"}


def storable(df: DataFrame, table: str) -> DataFrame:
    """Only stored columns; booleans as integers, nested values as JSON; duplicates dropped."""
    wanted = ["deal_slug", "run_id"] + [c for c in STORED_COLUMNS[table] if c not in ("deal_slug", "run_id")]
    cells = []
    for name in [c for c in wanted if c in df.columns]:
        kind = df.schema[name].dataType
        if isinstance(kind, BooleanType):
            cells.append(F.col(name).cast("int").alias(name))
        elif isinstance(kind, (StructType, ArrayType, MapType, VariantType)):
            cells.append(F.to_json(name).alias(name))
        else:
            cells.append(F.col(name))
    rows = df
    if table in UNIQUE:
        # the first of equal keys: lowest ordinal where there is one
        keys = UNIQUE[table]
        if "ordinal" in df.columns:
            grouped = rows.select(*keys, F.struct("ordinal").alias("_o"), F.struct(*cells).alias("_r")).groupBy(*keys).agg(F.min(F.struct("_o", "_r"))["_r"].alias("_r"))
            return grouped.select("_r.*")
        return rows.select(*cells).dropDuplicates(keys)
    return rows.select(*cells) if table in DISTINCT else rows.select(*cells).distinct()


def write_graph(graph: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Every stored table, in ranges of deal and run so that one deal's rows lie in few files."""
    for table in STORED_COLUMNS:
        df = graph.get(GRAPH_KEY.get(table, table))
        if df is not None:
            storable(df, table).repartitionByRange("deal_slug", "run_id").write.mode(mode).parquet(f"{folder}/{table}")


def write_snapshots(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """JSON snapshot rows, one partition folder per deal."""
    df.write.mode(mode).partitionBy("deal_slug").json(folder)


def write_review_jsonl(review: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """S11."""
    review.select(*REVIEW_FIELDS).write.mode(mode).option("ignoreNullFields", False).json(folder)


def _write_csv(df: DataFrame, folder: str, mode: str) -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(folder)


def write_review_csv(review: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """48 columns, header, RFC 4180 quoting."""
    _write_csv(review.select(*REVIEW_FIELDS), folder, mode)


def write_ledger_csv(ledger: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """28 columns, in deal and order number; range partitions keep the order across files."""
    ordered = ledger.select(*LEDGER_FIELDS).repartitionByRange("deal_slug", "event_order").sortWithinPartitions("deal_slug", "event_order")
    _write_csv(ordered, folder, mode)


def flag_log_entries(validation_flags: DataFrame, review_flags: DataFrame, logged_at: str) -> DataFrame:
    """The flags of a batch as log entries; deal-level flags are marked."""
    deal = validation_flags.select("deal_slug", "run_id", "severity", "code", "reason", "row_table", "row_id", F.lit(True).alias("deal_level"))
    graph = review_flags.select(
        "deal_slug", "run_id", "flag_id", "severity", "code", "reason", "row_table", "row_id", "status", "current", F.to_json("metadata").alias("metadata"))
    return deal.unionByName(graph, allowMissingColumns=True).withColumn("logged_at", F.lit(logged_at)).withColumnRenamed("deal_slug", "deal")


def append_flag_log(entries: DataFrame, folder: str) -> None:
    entries.write.mode("append").json(folder)
