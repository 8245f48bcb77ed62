"""Incremental intake (Z1): new payload files are bound, canonicalised and appended, each exactly once.

Keys (deal, rule version) that were taken before stand in a table beside the results, one narrow row per key,
which a batch reads to leave them out; nothing else of what came before is read. A batch writes its tables below `batch=<id>` and then one
commit record; readers follow the records, so they see a batch whole or not at all, and a batch that is
repeated after a failure replaces its own folders and its own record.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.plans.pipeline import finalize
from tracewell.session import Staging
from tracewell.sources.sinks import STORED_COLUMNS, GRAPH_KEY, storable

PAYLOAD_FILE = "deal_slug string, run_id string, rulebook_version string, payload string"
COMMIT = "batch int, payloads bigint, issues bigint"
KEY = ["deal_slug", "rulebook_version"]


def new_payloads(batch: DataFrame, taken: DataFrame) -> DataFrame:
    """One payload per (deal, rule version) that no earlier batch took: of those that come together that of the smallest run id.

    taken(deal_slug, rulebook_version) are the keys of the committed batches.
    """
    order = F.struct(F.coalesce("run_id", F.lit("")).alias("r"), F.coalesce("payload", F.lit("")).alias("p"), "run_id", "payload")
    first = batch.groupBy(*KEY).agg(F.min(order).alias("_first")).select(*KEY, "_first.run_id", "_first.payload")
    old = taken.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
    return first.join(old, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY], "left_anti")


def start_intake(
    spark: SparkSession, payload_folder: str, pages: DataFrame, targets: DataFrame, out_folder: str, checkpoint: str, stage_folder: str | None = None,
) -> StreamingQuery:
    """Reads JSON lines of PAYLOAD_FILE and runs the batch pipeline on the deals of each micro-batch.

    The file source's checkpoint takes each file once, the table of taken keys each key once. Only pages and
    targets of the batch's deals are read on.
    """
    spark.createDataFrame([], COMMIT).write.mode("ignore").parquet(f"{out_folder}/commits/start")
    spark.createDataFrame([], "deal_slug string, rulebook_version string").write.mode("ignore").parquet(f"{out_folder}/taken/batch=-1")
    source = spark.readStream.schema(PAYLOAD_FILE).json(payload_folder)

    def run(batch: DataFrame, batch_id: int) -> None:
        staging = Staging(f"{stage_folder}/{batch_id}" if stage_folder else None)
        # The batch's own record is left out: a batch that is repeated replaces itself.
        taken = read_intake(batch.sparkSession, out_folder, "taken", F.col("batch") != batch_id)
        todo = staging.keep("todo", new_payloads(batch, taken))
        if todo.isEmpty():
            return
        todo.select(*KEY).write.mode("overwrite").parquet(f"{out_folder}/taken/batch={batch_id}")
        todo = todo.drop("rulebook_version")
        deals = todo.select("deal_slug").distinct()
        graph = finalize(pages.join(deals, "deal_slug", "left_semi"), todo, targets.join(deals, "deal_slug", "left_semi"), staging=staging)
        for table in [*STORED_COLUMNS, "ledger"]:
            df = graph.get(GRAPH_KEY.get(table, table))
            if df is not None:
                rows = df if table == "ledger" else storable(df, table)
                rows.write.mode("overwrite").parquet(f"{out_folder}/{table}/batch={batch_id}")
        graph["issues"].write.mode("overwrite").parquet(f"{out_folder}/issues/batch={batch_id}")
        record = [(batch_id, todo.count(), graph["issues"].count())]
        batch.sparkSession.createDataFrame(record, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{out_folder}/commits/{batch_id}")  # last: now the batch is there

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, out_folder: str) -> DataFrame:
    """The commit records of an intake: (batch, payloads, issues)."""
    return spark.read.schema(COMMIT).parquet(f"{out_folder}/commits/*")


def read_intake(spark: SparkSession, out_folder: str, table: str, batches: Column | None = None) -> DataFrame:
    """Rows of one table of all committed batches, or of those of them that `batches` fits."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{out_folder}/{table}")
    done = committed(spark, out_folder).select("batch")
    return rows.join(done if batches is None else done.filter(batches), "batch", "left_semi").drop("batch")
