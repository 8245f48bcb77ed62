"""Session helpers: one place for the few settings and the shared checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tracewell") -> SparkSession:
    """A local session for tests and benches. On a cluster the caller passes its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # Python call sites on every column cost more than the plans themselves
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_base(spark: SparkSession) -> str:
    """The folder all machines share: the one `spark.checkpoint.dir` names.

    Where it is unset, a local session (tests, benches) gets a temporary folder, once per session.
    A session on a cluster is refused: a folder of the driver's machine is not seen by its tasks.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """The rows as compressed Parquet in the shared folder (or at `path`), read back with a short plan.

    A checkpoint would write whole uncompressed rows; for wide tables with repeated texts that is several times the bytes.
    """
    path = path or shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Staging:
    """Where results that several tables read are kept, so that each is computed once and plans stay short.

    Each stage is a Parquet table, in `folder` (a shared folder) under its name, else in a new folder of
    the session's shared one. It survives the loss of executors: a lost task re-reads, not re-runs.
    """
    folder: str | None = None

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        return stored(df, name, f"{self.folder.rstrip('/')}/{name}" if self.folder else None)
