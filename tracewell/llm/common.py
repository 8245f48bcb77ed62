"""Small pieces that the training-data operators share."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tracewell.session import shared_folder

#: White space of all word rules here: blank, tab, line feed, vertical tab, form feed, return.
SPACE_CHARS = " \t\n\u000b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the given tables, read whole; with `columns` only these reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none. Only ASCII white space parts words."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACES, -1)).otherwise(F.array().cast("array<string>"))


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder of the cluster, read back: cuts lineage, keeps column pruning."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers, once per application, as spark-submit --py-files would.

    The archive is the driver's own file; Spark's file server takes it to the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="py-files-"), "tracewell_llm_files.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def map_pandas(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """mapInPandas for functions of this package."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)
