"""A set of keys as a bitmap of fixed size, so that rows that surely have none of the keys are not moved."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.session import stored

WORDS = 1 << 20  # of 64 bits: what all tasks get is at most a million rows of two numbers, whatever the number of keys


def _place(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(64 * WORDS))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


class KeySet:
    """Which rows may hold one of the keys: never wrong about a key, now and then (the more keys, the oftener) about another row.

    Equal keys are hashed alike, so the columns must have the same types on both sides. What a set lets pass is joined as before.
    """

    def __init__(self, keys: DataFrame, columns: list[str]) -> None:
        place = keys.select(_place(columns).alias("_place"))
        words = place.groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(_bit(F.col("_place"))).alias("_bits"))
        self._words, self._columns = stored(words, "keyset"), columns

    def marked(self, rows: DataFrame, out: str) -> DataFrame:
        """The rows with a column `out`: false if a row surely has none of the keys."""
        place = _place(self._columns)
        probed = rows.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(self._words), "_word", "left")
        return probed.select(*rows.columns, F.coalesce(F.col("_bits").bitwiseAND(_bit(place)) != 0, F.lit(False)).alias(out))

    def kept(self, rows: DataFrame) -> DataFrame:
        """The rows that may have one of the keys."""
        return self.marked(rows, "_may").filter("_may").drop("_may")
