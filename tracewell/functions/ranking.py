"""Order numbers and running totals that do not put a whole group into one task.

A plain window over `deal_slug` sorts the largest deal in one task. Both helpers first
count (or sum) per small block of the order, accumulate the blocks, and only then order
the rows inside a block. The result is the same number a plain window would give.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordinal(df: DataFrame, keys: list[str], levels: list[str], within: list[Column], out: str = "ordinal") -> DataFrame:
    """1..n per `keys`, ordered by the columns `levels`, then by `within`.

    `levels` are columns of df, not null, coarse to fine; each splits the blocks of the one before.
    """
    blocks = df.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("_rows"))
    offset = blocks
    for depth in range(len(levels)):
        parent, level = keys + levels[:depth], levels[depth]
        before = Window.partitionBy(*parent).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        if depth == len(levels) - 1:
            offset = offset.withColumn(f"_before{depth}", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        else:
            totals = (
                blocks.groupBy(*parent, level).agg(F.sum("_rows").alias("_n"))
                .withColumn(f"_before{depth}", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                .drop("_n")
            )
            offset = offset.join(totals, parent + [level])
    total = sum((F.col(f"_before{d}") for d in range(1, len(levels))), F.col("_before0"))
    offset = offset.select(*keys, *levels, total.alias("_offset"))
    inside = Window.partitionBy(*keys, *levels).orderBy(*within)
    return (
        df.join(offset, keys + levels)
        .withColumn(out, F.col("_offset") + F.row_number().over(inside))
        .drop("_offset")
    )


def running_total(df: DataFrame, keys: list[str], position: str, values: dict[str, str], block: int = 4096) -> DataFrame:
    """For each row the sums of `values` over all earlier positions of its key (0 for the first).

    `position` is an integer that is unique per key. `values` maps value column -> output column;
    values must not be negative.
    """
    outs = list(values.values())
    earlier_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier_rows = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_block", F.floor(F.col(position) / block))
    inner = inner.select("*", *[F.coalesce(F.sum(v).over(earlier_rows), F.lit(0)).alias(f"_in_{o}") for v, o in values.items()])
    # The block sum is read off the window itself, so both branches share one exchange of `df`.
    sums = inner.groupBy(*keys, "_block").agg(*[F.max(F.col(f"_in_{o}") + F.col(v)).alias(f"_sum_{o}") for v, o in values.items()])
    base = sums.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_sum_{o}").over(earlier_blocks), F.lit(0)).alias(f"_base_{o}") for o in outs])
    out = inner.join(base, keys + ["_block"])
    return out.select(
        *df.columns, *[(F.col(f"_base_{o}") + F.col(f"_in_{o}")).alias(o) for o in outs])
