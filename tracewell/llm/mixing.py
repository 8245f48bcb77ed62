"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words and a schedule: a piecewise linear weight over training
time 0..1. The schedule is integrated once per source; the n-th word of a source is due at the
time where the integral reaches n / target, which is found by inverting the integral in closed
form. Documents are ordered inside their source by a hash, run through up to three passes, get
their time from their first word, and are range-sorted by it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm.common import SPACE_CHARS, SPACES

MAX_PASSES = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Schedules in the same order, repeating: (time, weight) knots from 0 to 1, straight lines between.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)),
)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, SPACES, -1))).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Source table (source, source_size) with order, weight and target.

    Targets share the total size by weight, but none exceeds `max_passes` times its source; what a
    full source leaves goes to the others by weight, until none is above. Closed form: sources fill
    up in the order of size per weight, so a source is full exactly if the level that the sources
    before it leave is at or above its own limit. The table has one row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_order") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_order", F.row_number().over(by_name) - 1).withColumn("_w", w)
    by_fill = Window.orderBy(F.col("source_size") / F.col("_w"), "_order")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * float(max_passes)
    step = ranked.withColumns({
        "_total": F.sum("source_size").over(everything).cast("double"),
        "_filled": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(max_passes),
        "_open": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    step = step.withColumn("_level", (F.col("_total") - F.col("_filled")) / F.col("_open"))
    step = step.withColumn("_full", F.col("_level") * F.col("_w") >= cap)
    level = F.min(F.when(~F.col("_full"), F.struct("_filled", "_level"))).over(everything)["_level"]
    return step.withColumn("target", F.when(F.col("_full"), cap).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("_w"))).select(
        "source", "source_size", "target", F.col("_order").alias("schedule"))


def _segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(t0, length, w0, slope, share before) of each piece, the whole integral being 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, t1 - t0, w0 / area, (w1 - w0) / (t1 - t0) / area, done))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def due_time(share: Column, schedule: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source with this schedule has handed out `share` (0..1) of its words.

    On a piece with weight w0 + slope * x the demand is w0 * x + slope * x^2 / 2; its inverse is
    2 * d / (w0 + sqrt(w0^2 + 2 * slope * d)), which also holds for slope 0.
    """
    result = F.lit(None).cast("double")
    for number, knots in enumerate(schedules):
        time = F.lit(None).cast("double")
        for t0, length, w0, slope, done in _segments(knots):
            d = F.greatest(share - F.lit(done), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * d, F.lit(0.0)))
            x = F.when(d > 0, 2 * d / (F.lit(w0) + root)).otherwise(F.lit(0.0))
            time = F.when(share >= F.lit(done), F.lit(t0) + F.least(x, F.lit(length))).otherwise(time)
        result = F.when(schedule % len(schedules) == number, time).otherwise(result)
    return result


def placed(docs: DataFrame, digits: int = 3, weights=WEIGHTS, schedules=SCHEDULES, max_passes: int = MAX_PASSES) -> DataFrame:
    """Per row of docs (doc_id, source, size, any more): source_size, target, taken, passes.

    `passes` is an array of (pass, words, time): each time the mix takes the document, with the
    words it takes then (fewer than `size` only where the source meets its target inside the
    document) and the due time of the first of them. Rows with equal ids are ordered by size and
    then are alike. Null sources are one source, the last. Empty documents are never taken, empty
    input gives no rows. The target is met to the word: it is rounded to whole words.

    The order inside a source is that of md5(doc_id). Its first hex digits cut each source into
    16^digits blocks whose sums are accumulated first, so no task holds a whole source.
    """
    keyed = docs.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn(
        "_block", F.substring("_h", 1, digits))
    blocks = keyed.groupBy("source", "_block").agg(F.sum("size").alias("_sum"))
    sources = targets(blocks.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_passes)
    so_far = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("source", "_block", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_offset"))
    plan = offsets.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select(
        F.col("o.source").alias("_source"), F.col("_block").alias("_b"), "_offset", "source_size", "target", "schedule")
    inside = Window.partitionBy("source", "_block").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_b")))
    before = F.col("_offset") + F.col("_in")
    goal = F.floor(F.col("target") + 0.5)
    every_pass = []
    for number in range(max_passes):
        start = before + F.col("source_size") * number
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - start)).cast("long")
        time = due_time(F.when(goal > 0, start / goal).otherwise(F.lit(0.0)), F.col("schedule"), schedules)
        every_pass.append(F.struct(F.lit(number).alias("pass"), words.alias("words"), time.alias("time")))
    rows = rows.withColumn("passes", F.filter(F.array(*every_pass), lambda p: p["words"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    keep = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*keep, "source_size", "target", taken.alias("taken"), "passes")


def mixed(docs: DataFrame, text: str = "text", partitions: int | None = None, **options) -> DataFrame:
    """The mix itself: the rows of docs in training order, once per pass, with the columns of docs.

    Positions are due times; rows are range-partitioned and sorted by them, so files in name order
    are the curriculum. The last document that a source can afford is cut after its last word; its
    n_chars, where there is such a column, follows. Nothing is collected.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # The caller's row travels as one struct, so its column names cannot clash with the ones made here.
    sized = docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.struct(*columns).alias("_row"))
    takes = placed(sized, **options).select("_row", "doc_id", "size", F.explode("passes").alias("_take"))
    head = F.call_function(
        "regexp_extract", F.col(f"_row.{text}"), F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("_take.words").cast("string"), F.lit("}+")), F.lit(0))
    cut = F.when(F.col("_take.words") < F.col("size"), head).otherwise(F.col(f"_row.{text}"))
    fields = {text: cut}
    if "n_chars" in docs.columns:
        whole = F.col("_take.words") == F.col("size")
        fields["n_chars"] = F.when(whole, F.col("_row.n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType)
    order = [F.col("_take.time"), F.col("doc_id"), F.col("_take.pass")]
    ranged = takes.repartitionByRange(partitions, *order) if partitions else takes.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).select(*[fields.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mixing_digest(docs: DataFrame) -> DataFrame:
    """The row per document of query op4, in the order of its first due time in the mix."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = placed(sized).select(
        "doc_id", "size", "source_size", "target", "taken", F.size("passes").alias("n_passes"), F.get(F.col("passes.time"), F.lit(0)).alias("_time"))
    return rows.repartitionByRange("_time", "doc_id").sortWithinPartitions("_time", "doc_id").drop("_time")
