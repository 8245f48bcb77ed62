"""What readers of the ledger ask."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

EMPTY = "∅ (empty)"
TOP = 12  # part of the feature: the profile lists the twelve most frequent values
PARTS = 1024


def register_views(graph: dict[str, DataFrame]) -> None:
    """The graph as temp views, for plain SQL."""
    for name, df in graph.items():
        df.createOrReplaceTempView(name)


ACTORS_SQL = "SELECT deal_slug, run_id, actor_label, actor_kind, bidder_class FROM actors"
EVENTS_SQL = (
    "SELECT e.deal_slug, e.run_id, e.event_subtype, e.event_date, l.actor_label FROM events e "
    "LEFT JOIN event_actor_links l USING (deal_slug, run_id, event_id) ORDER BY e.event_date NULLS LAST")
COUNTS_SQL = "SELECT deal_slug, run_id, process_stage, actor_class, count_min, count_max, count_qualifier FROM participation_counts"
UNSUPPORTED_SQL = (
    "SELECT c.deal_slug, c.run_id, c.claim_id, c.claim_type, d.disposition, d.reason FROM claims c "
    "JOIN claim_dispositions d USING (deal_slug, run_id, claim_id) WHERE d.disposition <> 'supported' AND d.current = true")


def column_profile(rows: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """The most frequent values of a column with their share. Ties by value."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(EMPTY))
    counts = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.orderBy(F.col("n").desc(), "value").limit(top).select(
        F.lit(column).alias("column_name"), "value", "n", (F.col("n") / total).alias("share"))


def _split(values: DataFrame, part: Column) -> list:
    """Parts of (v) in order, each with its number of values, least and greatest."""
    parts = values.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return sorted(parts.collect(), key=lambda r: r["part"])


def _part_of(parts: list, rank: int) -> tuple[int, float, float]:
    """(rank inside, least, greatest) of the part that holds the rank."""
    for p in parts:
        if rank <= p["n"]:
            return rank, p["lo"], p["hi"]
        rank -= p["n"]
    raise ValueError("rank beyond the values")


def order_statistics(rows: DataFrame, column: str, ranks: Callable[[int], list[int]]) -> tuple[int, float | None, float | None, list[float]]:
    """(count, least, greatest, values at `ranks(count)`, 1-based) of a numeric column, exactly, by radix refinement.

    The values are counted by sign and power of two, the part that holds a rank is cut into PARTS equal
    ranges between its own least and greatest value, and so on until they are equal. A pass is one count
    with at most a few thousand groups over a filtered scan; after the first one a part spans a factor of two, so
    the 53 bits of a double are settled in at most six more, whatever the distribution: neither an outlier
    nor a value that a third of the rows hold makes a task large. Null and NaN are no values.
    """
    v = F.col("v")
    values = rows.select(F.col(column).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan("v"))
    finite = F.abs(v) < float("inf")
    power = F.when(v == 0, 0).when(finite, F.signum(v) * (F.floor(F.log2(F.abs(v))) + 2000)).otherwise(F.signum(v) * 9000).cast("int")
    parts = _split(values, power)
    count, found = sum(p["n"] for p in parts), []
    for rank in ranks(count) if count else []:
        inside, lo, hi = _part_of(parts, rank)
        while lo < hi:
            place = F.least(F.floor((v - lo) / (hi - lo) * PARTS), F.lit(PARTS - 1)).cast("int")
            inside, lo, hi = _part_of(_split(values.filter(v.between(lo, hi)), place), inside)
        found.append(lo)
    return count, parts[0]["lo"] if parts else None, parts[-1]["hi"] if parts else None, found


def number_profile(rows: DataFrame, column: str) -> DataFrame:
    """Count, minimum, upper median and maximum of a numeric column, exactly; no row without values."""
    n, least, most, median = order_statistics(rows, column, lambda count: [count // 2 + 1])
    found = [(column, n, least, median[0], most)] if n else []
    return rows.sparkSession.createDataFrame(found, "column_name string, n bigint, min double, median double, max double")


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """The values of a filter list, in order."""
    return rows.select(column).distinct().orderBy(column)


def ledger_composition(ledger: DataFrame) -> DataFrame:
    """Rows per event code."""
    return ledger.groupBy("event_code").agg(F.count(F.lit(1)).alias("rows"))


def deal_sizes(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("deal_slug").agg(F.count(F.lit(1)).alias("rows"))


def browse(ledger: DataFrame, deal: str = "", code: str = "", text: str = "") -> DataFrame:
    """Filter by deal, by code, and by a substring of any cell, ignoring case."""
    rows = ledger
    if deal:
        rows = rows.filter(F.col("deal_slug") == deal)
    if code:
        rows = rows.filter(F.col("event_code") == code)
    if text:
        cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ledger.columns])
        rows = rows.filter(F.exists(cells, lambda c: F.lower(c).contains(text.lower())))
    return rows


def sort_browse(rows: DataFrame, column: str, numeric: bool, descending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Numbers with blanks lowest, text without regard to case; equal keys in the order of the columns `ties`, either way."""
    key = F.col(column).cast("string").try_cast("double") if numeric else F.lower(F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), *(ties or []))


def embed_order(rows: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """By deal, then order number; numbers that do not parse come last; then by the columns `ties`."""
    return rows.orderBy("deal_slug", F.col("event_order").cast("string").try_cast("int").asc_nulls_last(), *(ties or []))
