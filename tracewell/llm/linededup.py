"""Repeated runs of lines, found in a suffix array over line ids that prefix doubling builds.

The lines of all documents, blank ones left out, are sequences of line ids, one per document. A suffix
is ranked by its first line, then by its first 2, 4, 8 ... lines: the rank for twice the length is the
order number of the pair (rank here, rank one length further on). Suffixes of equal rank are an interval
of the suffix array, their common prefix has at least that length. Suffixes alone in their interval
repeat nothing and leave at once; the doubling ends when every interval holds one suffix.

The first suffix of an interval, by (document, place), is its original; for every later one the interval
gives a length with an earlier copy. The greatest such length of each place, its longest common prefix
with any earlier suffix, lies between the power of two of its last interval and the next one. It is found
by names: a run of length l in an interval of level k is the pair (rank at its start, rank 2^k lines
before its end), so a wanted length is one more interval with a first suffix. First the longest length
that the places behind allow is tried, once per stretch; where that has no earlier copy the rest is
searched by halves. Ends of these runs never decrease along a document, so the first place of each end
begins a maximal repeated run. Maximal runs of at least `min_words` words are deleted, that is every later
copy of a line run, and they are what is reported.

Only DataFrame operations are used. Groups are reduced to minima map-side; a line, run or document
however frequent is never gathered. A group of g suffixes at level k meets only the lengths asked in it,
at most 2^k of them.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tracewell.functions.ranking import ordinal
from tracewell.llm.common import NON_SPACE, SPACE_CHARS, SPACES, stage_table

#: Words of the shortest run that is deleted; 1: every line with a word counts.
MIN_WORDS = 1
#: Null doc_ids come last; their texts tell them apart.
LAST = (1 << 63) - 1
#: Blocks by which ranks are numbered: the upper bits of the order.
BLOCK_BITS = 10
#: A document is its id and the hash of its text; `place` counts its lines that have words, from 0.
DOCUMENT = ["doc", "part"]
PLACE = [*DOCUMENT, "place"]


def _line_array(text: str) -> str:
    """SQL: the lines with a word, as structs (no: number among all lines, line)."""
    return f"filter(transform(split(coalesce({text}, ''), '\\n', -1), (l, i) -> struct(i as no, l as line)), x -> x.line rlike '{NON_SPACE}')".replace("\\x", "\\\\x")


def _document(text: str) -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.expr(f"xxhash64(coalesce({text}, ''))").alias("part")]


def line_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, part, place, id, id2, words) per line with a word; id and id2 are two hashes of the line."""
    spaces = SPACES.replace("\\", "\\\\")
    rows = docs.select(*_document(text), F.expr(f"posexplode({_line_array(text)}) as (place, x)"))
    return rows.selectExpr(
        *DOCUMENT, "cast(place as long) as place", "xxhash64(x.line) as id", "xxhash64(7, x.line) as id2",
        f"cast(size(split(btrim(x.line, '{SPACE_CHARS}'), '{spaces}', -1)) as long) as words")


def _ranked(rows: DataFrame, left: str, right: str, shift: int) -> DataFrame:
    """(doc, part, place, rank, later): order number of the pair (left, right), for pairs at two places or more."""
    pairs = rows.groupBy(left, right).agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("end")).where("first < end").select(
        left, right, "first", F.shiftright(left, shift).alias("_b1"), F.shiftright(right, shift).alias("_b2"))
    numbered = ordinal(stage_table(pairs, "pairs"), [], ["_b1", "_b2"], [F.col(left), F.col(right)], "_number").select(left, right, "first", "_number")
    return rows.join(numbered, [left, right]).select(*PLACE, F.col("_number").alias("rank"), (F.struct(*PLACE) > F.col("first")).alias("later"))


def _bits(count: int) -> int:
    return max(0, count.bit_length() - BLOCK_BITS)


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """Item k: (doc, part, place, rank, later) of the suffixes whose first 2^k lines repeat; the last item is not empty.

    Equal ranks are one interval of the suffix array, ranks are in its order; later: not the first of
    its interval. Repeated rows of a document are one. Each round is stored.
    """
    ranks = []
    table = stage_table(_ranked(lines, "id", "id2", 64 - BLOCK_BITS).distinct(), "ranks")
    while (size := table.agg(F.max("rank")).first()[0]) is not None:
        ranks.append(table)
        further = table.select(*DOCUMENT, (F.col("place") - (1 << len(ranks) - 1)).alias("place"), F.col("rank").alias("next"))
        table = stage_table(_ranked(table.drop("later").join(further, PLACE), "rank", "next", _bits(size)), "ranks")
    return ranks


def _with_earlier_copy(ranks: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, part, place, want) of asked (.., level, rank, want) whose run of `want` lines begins at an earlier place too.

    ranks(level, doc, part, place, rank); want lies between 2^level and twice that, so the ranks at its
    start and 2^level lines before its end name the run.
    """
    lengths = asked.select("level", "rank", "want").distinct()
    tails = ranks.select("level", *DOCUMENT, F.col("place").alias("tail"), F.col("rank").alias("last"))
    members = ranks.join(lengths, ["level", "rank"]).withColumn("tail", F.expr("place + want - shiftleft(1L, level)"))
    named = stage_table(members.join(tails, ["level", *DOCUMENT, "tail"]).drop("tail"), "named")
    name = ["level", "rank", "last", "want"]
    firsts = stage_table(named.groupBy(*name).agg(F.min(F.struct(*PLACE)).alias("first")), "firsts")
    later = named.join(firsts, name).where(F.struct(*PLACE) > F.col("first")).select(*PLACE, "want")
    return later.join(asked.select(*PLACE, "want"), [*PLACE, "want"], "left_semi")


def repeated_runs(lines: DataFrame) -> DataFrame | None:
    """(doc, part, place, stop): the maximal runs that have an earlier copy, places from `place` up to before `stop`.

    Maximal: longer at neither end with an earlier copy of the whole. None if no line repeats.
    """
    rounds = suffix_ranks(lines)
    if not rounds:
        return None
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    ranks = union([t.select(F.lit(k).alias("level"), *PLACE, "rank") for k, t in enumerate(rounds)])
    later = union([t.where("later").select(F.lit(k).alias("level"), *PLACE, "rank") for k, t in enumerate(rounds)])
    # Neighbouring places that have an earlier copy of 2^level lines: no run from one of them goes on behind the last.
    along = Window.partitionBy("level", *DOCUMENT).orderBy("place")
    stretches = later.withColumn("island", F.col("place") - F.row_number().over(along)).withColumn(
        "limit", F.max("place").over(Window.partitionBy("level", *DOCUMENT, "island")) + F.expr("shiftleft(1L, level)"))
    # The last interval of each place, and the bound its next power of two sets.
    top = stretches.groupBy(*PLACE).agg(F.max(F.struct("level", "rank", "limit")).alias("t")).select(*PLACE, "t.level", "t.rank", "t.limit")
    state = stage_table(top.withColumn("limit", F.expr("least(limit, place + shiftleft(2L, level) - 1)")), "lengths")
    # Once per limit, for the first place that may reach it: if it does, so do all places behind it.
    firsts = state.groupBy(*DOCUMENT, "limit").agg(F.min(F.struct("place", "level", "rank")).alias("t")).select(
        *DOCUMENT, "t.place", "t.level", "t.rank", (F.col("limit") - F.col("t.place")).alias("want"))
    short = firsts.where("want = shiftleft(1L, level)")
    proven = _with_earlier_copy(ranks, firsts.where("want > shiftleft(1L, level)"))
    done = stage_table(short.select(*PLACE, "want").union(proven).select(*PLACE, (F.col("place") + F.col("want")).alias("stop")), "runs")
    found = [done]
    open_ = state.join(done.select(*DOCUMENT, F.col("stop").alias("limit")), [*DOCUMENT, "limit"], "left_anti")
    open_ = stage_table(open_.select(*PLACE, "level", "rank", F.expr("shiftleft(1L, level)").alias("size")), "lengths")
    highest = open_.agg(F.max("level")).first()[0]
    for step in reversed(range(highest or 0)):
        asked = open_.where(F.col("level") > step).withColumn("want", F.col("size") + (1 << step))
        longer = _with_earlier_copy(ranks.where(F.col("level") > step), asked)
        open_ = stage_table(open_.join(longer, PLACE, "left").withColumn("size", F.coalesce("want", "size")).drop("want"), "lengths")
    found.append(open_.select(*PLACE, (F.col("place") + F.col("size")).alias("stop")))
    return union(found).groupBy(*DOCUMENT, "stop").agg(F.min("place").alias("place")).select(*PLACE, "stop")


def deleted_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, part, runs): per document the maximal runs with an earlier copy, as an array of (place, stop) in order.

    Ends grow with the starts. A document has at most as many runs as lines.
    """
    lines = stage_table(line_table(docs, text), "lines")
    runs = repeated_runs(lines)
    if runs is None:
        runs = lines.limit(0).select(*PLACE, F.col("place").alias("stop"))
    if min_words > 1:
        total = F.sum("words").over(Window.partitionBy(*DOCUMENT).orderBy("place"))
        sums = stage_table(lines.select(*PLACE, "words").distinct().withColumn("upto", total), "sums")
        ends = sums.select(*DOCUMENT, (F.col("place") + 1).alias("stop"), F.col("upto").alias("through"))
        runs = runs.join(sums, PLACE).join(ends, [*DOCUMENT, "stop"]).where(f"through - upto + words >= {min_words}")
    return runs.groupBy(*DOCUMENT).agg(F.array_sort(F.collect_list(F.struct("place", "stop"))).alias("runs"))


def without_repeated_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of docs as a struct `row`, with `kept` (the text without later copies), n_lines, n_removed, runs.

    runs: array of (start, length) of the maximal repeated runs that have an earlier copy, start by line
    number, length in lines with a word; runs may overlap, a line goes once. Order is that of doc_id, nulls
    last, then of the text's hash, then of the line; rows with equal doc_id and text are one document and
    get equal results. Null texts stay null; texts without repeats stay as they are. Blank lines take no
    part and stay. Whole texts, however long.
    """
    gone = deleted_runs(docs.select("doc_id", F.col(text).alias("text")), "text", min_words)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_document(f"`{text}`"), F.col(text).alias("text"))
    joined = rows.join(gone, DOCUMENT, "left").withColumns({
        "runs": F.expr("coalesce(runs, array())"),
        "all": F.expr("split(text, '\\n', -1)"), "nonblank": F.expr(f"transform({_line_array('text')}, x -> x.no)")})
    joined = joined.withColumn("own", F.expr(
        "flatten(transform(runs, (r, i) -> sequence(greatest(r.place, coalesce(get(runs, i - 1).stop, r.place)), r.stop - 1)))"))
    joined = joined.withColumn("dead", F.expr("transform(own, p -> get(nonblank, cast(p as int)))"))
    joined = joined.withColumns({
        "starts": F.expr("filter(dead, (x, i) -> coalesce(get(dead, i - 1) <> x - 1, true))"),
        "ends": F.expr("filter(dead, (x, i) -> coalesce(get(dead, i + 1) <> x + 1, true))")})
    pieces = """flatten(transform(sequence(0, size(starts)), k -> slice(all,
        coalesce(get(ends, k - 1) + 1, 0) + 1, coalesce(get(starts, k), size(all)) - coalesce(get(ends, k - 1) + 1, 0))))"""
    return joined.select(
        "row", F.expr(f"CASE WHEN size(dead) = 0 THEN text ELSE array_join({pieces}, '\\n') END").alias("kept"),
        F.expr("cast(if(text is null, 0, size(all)) as long)").alias("n_lines"), F.expr("cast(size(dead) as long)").alias("n_removed"),
        F.expr("transform(runs, r -> struct(get(nonblank, cast(r.place as int)) as start, cast(r.stop - r.place as int) as length))").alias("runs"))


def cleaned(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated runs taken out of `text`; n_chars, where there is one, follows."""
    rows = without_repeated_runs(docs, text, min_words)
    fields = {text: F.col("kept")}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[fields.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def line_digest(docs: DataFrame) -> DataFrame:
    """Query op10: doc_id, n_lines, n_removed, n_runs, kept_sha256 (null texts: of the empty string)."""
    return without_repeated_runs(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.size("runs").cast("long").alias("n_runs"),
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
