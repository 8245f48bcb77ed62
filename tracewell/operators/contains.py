"""Exact substring search between two tables without comparing every pair (J3, J4 blocking).

Every whole token inside a quote (not its first or last) is a whole token of any text that
holds the quote. So quotes and texts meet on three-token shingles, and each quote is looked up under
its rarest key only. Quotes of three and four tokens have one key: their inner tokens with the
characters that must stand next to them. A quote of one or two tokens has no inner token: its longest
part lies inside some token, so it is searched in the distinct tokens first; one of white space alone
is searched in the distinct runs of white space. Every meeting is verified on the text itself.
Nothing is capped.

Texts and quotes meet under 64-bit ids and keys that hold the scope too, so the rows of the index are
two numbers. Ids that collide by chance only add meetings, and the verification sorts them out.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.keyset import KeySet
from tracewell.functions.text import SPACE, UNICODE, is_blank, let
from tracewell.session import stored

_MIN_TOKENS = 5
EDGE = 3
_KEYS = 8  # of a quote's keys so many are counted, in hash order, and the rarest of them is used
_FEW = 500_000  # so many rows of a few numbers are sent to all tasks; more are met by a shuffle


def overlapping_count(text: Column, quote: Column) -> Column:
    """Occurrences of a non-empty quote, overlaps counted."""
    literal = F.concat(F.lit("\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_count(text, F.concat(F.lit("(?="), literal, F.lit(")")))


def plain_count(text: Column, quote: Column) -> Column:
    """Occurrences of a non-empty quote, counted left to right without overlap."""
    return ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("int")


def token_array(text: Column) -> Column:
    """Tokens between white space; empty at an end that is white space."""
    return F.split(text, f"{UNICODE}{SPACE}+")


def _grams(parts: Column, size: int) -> Column:
    """Distinct hashed runs of `size` neighbours of an array."""
    def build(p: Column) -> Column:
        count = F.size(p) - (size - 1)
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(p, i + k) for k in range(size)]))
        return F.array_distinct(F.when(count > 0, runs).otherwise(F.array().cast("array<bigint>")))
    return let(parts, build)


def _inner_tokens(quote: Column) -> Column:
    return let(token_array(quote), lambda t: F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0))))


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _few(rows: DataFrame, limit: int = _FEW) -> DataFrame:
    """The rows (a stored table), marked for broadcast if they are few; the index then stays where it is."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def _with_id(rows: DataFrame, scope: list[str], of: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.xxhash64(*scope, of))


def _meet(quotes: DataFrame, texts: DataFrame, scope: list[str], quote_keys: Column, text_keys: Column) -> DataFrame:
    """Candidate (qid, tid) under the rarest of `_KEYS` keys of each quote."""
    key = F.xxhash64(*scope, "key").alias("key")
    first = F.slice(F.array_sort(quote_keys), 1, _KEYS)
    keys = stored(quotes.select(*scope, "qid", F.explode(first).alias("key")).select("qid", key), "keys")
    wanted = stored(keys.select("key").distinct(), "wanted")
    # Kept: the texts are taken apart once, and only the keys some quote asks for remain.
    index = texts.select(*scope, "tid", F.explode(text_keys).alias("key")).select("tid", key)
    hits = stored(KeySet(wanted, ["key"]).kept(index).join(_few(wanted), "key", "left_semi"), "hits")
    frequency = hits.groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    # A key no text has rules the quote out: it sorts first and then meets nothing.
    ranked = keys.join(frequency, "key", "left")
    rarest = ranked.groupBy("qid").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("n"), "key")).alias("k"))
    rarest = rarest.filter("k.n > 0").select("qid", F.col("k.key").alias("key"))
    return hits.join(rarest, "key").select("qid", "tid")


def _meet_in_tokens(quotes: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """Candidates of quotes without an inner token: texts with a token that holds the quote's longest part."""
    longest = F.array_max(F.transform(token_array(F.col("quote_text")), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    quotes = quotes.withColumn("part", longest)
    parts = _with_id(quotes.select(*scope, "part").distinct(), scope, "part", "qid")
    index = texts.select(*scope, F.col("tid").alias("holder"), F.explode(F.array_distinct(token_array(F.col("text")))).alias("token"))
    words = _with_id(stored(index.select(*scope, "token").distinct(), "tokens"), scope, "token", "tid")
    size, chars = F.size("c"), F.col("c")
    grams = F.when(size >= 3, _grams(chars, 3)).when(size == 2, _grams(chars, 2)).otherwise(_grams(chars, 1))
    sizes = [r["n"] for r in parts.select(F.greatest(F.least(F.length("part"), F.lit(3)), F.lit(1)).alias("n")).distinct().collect()]  # three at most
    met = _meet(
        parts.withColumn("c", _characters(F.col("part"))), words.withColumn("c", _characters(F.col("token"))), scope, grams,
        F.concat(*[_grams(chars, n) for n in sorted(sizes)]))
    found = met.join(parts, "qid").join(words, scope + ["tid"]).filter(F.col("token").contains(F.col("part")))
    found = stored(found.select(*scope, "part", "token"), "tokens-found")
    holders = KeySet(found, scope + ["token"]).kept(index).join(_few(found, _FEW // 10), scope + ["token"]).select(*scope, "part", F.col("holder").alias("tid")).distinct()
    return holders.join(quotes.select(*scope, "part", "qid"), scope + ["part"]).select("qid", "tid")


def _edge_key(tokens: Column, at: Column, count: int, left: int, right: int) -> Column:
    """Key of `count` neighbours from place `at`; null where they do not reach or the outer ones are too short.

    The key holds all but the outer two tokens whole and of these the nearest `left` and `right` (0 or 1) characters.
    """
    first, last = F.get(tokens, at), F.get(tokens, at + (count - 1))
    fits = (F.length(first) >= left) & (F.length(last) >= right)
    inner = [F.get(tokens, at + i) for i in range(1, count - 1)]
    return F.when(fits, F.xxhash64(F.lit(count), F.lit(left), F.right(first, F.lit(left)), *inner, F.left(last, F.lit(right))))


def _meet_on_edges(quotes: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """Candidates of quotes of three and four tokens, each under one key.

    The key holds the inner tokens and one character of each outer one, if the quote has it. So a quote has
    one of eight shapes, and texts are cut into keys of the shapes that occur. Up to EDGE characters
    of the outer tokens are compared where a key meets.
    """
    t = F.col("t")
    parts = quotes.select(*scope, "qid", token_array(F.col("quote_text")).alias("t")).select(
        *scope, "qid", "t", F.size(t).alias("k"),
        F.least(F.lit(1), F.length(F.get(t, F.lit(0)))).alias("a"), F.least(F.lit(1), F.length(F.element_at(t, -1))).alias("b"))
    shapes = [(r["k"], r["a"], r["b"]) for r in parts.select("k", "a", "b").distinct().collect()]
    own = F.lit(None).cast("bigint")
    for k, a, b in sorted(shapes):
        own = F.when((F.col("k") == k) & (F.col("a") == a) & (F.col("b") == b), _edge_key(t, F.lit(0), k, a, b)).otherwise(own)
    keys = stored(parts.select(
        "qid", F.xxhash64(*scope, own).alias("key"), F.right(F.get(t, F.lit(0)), F.lit(EDGE)).alias("ql"), F.left(F.element_at(t, -1), F.lit(EDGE)).alias("qr")), "edges")
    # A row per place, not an array of keys per text: what no quote asks for is left out before its edges are cut.
    # (outer: else the texts would be split once more, to filter those without a place)
    i, fewest = F.col("i"), min(k for k, _, _ in shapes)
    places = texts.select(*scope, "tid", token_array(F.col("text")).alias("t"))
    places = places.select(*scope, "tid", "t", F.explode_outer(F.when(F.size("t") >= fewest, F.sequence(F.lit(0), F.size("t") - fewest))).alias("i"))
    listed = F.array(*[F.struct(F.lit(shape[0]).alias("k"), _edge_key(t, i, *shape).alias("e")) for shape in sorted(shapes)])
    index = places.select(*scope, "tid", "t", "i", F.explode_outer(listed).alias("x")).filter("x.e is not null")
    index = KeySet(keys, ["key"]).kept(index.select("tid", "t", "i", "x.k", F.xxhash64(*scope, "x.e").alias("key")))
    index = index.select("tid", "key", F.right(F.get(t, i), F.lit(EDGE)).alias("l"), F.left(F.get(t, i + F.col("k") - 1), F.lit(EDGE)).alias("r"))
    met = index.join(_few(keys, _FEW // 10), "key").filter(F.col("l").endswith(F.col("ql")) & F.col("r").startswith(F.col("qr")))
    return met.select("qid", "tid").distinct()


def _meet_in_spaces(quotes: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """Candidates of quotes that are white space alone: texts with a run of white space that holds the quote."""
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(f"{UNICODE}{SPACE}+"), F.lit(0)))
    index = texts.select(*scope, "tid", F.explode(runs).alias("run"))
    kinds = index.select(*scope, "run").distinct().withColumn("first", F.left("run", F.lit(1)))
    wanted = quotes.select(*scope, "qid", "quote_text", F.left("quote_text", F.lit(1)).alias("first"))
    letters = kinds.select(*scope, "run", F.explode(F.array_distinct(_characters(F.col("run")))).alias("first"))
    fits = letters.join(wanted, scope + ["first"]).filter(F.col("run").contains(F.col("quote_text")))
    return index.join(fits.select(*scope, "run", "qid"), scope + ["run"]).select("qid", "tid").distinct()


def hashed_quotes(quotes: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct (scope, quote_text, quote_hash) of quotes that are not null or empty."""
    return quotes.filter(F.col("quote_text") != "").select(*scope, "quote_text").distinct().withColumn("quote_hash", F.sha2("quote_text", 256))


def _candidates(quotes: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """(qid, tid): every text that may hold the quote. Texts are taken apart only for the kinds of quotes that occur."""
    tokens = F.size(token_array(F.col("quote_text")))
    blank = is_blank(F.col("quote_text"))
    inner = _inner_tokens(F.col("quote_text"))
    kinds = [
        (~blank & (tokens >= _MIN_TOKENS), lambda q: _meet(q, texts, scope, _grams(inner, 3), _grams(token_array(F.col("text")), 3))),
        (~blank & tokens.between(3, _MIN_TOKENS - 1), lambda q: _meet_on_edges(q, texts, scope)),
        (~blank & (tokens < 3), lambda q: _meet_in_tokens(q, texts, scope)),
        (blank, lambda q: _meet_in_spaces(q, texts, scope))]
    own = [(quotes.filter(kind), meet) for kind, meet in kinds]
    met = [meet(q) for q, meet in own if not q.isEmpty()]
    return reduce(DataFrame.unionByName, met) if met else quotes.sparkSession.createDataFrame([], "qid bigint, tid bigint")


def _verified(candidates: DataFrame, quotes: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    pairs = candidates.join(quotes.select(*scope, "qid", "quote_text"), "qid").join(texts.select(*scope, "tid", "text_hash", "text"), scope + ["tid"])
    return pairs.filter(F.col("text").contains(F.col("quote_text"))).select(
        *scope, "qid", "quote_text", "text_hash",
        overlapping_count(F.col("text"), F.col("quote_text")).alias("overlapping"),
        plain_count(F.col("text"), F.col("quote_text")).alias("plain"))


def _prepared(quotes: DataFrame, texts: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct quotes and distinct texts with their ids, each stored: the steps of a search read them several times."""
    quotes = _with_id(stored(hashed_quotes(quotes, scope), "quotes"), scope, "quote_hash", "qid")
    texts = stored(texts.select(*scope, "text_hash", "text").dropDuplicates(scope + ["text_hash"]), "texts")
    return quotes, _with_id(texts, scope, "text_hash", "tid")


def candidate_texts(quotes: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, quote_hash, text_hash): every distinct text that may hold the quote; hashes only, no texts.

    quotes(scope, quote_text, quote_hash), texts(scope, text, text_hash), both distinct.
    """
    quotes, texts = _with_id(quotes, scope, "quote_hash", "qid"), _with_id(texts, scope, "text_hash", "tid")
    met = _candidates(quotes, texts, scope).join(quotes.select(*scope, "quote_hash", "qid"), "qid")
    return met.join(texts.select(*scope, "text_hash", "tid"), scope + ["tid"]).select(*scope, "quote_hash", "text_hash")


def verified(candidates: DataFrame, quotes: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, quote_text, text_hash, overlapping, plain) of the candidates whose text holds the quote."""
    quotes, texts = _with_id(quotes, scope, "quote_hash", "qid"), _with_id(texts, scope, "text_hash", "tid")
    ids = candidates.select(F.xxhash64(*scope, "quote_hash").alias("qid"), F.xxhash64(*scope, "text_hash").alias("tid"))
    return _verified(ids, quotes, texts, scope).drop("qid")


def contains_pairs(quotes: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, quote_text, text_hash, overlapping, plain) for every distinct text that holds the quote.

    quotes(scope, quote_text), texts(scope, text, text_hash); duplicates on either side are
    compared once. Quotes of any length take part, those of white space alone do not.
    """
    quotes, texts = _prepared(quotes.filter(~is_blank(F.col("quote_text"))), texts, scope)
    return _verified(_candidates(quotes, texts, scope), quotes, texts, scope).drop("qid")


def first_texts(quotes: DataFrame, texts: DataFrame, scope: list[str], order: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Per distinct quote the texts that hold it among the first candidates by `at`, until `limit` are found or none is left.

    order(scope, text_hash, at) gives the places of a text's copies, of which the first counts. The first `limit` candidates are
    verified, then twice as many more for the quotes that fell short, and so on: a quote that occurs
    everywhere costs `limit` looks into texts, whatever the number of texts. Returns the rows of `verified`
    (at least the first `limit` texts that hold the quote) and the number of pairs that were looked into.
    """
    quotes, texts = _prepared(quotes, texts, scope)
    met = stored(_candidates(quotes, texts, scope), "pairs")
    order = KeySet(met, ["tid"]).kept(order.select(F.xxhash64(*scope, "text_hash").alias("tid"), "at")).groupBy("tid").agg(F.min("at").alias("at"))
    pool = stored(met.join(order, "tid").select("qid", "tid", "at"), "pool")
    by_place = Window.partitionBy("qid").orderBy("at", "tid")
    found, tried, looked, size = None, 0, 0, limit
    while True:
        batch = pool.withColumn("_n", F.row_number().over(by_place)).filter(F.col("_n") <= tried + size).filter(F.col("_n") > tried)
        batch = stored(batch.drop("_n", "at"), "batch")
        looked += batch.count()
        held = stored(_verified(batch, quotes, KeySet(batch, ["tid"]).kept(texts), scope), "held")
        found = held if found is None else found.unionByName(held)
        full = batch.groupBy("qid").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") == size)
        so_far = found.groupBy("qid").agg(F.count(F.lit(1)).alias("held"))
        short = stored(full.join(so_far, "qid", "left").filter(F.coalesce("held", F.lit(0)) < limit).select("qid"), "short")
        tried, size = tried + size, 2 * size
        if short.isEmpty():
            return found.drop("qid"), looked
        pool = pool.join(short, "qid", "left_semi")
