"""Spelling variants: words one edit apart, found through pairs of trie nodes.

The words of a dictionary are numbered into two tries, one of the words and one of the words reversed.
A node's number is its place in the preorder of its trie, so a word's own node also orders words by
code points. Trie numbers come from one sorted pass: in a sorted block of words every word opens the
nodes behind the prefix it shares with its predecessor, and numbers of a block are moved to their global
place from a summary of one row per block (its first and last word and the path of the last).

A word with the characters c1..cL gives, for each place i, the integer pair
  (node of c1..ci-1, reversed node of ci+1..cL)   place i skipped, and
  (node of c1..ci-1, reversed node of ci..cL)     a gap before place i.
Two words differ by a replaced character exactly if a skipped pair is equal, by an inserted or deleted
one exactly if a skipped pair of the longer is a gap pair of the shorter. Equal pairs meet in one group,
which has at most one word for each character of the alphabet and one word without it, so groups are
small by construction and nothing has to be verified or capped. Inside a run of one character only the
first place is skipped for deletions, so a pair of words meets once.
"""
from __future__ import annotations

import os.path

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import map_pandas, stage_table

LETTERS = "A-Za-zÀ-ÿ"
TYPO_EVERY = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of letters of at least LEAST_LENGTH code points, A-Z lower-cased; null texts have none."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def with_typos(runs: DataFrame) -> DataFrame:
    """(word): the runs, one in TYPO_EVERY by the checksum of "<doc_id>:<run>" without one code point. A null doc_id is empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select("run", h.alias("h")).select(F.when(F.col("h") % TYPO_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def dictionary(words: DataFrame) -> DataFrame:
    """(word, n): distinct words long and frequent enough."""
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _number_block(batches):
    """Sorted words of one block -> local node numbers along each word; numbers begin at 0 in the block."""
    from pyspark import TaskContext

    block, before, path, made = TaskContext.get().partitionId(), "", [], 0
    for batch in batches:
        out = []
        for word in batch["word"]:
            shared = len(os.path.commonprefix([before, word]))
            path = path[:shared] + list(range(made, made + len(word) - shared))
            made += len(word) - shared
            out.append((block, word, path, made))
            before = word
        yield pd.DataFrame(out, columns=["block", "word", "path", "made"])


def numbered(words: DataFrame, name: str) -> DataFrame:
    """(word, path): the preorder numbers, from 1 (the root is 0), of the trie nodes along each distinct word.

    The driver sees one row per block of the sorted order: first and last word and the last word's path.
    """
    spark = words.sparkSession
    dealt = words.select("word").repartitionByRange("word").sortWithinPartitions("word")
    local = stage_table(map_pandas(dealt, _number_block, "block int, word string, path array<long>, made long"), f"{name}-blocks")
    summary = local.groupBy("block").agg(
        F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("path", "word").alias("path"), F.max("made").alias("made"))
    before, carry, base, moves = "", [], 0, []
    for r in sorted(summary.collect(), key=lambda r: r["block"]):
        shared = len(os.path.commonprefix([before, r["first"]]))
        moves.append((r["block"], shared, base, carry[:shared]))
        carry = [carry[x] if x < shared else base + x - shared + 1 for x in r["path"]]
        base += r["made"] - shared
        before = r["last"]
    table = spark.createDataFrame(moves, "block int, shared long, base long, carry array<long>")
    return local.join(F.broadcast(table), "block").select("word", F.expr(
        "transform(path, x -> if(x < shared, element_at(carry, cast(x + 1 as int)), base + x - shared + 1))").alias("path"))


def _node(path: str, length: Column) -> Column:
    return F.when(length > 0, F.get(path, (length - 1).cast("int"))).otherwise(F.lit(0).cast("long"))


def node_pairs(words: DataFrame) -> DataFrame:
    """(f, r, gap, open, id, n) of all pairs of the dictionary words (id, n, fpath, rpath, chars).

    `gap` marks gap pairs; `open` skipped pairs whose place is the first of its run of one character.
    """
    size = F.size("chars")
    skip = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        _node("fpath", i).alias("f"), _node("rpath", size - 1 - i).alias("r"), F.lit(False).alias("gap"),
        ((i == 0) | (F.get("chars", i) != F.get("chars", F.greatest(i - 1, F.lit(0))))).alias("open")))
    gap = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        _node("fpath", i).alias("f"), _node("rpath", size - i).alias("r"), F.lit(True).alias("gap"), F.lit(False).alias("open")))
    return words.select("id", "n", F.explode(F.concat(skip, gap)).alias("p")).select("p.*", "id", "n")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): per word the number of its near words, and (-n, id) of the most frequent one (ties: first)."""
    groups = pairs.groupBy("f", "r").agg(
        F.collect_list(F.when(~F.col("gap"), F.struct((-F.col("n")).alias("rank"), "id", "open"))).alias("skips"),
        F.min(F.when(F.col("gap"), F.struct((-F.col("n")).alias("rank"), "id"))).alias("short")).where("size(skips) > 1 or (size(skips) > 0 and short is not null)")
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["rank"].alias("rank"), x["id"].alias("id")))
    lone = F.when(F.col("short").isNotNull(), F.array("short")).otherwise(F.array().cast("array<struct<rank:bigint,id:bigint>>"))
    of_skips = F.transform("skips", lambda s: F.struct(s["id"].alias("id"), F.concat(
        plain(F.filter("skips", lambda x: x["id"] != s["id"])), F.filter(lone, lambda x: s["open"])).alias("near")))
    of_short = F.transform(lone, lambda s: F.struct(s["id"].alias("id"), plain(F.filter("skips", lambda x: x["open"])).alias("near")))
    return groups.select(F.explode(F.concat(of_skips, of_short)).alias("e")).where("size(e.near) > 0").groupBy(F.col("e.id").alias("id")).agg(
        F.sum(F.size("e.near")).cast("long").alias("n_near"), F.min(F.array_min("e.near")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) for words that have a form: pointers are doubled until none moves. n doubles along a chain, so at most seven rounds."""
    links = stage_table(forms.select("id", F.col("form_id").alias("to")), "spelling-links")
    while True:
        onward = links.select(F.col("id").alias("to"), F.col("to").alias("next"))
        moved = stage_table(links.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "spelling-links")
        links = moved.select("id", "to")
        if moved.where("moved").limit(1).count() == 0:
            return links.withColumnRenamed("to", "root_id")


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a dictionary (word, n) of distinct words.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least
    twice the word's own n, else null; its root is where following forms ends. Null and empty words take no part.
    """
    words = stage_table(words.where("word <> ''"), "spelling-words")
    forward = numbered(words, "spelling-forward").withColumnRenamed("path", "fpath")
    backward = numbered(words.select(F.reverse("word").alias("word")), "spelling-backward").select(F.reverse("word").alias("word"), F.col("path").alias("rpath"))
    known = stage_table(words.join(forward, "word").join(backward, "word").withColumn("id", F.element_at("fpath", -1)), "spelling-paths")
    near = neighbours(node_pairs(known.select("id", "n", "fpath", "rpath", F.split("word", "").alias("chars"))))
    judged = stage_table(known.select("id", "word", "n").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.rank") >= 2 * F.col("n"), F.col("best")).alias("form")).select(
        "id", "word", "n", "n_near", F.col("form.id").alias("form_id"), (-F.col("form.rank")).alias("form_n")), "spelling-forms")
    roots = _roots(judged.where("form_id is not null"))
    named = judged.select("id", "word")
    formed = judged.where("form_id is not null").join(roots, "id") \
        .join(named.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id") \
        .join(named.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id")
    shape = ["word", "n", "n_near", "form", "form_n", "root"]
    rest = judged.where("form_id is null").select("word", "n", "n_near", F.lit(None).cast("string").alias("form"), "form_n", F.col("word").alias("root"))
    return formed.select(*shape).unionByName(rest)


def spelling_digest(docs: DataFrame) -> DataFrame:
    """Variants among the words of whole texts, as the query returns them."""
    return variants(dictionary(with_typos(occurrences(docs)))).select("word", "form", "root", "n", "n_near", "form_n")
