"""Prefix trie of conversations by truncation peeling.

A conversation is its sequence of turns; a node of depth d is a distinct sequence of first d turns.
Nodes are named by marks: two 64-bit lanes, each the exclusive or of hashes of (role, text, place),
so that a running window gives the marks of all prefixes of a conversation. Equal conversations
collapse into one *sequence* before anything else.

Peeling goes from the greatest depth to the root. At depth d the sequences that end there join the
nodes that survive from below, stripped of their last turn; rows with the same mark are one node, and
its counts are sums over what was merged (map-side first, so a node with a third of all conversations
under it is a sum of small partial sums). Each round is a written table that the next one reads.

A tail that only one sequence has is a chain that no other row can join: its nodes are emitted at once.
Where it begins is bounded from above by one grouping of the marks at depths 1, 2, 4, ...; so there
are at most twice as many rounds as the deepest shared prefix has turns, however long the longest
conversation is.

Cases: null role or text is empty; null turns come first, equal turns go by role, then text, and
repeated rows are repeated turns. Rows without conv_id belong to no conversation and are left out.
Without conversations there is no node. Other columns are ignored.
"""
from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.llm.common import NON_SPACE, map_pandas, stage_table

#: Conversation ids of one node are joined to text in blocks of this many consecutive ids.
ID_BLOCK = 4096
_MARK = ["a", "b"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) with places from 0."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "role", "text")


def branched(turns: DataFrame, ids: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of the first of its group, then its own after its first h.

    The first of a group is c - c % group, h is the unsigned crc32 of the decimal c modulo `shared`.
    """
    plan = ids.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).alias("h"))
    heads = turns.where(F.col("place") < shared - 1).withColumnRenamed("conv_id", "base")
    begin = plan.join(heads, "base").where("place < h").select("conv_id", "place", "role", "text")
    rest = turns.join(plan, "conv_id").where("place >= h").select("conv_id", "place", "role", "text")
    return begin.unionByName(rest)


def _paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, a, b, w): arrays over depths 1.. of both lanes of the mark and of the words up to there."""
    place = Window.partitionBy("conv_id").orderBy("place")
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    depth = turns.select("conv_id", "place", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit("second lane"), "text", "role").alias("y"),
                         F.regexp_count("text", F.lit(NON_SPACE + "+")).cast("long").alias("n"))
    depth = depth.withColumn("depth", F.row_number().over(place))
    marked = depth.select(
        "conv_id", "depth",
        F.bit_xor(F.xxhash64("x", "depth")).over(upto).alias("a"), F.bit_xor(F.xxhash64("y", "depth")).over(upto).alias("b"),
        F.sum("n").over(upto).alias("w"))
    rows = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "w"))).alias("path"))
    none = F.array().cast("array<long>")
    return ids.join(rows, "conv_id", "left").select("conv_id", *(F.coalesce(F.col("path")[c], none).alias(c) for c in ("a", "b", "w")))


def _last(array: Column) -> Column:
    """Mark of the whole path; that of the root is 0."""
    return F.when(F.size(array) > 0, F.element_at(array, -1)).otherwise(F.lit(0).cast("long"))


def _at(array: Column, depth: Column) -> Column:
    return F.when(depth > 0, F.get(array, (depth - 1).cast("int"))).otherwise(F.lit(0).cast("long"))


def _hash_ids(batches):
    """(depth, a, b, ids) sorted by node and ids -> one digest per node; only a hash state is held."""
    node, state = None, None
    for batch in batches:
        out = []
        for d, a, b, ids in zip(batch["depth"].tolist(), batch["a"].tolist(), batch["b"].tolist(), batch["ids"]):
            if (d, a, b) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (d, a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["depth", "a", "b", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "a", "b", "ends_sha256"])


def _ends(whole: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): digest of the ids of the conversations that end at a node, ascending.

    Ids meet by blocks of ID_BLOCK values, so a list is bounded; blocks then pass a hash state one by one.
    """
    blocks = whole.groupBy("depth", "a", "b", F.floor(F.col("conv_id") / F.lit(ID_BLOCK)).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = blocks.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "block").select("depth", "a", "b", "ids")
    return map_pandas(dealt, _hash_ids, "depth int, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node of the trie of `turns` (conv_id, place, role, text) over the conversations `ids`.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, words of a node's last turn times members but one), ends_sha256; `a`, `b` name the node and
    `parent_a`, `parent_b` its parent. A conversation without turns is a member of the root alone.
    """
    spark = turns.sparkSession
    paths = stage_table(_paths(turns, ids), "conversation-paths")
    size = F.size("a").alias("depth")
    ends = _ends(paths.select(size, _last(F.col("a")).alias("a"), _last(F.col("b")).alias("b"), "conv_id"))
    sequences = stage_table(
        paths.groupBy(F.size("a").alias("depth"), _last(F.col("a")).alias("end_a"), _last(F.col("b")).alias("end_b"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("w").alias("w")),
        "conversation-sequences")

    # the least probed depth at which a sequence is alone, else its own depth
    powers = F.expr("transform(filter(sequence(0, 30), i -> shiftleft(1, i) <= depth), i -> shiftleft(1, i))")
    probes = sequences.where("depth > 0").select("first", F.explode(powers).alias("probe"), "a", "b").select(
        "first", "probe", _at(F.col("a"), F.col("probe")).alias("a"), _at(F.col("b"), F.col("probe")).alias("b"))
    alone = probes.groupBy("probe", "a", "b").agg(F.count(F.lit(1)).alias("m"), F.min("first").alias("first")).where("m = 1")
    cuts = alone.groupBy("first").agg(F.min("probe").alias("cut"))
    sequences = stage_table(sequences.join(cuts, "first", "left").withColumn("cut", F.coalesce("cut", "depth").cast("int")), "conversation-cuts")

    top = sequences.agg(F.max("cut")).first()[0]
    below = F.col("w")  # words up to each depth
    tail = sequences.where("depth > cut").select("*", F.explode(F.sequence(F.col("cut") + 1, F.col("depth"))).alias("at")).select(
        F.col("first").alias("conv_id"), F.col("at").alias("depth"), _at(F.col("a"), F.col("at")).alias("a"), _at(F.col("b"), F.col("at")).alias("b"),
        _at(F.col("a"), F.col("at") - 1).alias("parent_a"), _at(F.col("b"), F.col("at") - 1).alias("parent_b"), F.col("n").alias("n_convs"),
        (F.col("at") < F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * (_at(below, F.col("depth")) - _at(below, F.col("at") - 1))).alias("saved_tokens"))
    levels = [stage_table(tail, "conversation-tails")]

    state = None
    for d in range(top if top is not None else -1, -1, -1):
        ended = sequences.where(F.col("cut") == d).select(
            "n", "first", (F.col("depth") > d).cast("long").alias("children"), (F.col("depth") > d).cast("long").alias("leaves"),
            ((F.col("n") - 1) * (_at(below, F.col("depth")) - _at(below, F.lit(d)))).alias("saved"),
            *(F.slice(c, 1, d).alias(c) for c in ("a", "b", "w")))
        rows = ended if state is None else ended.unionByName(state)
        merged = rows.groupBy(_last(F.col("a")).alias("node_a"), _last(F.col("b")).alias("node_b")).agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("below"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("w").alias("w"))
        own = (F.col("n") - 1) * (_at(F.col("w"), F.lit(d)) - _at(F.col("w"), F.lit(d - 1)))
        level = stage_table(merged.select(
            "node_a", "node_b", "n", "first", "children", F.greatest("leaves", F.lit(1)).alias("leaves"), (F.col("below") + own).alias("saved"), "a", "b", "w"),
            f"conversation-level-{d}")
        levels.append(level.select(
            F.col("first").alias("conv_id"), F.lit(d).alias("depth"), F.col("node_a").alias("a"), F.col("node_b").alias("b"),
            _at(F.col("a"), F.lit(d - 1)).alias("parent_a"), _at(F.col("b"), F.lit(d - 1)).alias("parent_b"), F.col("n").alias("n_convs"),
            F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")))
        state = level.select("n", "first", F.lit(1).cast("long").alias("children"), "leaves", "saved",
                             *(F.slice(c, 1, max(d - 1, 0)).alias(c) for c in ("a", "b", "w")))
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    nodes = stage_table(nodes, "conversation-nodes")

    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    below_root = nodes.where("depth > 0").join(parents, ["depth", "parent_a", "parent_b"])
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below_root.unionByName(root).join(stage_table(ends, "conversation-ends"), ["depth", *_MARK], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).withColumn("depth", F.col("depth").cast("long"))


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes plus role and text of each node's last turn, read from its smallest member; null at the root."""
    depth = F.row_number().over(Window.partitionBy("conv_id").orderBy("place")).cast("long")
    return nodes.join(turns.select("conv_id", depth.alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


def trie_digest(conversations: DataFrame) -> DataFrame:
    """The node table of the rebuilt conversations, as the query returns it."""
    turns = stage_table(ordered_turns(conversations.select("conv_id", "turn", "role", "text")), "conversation-turns")
    ids = turns.select("conv_id").distinct()
    return prefix_trie(branched(turns, ids), ids).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
