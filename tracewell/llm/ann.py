"""Nearest neighbours by cosine over balanced posting lists.

Unit vectors are assigned to clusters whose centroids are fitted on a bounded sample and balanced
while fitting: a centroid that draws too many of the sample is split. Every vector is written to the
list of its nearest centroid and, as a boundary vector, to those of further centroids nearly as near,
so a neighbour across a border is found in the list the query reads. Centroids are searched through a
graph in memory (each linked to its nearest others) by best-first search, for vectors and queries
alike. A query reads the lists whose centroid is within a ratio of its nearest centroid's distance.
Lists and queries meet in a join by list; long lists are cut into blocks, so no list is one task.
Equal vectors are one entry that carries the few smallest ids a result can need.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewell.llm.common import map_pandas, ship, stage_table


@dataclass(frozen=True)
class Settings:
    """Of index and search. `sample`, `lists_at_most` bound what the driver and every task hold.

    Centroids: rows / list_size of them, between 16 and lists_at_most. `replicas` and `near` bound the
    lists of a vector (as many as `replicas`, at up to `near` times the least distance). A query reads
    lists at up to `ratio` times the distance of its nearest one, and the nearest `lists_at_least` in any
    case: the distances of few centroids say little. `links` and `breadth` shape the graph
    and its search. The ratio is wide because directions without structure have their neighbours
    spread over many lists; on clustered vectors it selects few.
    """
    sample: int = 20_000
    list_size: int = 128
    lists_at_most: int = 4_096
    replicas: int = 3
    near: float = 1.06
    ratio: float = 1.24
    lists_at_least: int = 32
    links: int = 24
    breadth: int = 64
    block_rows: int = 2_048


def unit_vectors(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, their vectors as float64 of length 1). Null, zero or non-finite ones are not."""
    good, out = [], []
    for row, value in enumerate(column):
        if value is None or not len(value):
            continue
        vector = np.asarray(value, dtype=np.float64)
        scale = np.max(np.abs(vector)) if np.isfinite(vector).all() else 0.0
        if scale > 0:
            vector = vector / scale
            good.append(row)
            out.append(vector / np.linalg.norm(vector))
    return np.array(good, np.int64), np.array(out) if out else np.empty((0, 0))


class CentroidGraph:
    """Centroids, each linked to its nearest others; best-first search for many vectors at once."""

    def __init__(self, centroids: np.ndarray, links: int):
        self.centroids = centroids
        count = len(centroids)
        width = min(links, count - 1)
        near = np.empty((count, width), np.int64)
        for at in range(0, count, 512):
            similar = centroids[at:at + 512] @ centroids.T
            similar[np.arange(len(similar)), np.arange(at, at + len(similar))] = -np.inf
            near[at:at + 512] = np.argsort(-similar, axis=1, kind="stable")[:, :width]
        # Links go both ways, so no centroid is out of reach of those that are near it; rows are padded with themselves.
        both = [set(row) for row in near.tolist()]
        for a, row in enumerate(near.tolist()):
            for b in row:
                both[b].add(a)
        widest = max(map(len, both), default=0)
        self.links = np.array([sorted(s) + [i] * (widest - len(s)) for i, s in enumerate(both)], np.int64).reshape(count, widest)
        # Entries: centroids far apart from each other, so every region is a few steps away.
        entries, best = [0], centroids @ centroids[0]
        while len(entries) < min(16, count):
            entries.append(int(np.argmin(best)))
            best = np.maximum(best, centroids @ centroids[entries[-1]])
        self.entries = np.array(entries)

    def search(self, vectors: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of each vector, nearest first, -1 and inf where fewer are reached.

        Each step expands, for every vector, the nearest centroid not expanded yet; a vector is done
        when its `breadth` nearest reached ones are all expanded.
        """
        rows, count = len(vectors), len(self.centroids)
        breadth = min(breadth, count)
        similar = np.full((rows, count), -np.inf, np.float32)
        expanded = np.zeros((rows, count), bool)
        similar[:, self.entries] = vectors @ self.centroids[self.entries].T
        active = np.arange(rows)
        while len(active):
            part = similar[active]
            bar = np.partition(part, count - breadth, axis=1)[:, count - breadth]
            open_ = np.where(expanded[active], -np.inf, part)
            best = open_.argmax(axis=1)
            value = open_[np.arange(len(active)), best]
            go = (value > -np.inf) & (value >= bar)
            active, best = active[go], best[go]
            if not len(active):
                break
            expanded[active, best] = True
            targets = self.links[best]
            similar[active[:, None], targets] = np.einsum("nd,nkd->nk", vectors[active], self.centroids[targets])
        order = np.argsort(-similar, axis=1, kind="stable")[:, :breadth]
        found = np.take_along_axis(similar, order, axis=1)
        reached = found > -np.inf
        return np.where(reached, order, -1), np.where(reached, np.maximum(2.0 - 2.0 * found, 0.0), np.inf)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on the sample with balance: each round the fullest clusters are split in place of the emptiest."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    count = max(1, min(count, len(distinct)))
    centroids = distinct[rng.permutation(len(distinct))[:count]]
    for round_ in range(rounds):
        owner = np.concatenate([(sample[at:at + 4096] @ centroids.T).argmax(axis=1) for at in range(0, len(sample), 4096)])
        sizes = np.bincount(owner, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
        if round_ < rounds - 1:
            full = np.flatnonzero(sizes > 2 * max(1, len(sample) // count))
            empty = np.argsort(sizes, kind="stable")[:len(full)]
            for target, source in zip(empty, full):
                centroids[target] = sample[rng.choice(np.flatnonzero(owner == source))]
    return centroids


def entries_of(vectors: DataFrame, keep: int) -> DataFrame:
    """(entry, ids, embedding): distinct vectors with their `keep` smallest ids, ascending.

    A result of keep - 1 neighbours can hold no other copies, as ties go to smaller ids and a query
    leaves out only itself. Salting by id keeps copies of one vector from meeting in one task first.
    """
    key = F.xxhash64("embedding")
    salted = Window.partitionBy("_key", "embedding", "_salt").orderBy("vec_id")
    plain = Window.partitionBy("_key", "embedding").orderBy("vec_id")
    few = vectors.withColumns({"_key": key, "_salt": F.pmod(F.xxhash64("vec_id"), F.lit(64))})
    few = few.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= keep)
    few = few.withColumn("_n", F.row_number().over(plain)).where(F.col("_n") <= keep)
    return few.groupBy("_key", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.element_at("ids", 1).alias("entry"), "ids", "embedding")


def _assign(batches, graph, settings):
    """Posting rows: an entry in the list of its nearest centroid and of those nearly as near."""
    for batch in batches:
        good, units = unit_vectors(batch["embedding"])
        for at in range(0, len(good), 512):
            part = units[at:at + 512]
            lists, squared = graph.search(part, settings.breadth)
            lists, distance = lists[:, :settings.replicas], np.sqrt(squared[:, :settings.replicas])
            keep = (lists >= 0) & ((distance <= settings.near * distance[:, :1]) | (np.arange(lists.shape[1]) == 0))
            row, rank = np.nonzero(keep)
            source = good[at:at + 512][row]
            yield pd.DataFrame({
                "list": lists[row, rank], "entry": batch["entry"].to_numpy()[source], "ids": batch["ids"].to_numpy()[source],
                "embedding": batch["embedding"].to_numpy()[source]})


def _select(batches, graph, settings):
    """(query entry, list) of the lists a query reads: by the ratio of centroid distances."""
    for batch in batches:
        good, units = unit_vectors(batch["embedding"])
        for at in range(0, len(good), 256):
            lists, squared = graph.search(units[at:at + 256], len(graph.centroids))
            distance = np.sqrt(squared)
            row, rank = np.nonzero((lists >= 0) & ((distance <= settings.ratio * distance[:, :1]) | (np.arange(lists.shape[1]) < settings.lists_at_least)))
            source = good[at:at + 256][row]
            yield pd.DataFrame({
                "list": lists[row, rank], "query": batch["entry"].to_numpy()[source], "q_embedding": batch["embedding"].to_numpy()[source]})


def _scan(top: int):
    """Nearest entries of every query within one block of one list."""
    def scan(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "ids": [], "score": []}).astype({"query": "int64", "score": "float64"})
        if not len(queries) or not len(rows):
            return empty
        _, base = unit_vectors(rows["embedding"])
        ids, entry = rows["ids"].to_numpy(), rows["entry"].to_numpy()
        order = np.argsort(entry, kind="stable")
        base, ids = base[order], ids[order]
        out = []
        for at in range(0, len(queries), 256):
            _, probe = unit_vectors(queries["q_embedding"].iloc[at:at + 256])
            score = probe @ base.T
            best = np.argsort(-score, axis=1, kind="stable")[:, :top]
            names = np.repeat(queries["query"].to_numpy()[at:at + 256], best.shape[1])
            out.append(pd.DataFrame({"query": names, "ids": ids[best.ravel()], "score": np.take_along_axis(score, best, 1).ravel()}))
        return pd.concat(out)
    return scan


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 5, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found for each row of queries (vec_id, embedding).

    vectors: (vec_id, embedding), all indexed. A query's own vec_id is no candidate; ties go to the
    smaller id; with fewer candidates all are returned. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do null ids; vectors of another dimension than
    the first sampled are refused by numpy. Repeated rows count once. Scores are cosines in double.
    """
    spark = vectors.sparkSession
    usable = lambda df: df.where(
        "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) "
        "and exists(embedding, x -> x <> 0)").select(F.col("vec_id").cast("long"), "embedding").distinct()
    stored = stage_table(entries_of(usable(vectors), top + 1), "entries")
    asked = stage_table(usable(queries), "asked")
    size = stored.count()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fraction = min(1.0, 1.2 * settings.sample / size)
    drawn = stored.select("embedding", F.xxhash64("entry").alias("_h")).where(
        F.pmod(F.col("_h"), F.lit(1 << 30)) < int(fraction * (1 << 30)) + 1).limit(settings.sample).toPandas()
    _, sample = unit_vectors(drawn["embedding"])
    if not len(sample):
        _, sample = unit_vectors(stored.limit(1).toPandas()["embedding"])
    count = min(settings.lists_at_most, max(16, size // settings.list_size), max(1, len(sample)))
    ship(spark)
    graph = spark.sparkContext.broadcast(CentroidGraph(fit_centroids(sample, count).astype(np.float32).astype(np.float64), settings.links))
    kind = vectors.schema["embedding"].dataType.simpleString()
    posted = map_pandas(
        stored, lambda batches: _assign(batches, graph.value, settings), f"list long, entry long, ids array<long>, embedding {kind}")
    blocks = max(1, size * settings.replicas // (count * settings.block_rows))
    posted = posted.withColumn("block", F.pmod(F.xxhash64("entry"), F.lit(blocks)))
    probes = asked.groupBy("embedding").agg(F.min("vec_id").alias("entry"))
    names = asked.join(probes, "embedding").select("vec_id", "entry")
    reads = map_pandas(probes, lambda batches: _select(batches, graph.value, settings), f"list long, query long, q_embedding {kind}")
    reads = reads.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    found = reads.groupBy("list", "block").cogroup(posted.groupBy("list", "block")).applyInPandas(
        _scan(top + 1), "query long, ids array<long>, score double")
    # A replicated entry may be found in several lists; its score is the same in each.
    each = found.select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    per_probe = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = each.withColumn("_n", F.row_number().over(per_probe)).where(F.col("_n") <= top + 1)
    per_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    named = best.join(names.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")), "query").where("query_id <> vec_id")
    ranked = named.withColumn("rank", F.row_number().over(per_query).cast("int")).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def ann_digest(vectors: DataFrame) -> DataFrame:
    """Query op1: the five nearest of every vector whose id is divisible by 50, among all vectors."""
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
