"""SimHash near-duplicates found through Golay-code keys.

Every text gets a 64-bit fingerprint; texts whose fingerprints differ in at most four bits are
linked, and components of links are groups of near-duplicates. Fingerprints, not documents, are
searched: copies collapse into one row before anything is joined.

Keys. The 64 bits are cut into segments of 22, 21 and 21 bits, each padded to the 23 bits of the
binary Golay code, whose 4096 codewords have every 23-bit word within distance 3 of exactly one of
them. `near` of a segment is the set of codewords reached from it or from one of its 23 neighbours
(1 or about 6 of them): two segments that differ in at most two bits share one (both reach the word
half-way), and a segment that differs in one bit reaches the other's own codeword. Four errors fall
on three segments in one of two ways, sorted by errors:
  * the first has none, the second at most two: key (first exactly, a near codeword of the second);
  * the first and the second have one each: key (codeword, codeword), where one side of the pair
    lists all near codewords of both and the other side only its own two.
So no link is missed. Both kinds of key go through one shuffle, where equal keys become neighbours
by a sort; candidates are verified by a popcount inside the task and only the edges of a spanning
forest leave it, at most one per row.

Components are found by alternating large-star and small-star steps over those edges.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from tracewell.llm.common import map_pandas, ship, stage_table
from tracewell.session import cut_lineage

SHINGLE = 4
LINK_BITS = 4
SEED = 42
#: (shift, width) of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Runs of equal keys up to this length are compared as shifted vectors, longer ones by a forest.
SHORT_RUN = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: per bit, whether more than half of the shingle hashes have it set.

    Only A-Z are lower-cased. Words are parted by ASCII white space, shingles keep repeats. A text
    with fewer words than a shingle is one shingle; one without words (or null) has fingerprint 0.
    """
    import xxhash

    lower = (text or "").encode("utf-8", "replace").translate(_LOWER)
    words = lower.split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    count = len(words) - width + 1
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[width - 1:].tolist())), np.uint64, count)
    votes = np.zeros(64, np.int64)
    for at in range(0, count, 8192):
        votes += np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > count, bitorder="little")
    return int(bits.view(np.uint64)[0])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    out = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(out.view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs plus the fingerprint as a signed long with the same bits."""
    ship(docs.sparkSession)
    return docs.withColumn(out, _fingerprints(F.col(text)))


_TABLES: dict[str, np.ndarray] = {}


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(own, near): the codeword index of each 23-bit word, and of its neighbours, -1 padded to 24.

    Derived from the generator polynomial: an error pattern of weight at most 3 for each of the
    2048 syndromes gives the decoder; the index of a codeword is its upper 12 bits (systematic).
    Built once per worker, a few megabytes; `near` is kept as distinct values only.
    """
    if not _TABLES:
        words = np.arange(1 << 23, dtype=np.uint32)

        def syndrome(x):
            rest = x.copy()
            for bit in range(22, 10, -1):
                rest ^= np.where((rest >> bit) & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0)).astype(np.uint32)
            return rest
        low = syndrome(np.array([1 << i for i in range(23)], dtype=np.uint32))
        fix = np.zeros(2048, np.uint32)
        for i in range(23):
            fix[low[i]] = 1 << i
            for j in range(i):
                fix[low[i] ^ low[j]] = 1 << i | 1 << j
                for k in range(j):
                    fix[low[i] ^ low[j] ^ low[k]] = 1 << i | 1 << j | 1 << k
        # The syndrome is linear: look it up from two halves instead of dividing 8 million words.
        half = np.arange(1 << 12, dtype=np.uint32)
        s_low, s_high = syndrome(half), syndrome(half[:1 << 11] << np.uint32(12))
        syn = s_high[words >> np.uint32(12)] ^ s_low[words & np.uint32(4095)]
        _TABLES["own"] = ((words ^ fix[syn]) >> np.uint32(11)).astype(np.int16)
    return _TABLES["own"]


def near_codewords(segment: np.ndarray) -> np.ndarray:
    """n x 24 codeword indices reached from each 23-bit word or a neighbour; repeats are -1."""
    own = golay_tables()
    reached = np.stack([own[segment], *(own[segment ^ np.uint32(1 << i)] for i in range(23))], axis=1)
    reached.sort(axis=1)
    reached[:, 1:][reached[:, 1:] == reached[:, :-1]] = -1
    return reached


def _keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all keys of the fingerprints, as the module text lists them."""
    rows = np.arange(len(fps))
    segments = [((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.uint32) for shift, width in SEGMENTS]
    near, own = [near_codewords(s) for s in segments], [golay_tables()[s] for s in segments]
    keys, owners = [], []

    def add(kind, row, high, low):
        keys.append((np.uint64(kind) << np.uint64(40)) | (high.astype(np.uint64) << np.uint64(12)) | low.astype(np.uint64))
        owners.append(row)
    for a in range(3):
        for b in range(3):
            if a != b:
                row, col = np.nonzero(near[b] >= 0)
                add(3 * a + b, row, segments[a][row], near[b][row, col])
    for a in range(3):
        for b in range(a + 1, 3):
            kind = 16 + 3 * a + b
            for i in range(24):
                some = rows[near[a][:, i] >= 0]
                row, col = np.nonzero(near[b][some] >= 0)
                add(kind, some[row], near[a][some[row], i], near[b][some][row, col])
            add(kind, rows, own[a], own[b])
    return np.concatenate(keys), np.concatenate(owners)


def _emit_keys(batches):
    for batch in batches:
        fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
        for at in range(0, len(fps), 1024):
            part = fps[at:at + 1024]
            key, row = _keys(part)
            yield pd.DataFrame({"key": key.view(np.int64), "fp": part[row].view(np.int64)})


def spanning_edges(fps: np.ndarray, bits: int = LINK_BITS) -> list[tuple[int, int]]:
    """Forest over distinct fingerprints whose trees are the components of "at most `bits` differ".

    Breadth first: each fingerprint is compared once with those not reached yet, as one vector, so
    memory is linear in the run and a group of mutual copies is settled in one step.
    """
    open_, edges, queue = np.unique(fps), [], []
    while len(open_):
        node = queue.pop() if queue else open_[0]
        hit = np.bitwise_count(open_ ^ node) <= bits
        reached = open_[hit]
        open_ = open_[~hit]
        for other in reached[reached != node].tolist():
            edges.append((int(node), other))
            queue.append(np.uint64(other))
    return edges


def link_sorted(key: np.ndarray, fp: np.ndarray, bits: int = LINK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows of equal key in arrays sorted by key; equal keys are never parted.

    Short runs compare each row with the next few as shifted vectors; longer runs grow a forest.
    """
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    lengths = np.diff(np.append(starts, len(key)))
    long_run = np.repeat(lengths > SHORT_RUN, lengths)
    left, right = [], []
    for step in range(1, min(SHORT_RUN, int(lengths.max(initial=1)) + 1)):
        same = (key[step:] == key[:-step]) & ~long_run[step:]
        x, y = fp[:-step][same], fp[step:][same]
        close = (np.bitwise_count(x ^ y) <= bits) & (x != y)
        left.append(x[close])
        right.append(y[close])
    for at, length in zip(starts[lengths > SHORT_RUN].tolist(), lengths[lengths > SHORT_RUN].tolist()):
        edges = np.array(spanning_edges(fp[at:at + length], bits), dtype=np.uint64).reshape(-1, 2)
        left.append(edges[:, 0])
        right.append(edges[:, 1])
    return np.concatenate(left or [np.empty(0, np.uint64)]), np.concatenate(right or [np.empty(0, np.uint64)])


def _link_keys(batches):
    """Rows sorted by key -> distinct edges; the run at the end of a batch waits for the next batch."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def edges(keys, fps):
        a, b = link_sorted(keys, fps)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0].copy().view(np.int64), "b": pairs[:, 1].copy().view(np.int64)})
    for batch in batches:
        key = np.concatenate([key, batch["key"].to_numpy(np.int64)])
        fp = np.concatenate([fp, batch["fp"].to_numpy(np.int64).view(np.uint64)])
        if len(key):
            cut = int(np.searchsorted(key, key[-1]))
            yield edges(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield edges(key, fp)


def links(fingerprints: DataFrame) -> DataFrame:
    """(a, b): edges that connect exactly the components of the distinct fingerprints in column `fp`."""
    keys = map_pandas(fingerprints, _emit_keys, "key long, fp long")
    return map_pandas(keys.repartition("key").sortWithinPartitions("key"), _link_keys, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node of its component.

    Alternating large-star and small-star steps. Each round is written to the shared folder; groups
    are reduced to minima map-side, and no node's neighbours are ever gathered.
    """
    spark = edges.sparkSession
    state = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    before = None
    while True:
        both = state.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(state.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(
            F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        state = cut_lineage(small.select("e.*").where("hi <> lo").distinct())
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(state.select("lo", "lo")).distinct() if before[0] else (
        spark.createDataFrame([], "node long, root long"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs.

    component_id is the smallest doc_id of the component, the row's own included. Null and blank
    texts have fingerprint 0 and are linked like any other. Rows with a null doc_id take part; their
    component has a null id only if it holds no other. Repeated rows give repeated rows.
    """
    marked = stage_table(with_fingerprint(docs.select("doc_id", F.col(text).alias("text")), "text", "fp").select("doc_id", "fp"), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = cut_lineage(components(links(distinct.select("fp"))))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; the columns of docs.

    Of repeated rows with that doc_id all stay: which of them to keep is not a near-duplicate matter.
    Rows without doc_id stay.
    """
    groups = near_duplicates(docs, text)
    losers = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_loser")).distinct()
    return docs.join(losers, docs["doc_id"] == losers["_loser"], "left_anti")
