"""Near-duplicates by SuperMinHash signatures: banding, verification on whole sets, union-find grouping.

A text is the set of its shingles of `SHINGLE` words. Texts with equal sets collapse into one row first.

Signatures. Every element draws a random permutation of the SLOTS slots, one place at a time; at place j
it offers the slot there the value j + u, u uniform, and a slot keeps its least offer. Ranks of one
element are thus correlated (no slot is met twice), which lowers the variance of the estimate against
independent minima; and once every slot holds less than j + 1 no later place can matter, so most texts
stop after a few places. All elements of a block of texts take a place in one vector step.

Candidates. Signatures are cut into BANDS bands of BAND_ROWS slots; sets with an equal band are a bucket.
At similarity s a pair shares a bucket with probability 1 - (1 - s^BAND_ROWS)^BANDS: it misses 8 pairs in
ten million at 0.85 and 7 in a hundred thousand at 0.8. Buckets with the same members count once.

Verification compares whole shingle sets, and no task holds a whole bucket:
  1. stars: every set is compared with the least pivot of its buckets, then members of buckets that still
     hold several groups with their bucket's pivot. Members are streamed past the pivot's set, large stars
     in several tasks. Links found join members by union-find.
  2. what stars leave open: buckets whose members are still in several groups. They are dealt into
     blocks of about BLOCK_SHINGLES elements, and every two blocks meet in a task of their own. Only
     pairs of different groups are compared, and only if their distances to the pivot differ by no more
     than the linking distance (Jaccard distance is a metric, so others cannot link). A task passes on
     the forest of its links.
So links between candidates are found whole; a large group of mutual copies is settled by its stars.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tracewell.llm.common import map_pandas, ship, stage_table
from tracewell.llm.simhash import components

SHINGLE = 5
#: Similarity as a fraction in hundredths: a link has 100 * intersection >= LINK * union.
LINK = 85
SEED = 42
BANDS = 24
BAND_ROWS = 5
SLOTS = BANDS * BAND_ROWS
#: Elements that take their places in one vector step.
STEP_ELEMENTS = 32_768
#: Elements of a block when buckets are compared block by block, and members of one task of a star.
BLOCK_SHINGLES = 1 << 18
STAR_MEMBERS = 2_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function, the finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. A-Z are lower-cased; words are parted by ASCII white space.

    A text with fewer words than a shingle is one shingle, a text without words has none.
    """
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    count = len(words) - width + 1
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[width - 1:].tolist())), np.uint64, count))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS values per set; a value is place * 2^32 + a 32-bit draw. Empty sets have the greatest value everywhere."""
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    owners, parts, size = [], [], 0
    for at, elements in enumerate(sets):
        for begin in range(0, len(elements), STEP_ELEMENTS):
            part = elements[begin:begin + STEP_ELEMENTS]
            owners.append(np.full(len(part), at))
            parts.append(part)
            size += len(part)
            if size >= STEP_ELEMENTS:
                _offer(out, np.concatenate(owners), np.concatenate(parts))
                owners, parts, size = [], [], 0
    if parts:
        _offer(out, np.concatenate(owners), np.concatenate(parts))
    return out


def _offer(out: np.ndarray, owner: np.ndarray, element: np.ndarray) -> None:
    """All places of the elements, each lowering a slot of its owner's row, until no place can lower any."""
    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(element), 1))
    flat = out.reshape(-1)
    for place in range(SLOTS):
        draw = _mixed(element + np.uint64(int(_GOLDEN) * (place + 1) % 2**64))
        row = np.arange(len(element))
        other = place + ((draw >> np.uint64(32)) * np.uint64(SLOTS - place) >> np.uint64(32)).astype(np.int64)
        slot = order[row, other]
        order[row, other] = order[row, place]
        order[row, place] = slot
        np.minimum.at(flat, owner * SLOTS + slot, (np.uint64(place) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF)))
        # an owner whose slots all hold an offer of a place up to this one is settled
        open_ = (out >> np.uint64(32)).max(axis=1) > place
        going = open_[owner]
        if not going.any():
            return
        if not going.all():
            owner, element, order = owner[going], element[going], order[going]


def band_keys(signature: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys per row."""
    bands = signature.reshape(len(signature), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for part in range(BAND_ROWS):
        key = _mixed((key ^ bands[:, :, part]) + _GOLDEN)
    return key.view(np.int64)


@F.pandas_udf(StructType([StructField("digest", StringType()), StructField("n", LongType()), StructField("keys", ArrayType(LongType()))]))
def _marks(texts: pd.Series) -> pd.DataFrame:
    import xxhash

    parts = []
    for at in range(0, len(texts), 256):
        sets = [shingle_set(t) for t in texts.iloc[at:at + 256]]
        keys = band_keys(signatures(sets))
        parts.append(pd.DataFrame({
            "digest": pd.Series([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], dtype=object),
            "n": np.array([len(s) for s in sets], np.int64), "keys": pd.Series([k if len(s) else None for k, s in zip(keys, sets)], dtype=object)}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"digest": [], "n": np.empty(0, np.int64), "keys": []})


def _sets_of(batches):
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.iloc[at:at + 64]
            yield pd.DataFrame({"digest": part["digest"].to_numpy(), "shingles": [shingle_set(t).view(np.int64) for t in part["text"]]})


def _star(batches):
    """Rows (pivot, part, role, digest, shingles) sorted so that the pivot's set comes first -> Jaccard distance of each member."""
    pivot, own, found = None, None, []
    for batch in batches:
        for p, part, role, digest, shingles in zip(batch["pivot"], batch["part"], batch["role"], batch["digest"], batch["shingles"]):
            theirs = np.asarray(shingles, np.int64)
            if role == 0:
                pivot, own = (p, part), theirs
            elif pivot == (p, part):
                both = shared_elements(own, theirs)
                found.append((p, digest, 1 - both / (len(own) + len(theirs) - both)))
        yield pd.DataFrame(found, columns=["pivot", "digest", "far"]).astype({"far": float})
        found = []


def shared_elements(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats, ordered as unsigned."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    return int((b[np.minimum(place, len(b) - 1)] == a).sum()) if len(b) else 0


def _forest_edges(group, far, side, digest, sets, two: bool, link: int) -> list[tuple[str, str]]:
    """Forest over the links between members of different groups; with two blocks only across them."""
    above = list(range(len(sets)))

    def find(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x
    sizes, found = np.array([len(s) for s in sets]), []
    for i in range(len(sets)):
        rest = slice(i + 1, None)
        can = (group[rest] != group[i]) & ~(np.abs(far[rest] - far[i]) > 1 - link / 100 + 1e-9)
        can &= 100 * np.minimum(sizes[rest], sizes[i]) >= link * np.maximum(sizes[rest], sizes[i])
        if two:
            can &= side[rest] != side[i]
        for j in (np.flatnonzero(can) + i + 1).tolist():
            if find(i) != find(j):
                both = shared_elements(sets[i], sets[j])
                if 100 * both >= link * (sizes[i] + sizes[j] - both):
                    above[find(i)] = find(j)
                    found.append((digest[i], digest[j]))
    return found


def _forest(batches, link: int):
    """Rows of one pair of blocks together, sorted by it -> edges; the pair at the end of a batch waits for the next batch."""
    at, rows = None, []

    def edges():
        if len(rows) < 2:
            return []
        side, group, far, digest, sets = zip(*rows)
        return _forest_edges(np.array(group, object), np.array(far, float), np.array(side), digest, sets, at[1] != at[2], link)
    for batch in batches:
        found = []
        for key, i, j, *row, shingles in zip(*(batch[c] for c in ("key", "i", "j", "side", "group", "far", "digest", "shingles"))):
            if (key, i, j) != at:
                found += edges()
                at, rows = (key, i, j), []
            rows.append((*row, np.asarray(shingles, np.int64)))
        yield pd.DataFrame(found, columns=["a", "b"], dtype=object)
    yield pd.DataFrame(edges(), columns=["a", "b"], dtype=object)


def _buckets(distinct: DataFrame) -> DataFrame:
    """(key, digest, n): members of each bucket of two or more distinct sets, buckets with the same members once."""
    members = distinct.where("keys is not null").select("digest", "n", F.posexplode("keys").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("key"), "digest", "n")
    shared = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("digest")).alias("mark"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("m > 1")
    # Stored, so that the join reads both sides as they were dealt out and can split a hot key.
    keys = stage_table(shared.groupBy("m", "mark", "lo", "hi").agg(F.min("key").alias("key")).select("key", F.col("lo").alias("pivot")), "bands")
    return stage_table(members.join(keys, "key"), "buckets")


def _stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, digest, far): Jaccard distance of each distinct pair, members streamed past their pivot's set."""
    pairs = stage_table(pairs, "star-pairs")
    parts = stage_table(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / STAR_MEMBERS).cast("int").alias("parts")), "star-parts")
    members = pairs.join(parts, "pivot").select(
        "pivot", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "digest")
    pivots = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("pivot").alias("digest"))
    rows = members.unionByName(pivots).join(sets, "digest").select("pivot", "part", "role", "digest", "shingles")
    dealt = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role")
    return stage_table(map_pandas(dealt, _star, "pivot string, digest string, far double"), "stars")


def _grouped(buckets: DataFrame, edges: DataFrame) -> DataFrame:
    """buckets of several groups, with each member's group and the bucket's blocks."""
    groups = stage_table(_groups(edges), "near-groups")
    grouped = stage_table(buckets.join(groups.withColumnRenamed("node", "digest"), "digest", "left").withColumn("group", F.coalesce("root", "digest")).drop("root"), "grouped")
    mixed = grouped.groupBy("key").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), F.sum("n").alias("total")).where("g0 <> g1").select(
        "key", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    return stage_table(grouped.join(stage_table(mixed, "mixed-buckets"), "key"), "open-members")


def _groups(edges: DataFrame) -> DataFrame:
    """(node, root): union-find over all edges, as rounds of star contraction."""
    return components(edges).select(F.col("node").cast("string").alias("node"), F.col("root").cast("string").alias("root"))


def _block_links(members: DataFrame, stars: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """(a, b): forests of the links between different groups that share a bucket, every two blocks of it in a task of their own."""
    members = members.join(stars, ["pivot", "digest"], "left").withColumn("far", F.when(F.col("pivot") == F.col("digest"), 0.0).otherwise(F.col("far")))
    block = F.pmod(F.xxhash64("digest", F.lit("block")), F.col("blocks")).cast("int")
    met = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "group", "far", "digest")
    rows = stage_table(met, "block-members").join(sets, "digest")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "digest").select("key", "i", "j", "side", "group", "far", "digest", "shingles")
    return map_pandas(dealt, lambda batches: _forest(batches, link), "a string, b string")


def _links(buckets: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """(a, b): edges whose components are those of all links between sets that share a bucket."""
    near = lambda stars: stars.where(F.col("far") <= 1 - link / 100 + 1e-12).select(F.col("pivot").alias("a"), F.col("digest").alias("b"))
    # one pivot for each set, the least of its buckets: settles groups of mutual copies
    first = buckets.groupBy("digest").agg(F.min("pivot").alias("pivot")).where("pivot <> digest").select("pivot", "digest")
    one = _stars(first, sets)
    # the pivots of the buckets that are left, for members of other groups
    left = _grouped(buckets, near(one))
    pivots = left.where("digest = pivot").select("key", F.col("group").alias("pivot_group"), F.col("n").alias("pivot_n"))
    fit = 100 * F.least("n", "pivot_n") >= link * F.greatest("n", "pivot_n")
    more = left.join(pivots, "key").where((F.col("group") != F.col("pivot_group")) & fit).select("pivot", "digest").distinct()
    two = _stars(more.join(one, ["pivot", "digest"], "left_anti"), sets)
    stars = one.unionByName(two)
    rest = _block_links(_grouped(left.drop("group", "blocks"), near(stars)), stars, sets, link)
    return near(stars).unionByName(stage_table(rest, "block-links"))


def near_duplicates(docs: DataFrame, text: str = "text", link: int = LINK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs.

    n_shingles is the size of the row's shingle set; component_id the smallest doc_id of its component, its
    own included; kept whether they are equal. Texts without words (null, empty, blank) are linked with
    nothing. Rows with a null doc_id take part and are kept false; their component has a null id only if it
    holds no other. Repeated rows give repeated rows, and all of them are kept or none. Extra columns are ignored.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    marked = stage_table(docs.select("doc_id", "hash", _marks("text").alias("m")).select("doc_id", "hash", "m.*"), "shingle-marks")
    some = marked.where("digest is not null")
    distinct = stage_table(some.groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.min(F.struct("doc_id", "hash")).alias("at"), F.first("keys").alias("keys")), "shingle-sets")
    buckets = _buckets(distinct)
    wanted = distinct.join(buckets.select("digest").distinct(), "digest", "left_semi").select("digest", F.col("at.doc_id").alias("_id"), F.col("at.hash").alias("_hash"))
    texts = docs.join(wanted, (F.col("hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("digest", "text").dropDuplicates(["digest"])
    sets = stage_table(map_pandas(texts, _sets_of, "digest string, shingles array<long>"), "shingles")

    roots = stage_table(_groups(_links(buckets, sets, link)), "near-groups")
    rooted = stage_table(distinct.join(roots, distinct["digest"] == roots["node"], "left").select("digest", "first_id", F.coalesce("root", "digest").alias("root")), "near-rooted")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage_table(rooted.join(stage_table(smallest, "near-smallest"), "root").select("digest", "component_id"), "near-named")
    lone = marked.where("digest is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n", "digest").join(named, "digest").select("doc_id", "n", "component_id").unionByName(lone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", link: int = LINK) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows without doc_id stay.

    Here texts without words are copies of each other: the one with the smallest doc_id stays.
    """
    groups = stage_table(near_duplicates(docs, text, link), "near-duplicates")
    blank = groups.where("n_shingles = 0")
    first = blank.agg(F.min("doc_id")).first()[0]
    losers = groups.where("doc_id <> component_id").select("doc_id").unionByName(blank.where(F.col("doc_id") > F.lit(first).cast("long")).select("doc_id"))
    losers = losers.select(F.col("doc_id").alias("_loser")).distinct()
    return docs.join(losers, docs["doc_id"] == losers["_loser"], "left_anti")
