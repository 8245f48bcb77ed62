"""Repeated word passages across documents, by seed and extend.

Words are what ASCII white space parts. A passage is repeated if 20 consecutive words of it stand
earlier, in a smaller doc_id or earlier in the same document.

Seeds: every window of 20 words picks the least hash among its 8-word shingles (winnowing), so equal
windows pick equal anchors at equal places. Anchors, about one in seven words, are the only thing
that is counted for all texts; anchors that occur once end there.

Extension: an anchor is extended both ways over the words of all windows that picked it; this span,
as one hash, meets the equal spans of other occurrences. Only the earliest of equal spans goes on:
all windows of the others stand in it. Where an anchor has several spans (the ends of a repeat), the
earliest of each is extended window by window and meets the others in groups of equal windows. So
matches are never expanded into pairs, however often a passage occurs. Windows that stand earlier
are merged into maximal repeats, whose words are removed.

Hashes are taken in two independent lanes; what decides is an equality of 128 bits.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.llm.common import map_pandas, stage_table

WINDOW = 20
SHINGLE = 8
#: Shingles of a window.
PICK = WINDOW - SHINGLE + 1
#: Bits of an anchor: it only nominates, and 48 bits make the largest exchange smaller.
ANCHOR_BITS = 48
#: Bytes of text hashed at once.
CHUNK_BYTES = 1 << 19
#: A place packs 20 bits of the text's hash, the first of its windows and their number.
SALT_SHIFT, START_SHIFT = 43, 5
#: Null doc_ids come last, as one document.
LAST = (1 << 63) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the two hash lanes, for bytes and for words.
BYTE_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))
WORD_BASES = (np.uint64(0xD6E8FEB86659FD93 | 1), np.uint64(0xA0761D6478BD642F | 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a byte base modulo 2^64 and their inverses, grown as texts need them."""
    have = _POWERS.get(lane)
    if have is None or len(have[0]) < size:
        base = int(BYTE_BASES[lane])
        inverse = pow(base, -1, 1 << 64)

        def grow(b):
            out = np.ones(1, np.uint64)
            step = b
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(step)])
                step = step * step % (1 << 64)
            return out
        have = _POWERS[lane] = grow(base), grow(inverse)
    return have


def word_bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    inside = np.concatenate(([False], ~_SPACE[buffer], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """Polynomial hash of each word from prefix sums, mixed with its length."""
    powers, inverses = _powers(lane, len(buffer) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers[:len(buffer)], dtype=np.uint64)))
    return _mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def _runs(words: np.ndarray, lengths: tuple[int, ...], lane: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of the given numbers of words, by doubling and joining."""
    base = int(WORD_BASES[lane])
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    doubled, size = {1: words}, 1
    while 2 * size <= max(lengths):
        short = doubled[size]
        doubled[2 * size] = short[:-size] * power(size) + short[size:] if len(short) > size else np.empty(0, np.uint64)
        size *= 2
    out = {}
    for length in lengths:
        whole, done = None, 0
        for size in sorted(doubled, reverse=True):
            if length - done >= size:
                part = doubled[size][done:]
                whole = part if whole is None else whole[:len(part)] * power(size) + part[:len(whole)]
                done += size
        out[length] = whole
    return out


class Words:
    """Words of several texts as one sequence, with the hashes that seeding and extending need."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        starts, ends = word_bounds(buffer)
        self.owner = np.searchsorted(np.cumsum(self.sizes), starts, side="right")
        self.first = np.searchsorted(self.owner, np.arange(len(texts)))
        lanes = [_word_hashes(buffer, starts, ends, lane) for lane in (0, 1)]
        self.count = len(starts)
        runs = [_runs(w, (SHINGLE, WINDOW), lane) for lane, w in enumerate(lanes)]
        self.shingle = _mixed(runs[0][SHINGLE])
        self.windows = [_mixed(r[WINDOW]) for r in runs]
        self.inside = self.owner[WINDOW - 1:] == self.owner[:len(self.owner) - WINDOW + 1] if self.count >= WINDOW else np.empty(0, bool)

    def picks(self) -> np.ndarray:
        """For every window the place of the shingle it picks: the least, of equal ones the last."""
        place = np.arange(len(self.shingle))
        step = 1
        while step < PICK:
            # The last step overlaps where PICK is no power of two.
            by = min(step, PICK - step)
            left, right = place[:-by], place[by:]
            place = np.where(self.shingle[right] <= self.shingle[left], right, left)
            step += by
        return place

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, span hash, first window, number of windows) of every picked anchor.

        Windows that pick the same anchor in the same text are neighbours. The span hash folds in
        all of them (hence every word around the anchor that any window covers).
        """
        valid = np.flatnonzero(self.inside)
        if not len(valid):
            return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        picked, owner = self.picks()[valid], self.owner[valid]
        new = np.flatnonzero(np.concatenate(([True], (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1]))))
        number = np.diff(np.append(new, len(valid)))
        first, last = valid[new], valid[new + number - 1]
        # The first and the last window overlap (they are less than 20 apart), so both together are the span.
        span = _mixed(self.windows[1][first] * WORD_BASES[0] + self.windows[1][last] + number.astype(np.uint64))
        return self.shingle[picked[new]] >> np.uint64(64 - ANCHOR_BITS), span, first, number


def _salt(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little") & ((1 << 20) - 1)


def _emit_packed(batches):
    """Texts as compressed UTF-8, to cross the network; every empty or null one is empty."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=6).compress
    for batch in batches:
        yield pd.DataFrame({
            "doc": batch["doc"], "doc_id": batch["doc_id"], "packed": [squeeze(t.encode("utf-8", "replace")) if t else b"" for t in batch["text"]]})


def _opened(column: pd.Series):
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return (expand(p) if p else b"" for p in column)


def _chunks(raws):
    """Row numbers and encoded texts of a batch, some megabytes at a time; one text is never cut."""
    rows, texts, held = [], [], 0
    for row, raw in enumerate(raws):
        rows.append(row)
        texts.append(raw)
        held += len(raw)
        if held >= CHUNK_BYTES:
            yield rows, texts
            rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def _places(texts: list[bytes], owner: np.ndarray, first: np.ndarray, number: np.ndarray) -> np.ndarray:
    salts = np.fromiter(map(_salt, texts), np.int64, len(texts))
    return salts[owner] << SALT_SHIFT | first << START_SHIFT | number


def _emit_seeds(batches):
    for batch in batches:
        keys = batch["doc"].to_numpy(np.int64)
        for rows, texts in _chunks((t or "").encode("utf-8", "replace") for t in batch["text"]):
            words = Words(texts)
            anchor, span, first, number = words.seeds()
            owner = words.owner[first]
            yield pd.DataFrame({
                "anchor": anchor.view(np.int64), "span": span.view(np.int64), "doc": keys[np.array(rows)][owner],
                "place": _places(texts, owner, first - words.first[owner], number)})


def _unpacked(places, text: bytes) -> np.ndarray:
    """Starts of the windows in a list of places that belong to this text."""
    packed = np.asarray(places, np.int64)
    packed = packed[packed >> SALT_SHIFT == _salt(text)]
    first, number = (packed >> START_SHIFT) & ((1 << (SALT_SHIFT - START_SHIFT)) - 1), packed & ((1 << START_SHIFT) - 1)
    return np.repeat(first, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)


def _emit_windows(batches):
    """Windows to be extended one by one: (key1, key2, doc, place)."""
    for batch in batches:
        keys, places = batch["doc"].to_numpy(np.int64), batch["places"].tolist()
        for rows, texts in _chunks(_opened(batch["packed"])):
            words = Words(texts)
            starts = [_unpacked(places[r], t) for r, t in zip(rows, texts)]
            owner = np.repeat(np.arange(len(rows)), [len(s) for s in starts])
            local = np.concatenate(starts)
            at = local + words.first[owner]
            yield pd.DataFrame({
                "key1": words.windows[0][at].view(np.int64), "key2": words.windows[1][at].view(np.int64),
                "doc": keys[np.array(rows)][owner], "place": _places(texts, owner, local, np.ones(len(at), np.int64))})


def _emit_kept(batches):
    for batch in batches:
        out = {"n_words": [], "n_removed": [], "kept": []}
        for raw, places in zip(_opened(batch["packed"]), batch["places"].tolist()):
            words = raw.split()
            starts = _unpacked(places, raw) if places is not None else ()
            out["n_words"].append(len(words))
            if len(starts):
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + WINDOW, -1)
                words = [w for w, c in zip(words, np.cumsum(change[:-1]).tolist()) if not c]
            out["n_removed"].append(out["n_words"][-1] - len(words))
            out["kept"].append(b" ".join(words).decode("utf-8", "replace"))
        yield pd.DataFrame({"doc_id": batch["doc_id"]} | out)


def _by_document(rows: DataFrame) -> DataFrame:
    """Places per document; as many as the document has anchors or windows, at most."""
    return rows.groupBy("doc").agg(F.collect_list("place").alias("places"))


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of docs: `kept` is what is left, joined by blanks.

    Null and short texts lose nothing. Rows with equal doc_id and text are one document and get equal
    results; of rows with equal doc_id the text hash orders the texts. Null doc_ids are one last
    document in this sense. Any other columns are ignored.
    """
    own = docs.select("doc_id", F.col(text).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # The packed texts are dealt out by document once: the joins below take the same columns, so they share that exchange.
    texts = map_pandas(own, _emit_packed, f"doc long, doc_id {id_type}, packed binary")
    seeds = map_pandas(own.select("doc", "text"), _emit_seeds, "anchor long, span long, doc long, place long")
    repeated = seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    hits = stage_table(seeds.join(repeated, "anchor"), "seeds")
    firsts = stage_table(hits.groupBy("span", "anchor").agg(F.min(F.struct("doc", "place")).alias("first")), "spans")
    copies = hits.join(firsts, ["span", "anchor"]).where(F.struct("doc", "place") > F.col("first")).select("doc", "place")
    # Stored, so that the join below reads both sides as they were dealt out and can split a hot anchor.
    several = stage_table(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "several")
    extend = _by_document(firsts.join(several, "anchor").select("first.doc", "first.place"))
    windows = map_pandas(
        texts.join(extend, "doc").select("doc", "doc_id", "packed", "places"), _emit_windows, "key1 long, key2 long, doc long, place long")
    earliest = windows.groupBy("key1", "key2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place")).alias("first")).where("n > 1")
    later = windows.join(earliest, ["key1", "key2"]).where(F.struct("doc", "place") > F.col("first")).select("doc", "place")
    flagged = _by_document(copies.union(later))
    return map_pandas(
        texts.join(flagged, "doc", "left").select("doc_id", "packed", "places"), _emit_kept,
        f"doc_id {id_type}, n_words long, n_removed long, kept string")


def substring_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Query op7: counts and the digest of what is left of every document."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
