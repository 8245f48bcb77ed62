"""Toxicity by compression distance between two zstandard dictionaries.

Text is cut into windows of a few words. Each window is compressed twice, with a dictionary of
toxic text and with one of ordinary text; the bytes the toxic one saves are the window's gain. The
largest gain of a document and the windows over two thresholds give its score through a logistic
curve that is calibrated on labelled rows the dictionaries have not seen.

Training. Labelled rows fall into three folds by crc32(doc_id) mod 3. Fold 0 trains the
dictionaries, fold 2 calibrates, fold 1 is never looked at. Rows marked toxic are mostly ordinary
text, so a dictionary of all their windows is an ordinary one. Hence the text that tells the classes
apart is cut out first: byte sequences of GRAM_BYTES inside words whose rate in toxic rows is far
above that in others (a stem tells although each of its endings is rare). zstandard trains the toxic
dictionary on the parts of toxic rows that such sequences cover, row by row, and the ordinary one on
windows of ordinary rows. The ordinary content closes both dictionaries, so ordinary text finds the
same matches at the same distance in either; before it stands the toxic content in one and as many
ordinary bytes in the other. At most `sample_rows` rows of each class and fold are used.
"""
from __future__ import annotations

import math
import struct
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.llm.common import map_pandas, stage_table

#: Words per window; a window's words do not overlap with the next one's.
WINDOW_WORDS = 8
#: Rows of each class and fold used to fit; the only bounded part.
SAMPLE_ROWS = 4_000
#: Lengths of the sequences that are looked at for telling the classes apart.
GRAM_BYTES = (5, 8)
#: Telling: log likelihood ratio (natural) of class and sequence, and rate in toxic rows as a multiple of
#: that in others. The first is less where the best sequence has little evidence, as in small tables.
EVIDENCE, LESS_EVIDENCE = 25.0, 12.0
LEAST_RATIO = 24.0
GRAMS_AT_MOST = 4_000
#: Sizes of the trained dictionaries.
TOXIC_BYTES = 4_096
SHARED_BYTES = 6_144
#: Windows of ordinary text, and telling parts of a toxic row, that are trained on; longer ones are cut.
SHARED_WINDOWS = 20_000
PARTS_AT_MOST = 200
WINDOW_BYTES, WORD_BYTES = 1_024, 64
#: Gains from which windows are counted; smaller ones are chance matches, more of them in longer texts.
THRESHOLDS = (2, 4)
THRESHOLD = 0.7
#: Counts a worker holds before it hands them on.
COUNTS_AT_ONCE = 200_000
_MARKS = b".,;:!?\"'()[]"
_PLAIN = bytes.maketrans(_MARKS, b" " * len(_MARKS))
#: What stands before the content of every trained dictionary: zstandard's three first repeat offsets.
_REPEATS = struct.pack("<3I", 1, 4, 8)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for null."""
    return F.crc32(doc_id.cast("string")) % 3


def words_without_marks(text: str | None) -> list[bytes]:
    """Lower-cased words; marks part words as white space does."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()


def spans(word: bytes) -> list[tuple[int, int]]:
    """Places of the sequences in a word between blanks; a word shorter than all of them is its own."""
    return [(i, i + n) for n in GRAM_BYTES for i in range(len(word) - n + 1)] or [(0, len(word))]


def telling_parts(word: bytes, telling: frozenset[bytes]) -> list[bytes]:
    """Parts of a word between blanks that telling sequences cover."""
    parts: list[list[int]] = []
    for start, end in sorted((a, b) for a, b in spans(word) if word[a:b] in telling):
        if parts and start <= parts[-1][1]:
            parts[-1][1] = max(end, parts[-1][1])
        else:
            parts.append([start, end])
    return [word[start:end] for start, end in parts]


def windows(text: str | None) -> list[bytes]:
    """Lower-cased windows of WINDOW_WORDS words, each between blanks; a text without words has none."""
    words = words_without_marks(text)
    return [b" " + b" ".join(words[i:i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


@dataclass(frozen=True)
class Model:
    """The two dictionaries' contents and the calibration; a few kilobytes, broadcast to the tasks."""
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


class _Scorer:
    """Compressors of a worker for one model."""

    def __init__(self, model: Model):
        import zstandard as z

        def compressor(content: bytes):
            data = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            # Matches of less than six bytes are chance; frames carry nothing but the data.
            settings = z.ZstdCompressionParameters.from_level(
                3, dict_size=len(content), min_match=6, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False,
                write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
            data.precompute_compress(compression_params=settings)
            return z.ZstdCompressor(dict_data=data, compression_params=settings).compress
        self.toxic, self.ordinary, self.weights = compressor(model.toxic), compressor(model.ordinary), model.weights

    def gains(self, text: str | None) -> tuple[int, int, int, int]:
        """(largest gain of a window, windows over either threshold, all windows); zeros for texts without words."""
        toxic, ordinary, low, high = self.toxic, self.ordinary, *THRESHOLDS
        cut = windows(text)
        found = [len(ordinary(w)) - len(toxic(w)) for w in cut]
        return max(found, default=0), sum(g >= low for g in found), sum(g >= high for g in found), len(cut)

    def score(self, text: str | None) -> float:
        return float(_logistic(np.array([_features(*self.gains(text))]), self.weights)[0])


def _features(most: int, some: int, many: int, size: int) -> tuple[float, ...]:
    return 1.0, min(max(most, 0), 12) / 4.0, math.log1p(some), math.log1p(many), math.log1p(size) / 4.0


def _logistic(rows: np.ndarray, weights) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(rows @ np.asarray(weights), -30, 30)))


def _fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression with a slight ridge, by Newton steps."""
    weights = np.zeros(rows.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (rows.shape[1] - 1))
    for _ in range(rounds):
        p = _logistic(rows, weights)
        slope = rows.T @ (labels - p) - ridge @ weights
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + ridge + 1e-9 * np.eye(rows.shape[1])
        step = np.linalg.solve(curve, slope)
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(w) for w in weights)


def _sampled(docs: DataFrame, labels: DataFrame, number: int, sample_rows: int) -> DataFrame:
    """(toxic, text) of at most sample_rows rows of each class of one fold, chosen by hash."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) == number)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample_rows).union(known.where("toxic = 0").orderBy(*order).limit(sample_rows))
    # At most 2 * sample_rows ids: small enough to broadcast whatever the input.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def _count_grams(batches):
    """For each sequence the texts of either class that hold it, as counts to be added up."""
    held = (Counter(), Counter())

    def counts():
        found = list(held[0].keys() | held[1].keys())
        return pd.DataFrame({"gram": pd.Series(found, dtype=object), "t": [held[1][g] for g in found], "o": [held[0][g] for g in found]})
    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"]):
            words = {b" " + w + b" " for w in words_without_marks(text)}
            held[label].update({w[a:b] for w in words for a, b in spans(w)})
            if len(held[0]) + len(held[1]) > COUNTS_AT_ONCE:
                yield counts()
                held[0].clear(), held[1].clear()
    yield counts()


def telling_grams(learn: DataFrame, toxic_rows: int, ordinary_rows: int) -> frozenset[bytes]:
    """Sequences far more frequent in toxic rows of learn (toxic, text) than in others."""
    t, o, share = F.col("t"), F.col("o"), toxic_rows / (toxic_rows + ordinary_rows)
    expected = (t + o) * share
    evidence = t * F.log(t / expected) + F.when(o > 0, o * F.log(o / (t + o - expected))).otherwise(0.0)
    counts = map_pandas(learn, _count_grams, "gram binary, t long, o long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    above = counts.where((t >= 2) & (t > expected)).withColumn("evidence", evidence)
    above = above.withColumn("ratio", t / toxic_rows / ((o + 1) / ordinary_rows))
    rows = above.orderBy(F.col("evidence").desc(), "gram").limit(GRAMS_AT_MOST).collect()
    if not rows:
        return frozenset()
    best, ratio = rows[0]["evidence"], min(LEAST_RATIO, rows[0]["ratio"] / 2)
    least = min(EVIDENCE, max(best / 8, min(LESS_EVIDENCE, best / 2)))
    return frozenset(bytes(r["gram"]) for r in rows if r["evidence"] >= least and r["ratio"] >= ratio)


def _train(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a dictionary that zstandard trains on the samples."""
    import zstandard
    try:
        whole = zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its own words serve
        return b"".join(dict.fromkeys(samples))[:size]
    return whole[whole.index(_REPEATS) + len(_REPEATS):]


def _collected(samples: DataFrame, number: int) -> list[bytes]:
    """At most `number` of the samples (w), the same ones in the same order however the rows lie."""
    return [bytes(r["w"]) for r in samples.orderBy(F.xxhash64("w"), "w").limit(number).collect()]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits dictionaries and calibration; None if a class has no row in fold 0.

    Only text is looked at, equal texts once. What reaches the driver is bounded: GRAMS_AT_MOST sequences,
    telling parts of sample_rows rows, SHARED_WINDOWS windows, and five numbers per calibration row.
    """
    sample = _sampled(docs, labels, 0, sample_rows).repartition(32, "toxic", "text").dropDuplicates(["toxic", "text"])
    learn = stage_table(sample, "toxicity-learn")
    sizes = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic_rows, ordinary_rows = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic_rows or not ordinary_rows:
        return None
    telling = telling_grams(learn, toxic_rows, ordinary_rows)

    def told(batches):
        for batch in batches:
            found = ([p for w in words_without_marks(t) for p in telling_parts(b" " + w[:WORD_BYTES] + b" ", telling)] for t in batch["text"])
            yield pd.DataFrame({"w": [b"".join(parts[:PARTS_AT_MOST]) for parts in found if parts]}, dtype=object)

    def cut(batches):
        for batch in batches:
            yield pd.DataFrame({"w": [w[:WINDOW_BYTES] for t in batch["text"] for w in windows(t)]}, dtype=object)
    toxic = _train(_collected(map_pandas(learn.where("toxic = 1"), told, "w binary"), sample_rows), TOXIC_BYTES, 64)
    shared = _train(_collected(map_pandas(learn.where("toxic = 0"), cut, "w binary"), SHARED_WINDOWS), SHARED_BYTES, 32) or b" " * 8
    others = (shared * (len(toxic) // len(shared) + 1))[len(shared) - len(toxic) % len(shared):] if toxic else b""
    model = Model(toxic + shared, others + shared, (0.0,) * 5)
    calibrate = _sampled(docs, labels, 2, sample_rows)
    names = ("most", "some", "many", "size")

    def measure(batches):
        scorer = _Scorer(model)
        for batch in batches:
            found = [scorer.gains(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], **{n: [f[k] for f in found] for k, n in enumerate(names)}})
    rows = map_pandas(calibrate, measure, "toxic int, " + ", ".join(f"{n} long" for n in names)).collect()
    if len({r["toxic"] for r in rows}) < 2:
        return Model(model.toxic, model.ordinary, (-4.0, 2.0, 0.0, 0.0, 0.0))  # no two classes to calibrate on: half-way at a gain of eight
    data = np.array([_features(*(r[n] for n in names)) for r in rows])
    return Model(model.toxic, model.ordinary, _fit(data, np.array([r["toxic"] for r in rows], float)))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs (doc_id, text).

    Null and empty texts have no gain and get the score of that. Without a model every score is 0.
    held_out is false for null ids; rows are independent, so repeated ones pass through.
    """
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        scorer = _Scorer(model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [scorer.score(t) for t in batch["text"]]})
    rows = map_pandas(docs.select("doc_id", "text"), score, f"doc_id {id_type}, score double")
    return rows.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query op9: trained on the labelled folds, applied to every whole text."""
    return scored(docs, train(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))))
