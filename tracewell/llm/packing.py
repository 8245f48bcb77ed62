"""Token ids as fixed-width bit-packed files with random access.

A shard is a run of documents in ascending doc_id order. Its file holds, one after the other:
  blocks   ids in `bits` bits each, least significant bit first, BLOCK_IDS per block, every block
           filled up to whole bytes;
  starts   little-endian u64 per document and one more: the place of its first id in the shard;
  offsets  little-endian u64 per block: where its bytes begin;
  footer   magic, version, bits, ids per block, number of documents, number of ids.
An id range is read by the offsets of its blocks alone, and unpacked as one vector.

Every task writes its own file under a name that no other attempt has; the manifest, a Spark table
of the successful attempts, says which files count. A lost executor costs the tasks it ran.
"""
from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewell.llm.common import map_pandas, stage_table
from tracewell.llm.pieces import Cut, chunks
from tracewell.session import shared_folder

BLOCK_IDS = 65_536
MAGIC = b"IDPACK01"
FOOTER = struct.Struct("<8sIIQQ")
#: Ids unpacked at once when documents are read back.
READ_IDS = 1 << 20
#: A piece that may stand behind any other: at most a blank or a line feed in front, no other white space.
PIECE = r"\A[ \n]?[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+\z"
#: A word of Latin letters with a mark behind it and nothing more: the mark is a token of its own.
MARKED = r"\A[ \n]?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+[,.]\z"
#: Pieces of text a worker remembers.
MAX_PIECES = 400_000


def bits_for(vocabulary_size: int) -> int:
    """The fewest bits that hold ids 0 .. vocabulary_size - 1."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as `bits` bits each, filled up to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, count: int) -> np.ndarray:
    """The first `count` ids of packed bytes, as u32."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=count * bits)
    return (flat.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def file_system(uri: str):
    """(file system, path) of a URI or a plain path; whatever pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Writes one shard; holds at most one block of ids and one number per document."""

    def __init__(self, uri: str, bits: int, block_ids: int = BLOCK_IDS):
        self.bits, self.block_ids = bits, block_ids
        system, path = file_system(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        self.out = system.open_output_stream(path)
        self.pending, self.held = [], 0
        self.starts, self.offsets, self.at = [0], [], 0

    def append(self, ids: np.ndarray) -> None:
        self.starts.append(self.starts[-1] + len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            flat = np.concatenate(self.pending)
            full = len(flat) // self.block_ids * self.block_ids
            for begin in range(0, full, self.block_ids):
                self._block(flat[begin:begin + self.block_ids])
            self.pending, self.held = [flat[full:]], len(flat) - full

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.pending))
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.bits, self.block_ids, len(self.starts) - 1, self.starts[-1]))
        self.out.close()


class ShardReader:
    """Random access to the ids of a shard."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block_ids, self.documents, self.ids = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a packed shard")
        blocks = -(-self.ids // self.block_ids)
        tables = size - FOOTER.size - 8 * (blocks + self.documents + 1)
        raw = self.file.read_at(8 * (self.documents + 1 + blocks), tables)
        self.starts = np.frombuffer(raw, "<u8", self.documents + 1)
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks, 8 * (self.documents + 1)), np.uint64(tables))

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids begin .. end - 1 of the shard."""
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = begin // self.block_ids, (end - 1) // self.block_ids
        lo, hi = int(self.offsets[first]), int(self.offsets[last + 1])
        raw, out = self.file.read_at(hi - lo, lo), []
        for block in range(first, last + 1):
            count = min(self.block_ids, self.ids - block * self.block_ids)
            out.append(unpack(raw[int(self.offsets[block]) - lo:int(self.offsets[block + 1]) - lo], self.bits, count))
        return np.concatenate(out)[begin - first * self.block_ids:end - first * self.block_ids]

    def document(self, number: int) -> np.ndarray:
        """Ids of the n-th document of the shard."""
        return self.read(int(self.starts[number]), int(self.starts[number + 1]))

    def groups(self):
        """(first document, starts, ids) of consecutive documents, about READ_IDS ids at a time."""
        at = 0
        while at < self.documents:
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + READ_IDS, "right")) - 1)
            yield at, self.starts[at:to + 1], self.read(int(self.starts[at]), int(self.starts[to]))
            at = to


def encode_many(tokenizer, texts: list[str], spelled: np.ndarray) -> list[bytes]:
    """Ids of each text as little-endian u32 bytes, by one call of the tokenizers library; `spelled` is the number of bytes of each id.

    The texts are pieces: what is no white space stands behind a blank or a line feed that nothing spans. One behind
    the other they are one text with the same ids, and the bytes that ids spell show where each ends. Pieces without
    such a beginning get a line feed, whose id is taken off again. Texts with other white space or special tokens are encoded alone.
    """
    line = tokenizer.encode("\n", add_special_tokens=False).ids
    pieces = pa.array(texts, pa.large_string())
    plain = pc.match_substring_regex(pieces, PIECE) if len(line) == 1 else pa.array([False] * len(texts))
    for token in tokenizer.get_added_tokens_decoder().values():
        plain = pc.and_not(plain, pc.match_substring(pieces, token.content))
    every = pc.all(plain).as_py() is not False
    whole = pieces if every else pieces.filter(plain)
    out: list[bytes] = []
    if len(whole):
        begun = pc.match_substring_regex(whole, r"\A[ \n]")
        bare = pc.invert(begun).to_numpy(zero_copy_only=False)
        joined = pc.if_else(begun, whole, pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), whole, pa.scalar("", pa.large_string())))
        sizes = pc.binary_length(joined).to_numpy()
        ids = np.array(tokenizer.encode_batch_fast(["".join(joined.to_pylist())], add_special_tokens=False)[0].ids, "<u4")
        ends = np.searchsorted(np.cumsum(spelled[ids]), np.cumsum(sizes)) + 1
        begins = np.concatenate([[0], ends[:-1]]) + bare
        flat = ids.tobytes()
        out = [flat[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist())]
    if every:
        return out
    found = iter(out)
    return [next(found) if p else np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, p in zip(texts, plain.to_pylist())]


class Pieces:
    """The tokenizers library in a worker, with the ids of pieces of earlier chunks up to a bound."""

    def __init__(self, raw: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: bytes each id spells: byte-level tokens have one character per byte
        self.spelled = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.spelled[number] = len(token)
        #: ids of a mark behind a word; the word in front of it ends there
        self.marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in ",."}

    def learn(self, pieces: list[str]) -> None:
        """Adds the ids of pieces to `known`: a mark behind a word is a token of its own, so words are encoded once with and without it."""
        known, marks = self.known, self.marks
        given = pa.array(pieces, pa.large_string())
        marked = pc.match_substring_regex(given, MARKED)
        ended = given.filter(marked).to_pylist()
        rest = given.filter(pc.invert(marked)).to_pylist()
        missing = list({p[:-1] for p in ended}.difference(known, rest)) + rest
        known.update(zip(missing, encode_many(self.tokenizer, missing, self.spelled)))
        known.update([(p, known[p[:-1]] + marks[p[-1]]) for p in ended])

    def arrays(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for chunk in chunks(texts):
            cut = Cut(chunk)
            if len(self.known) > MAX_PIECES:
                self.known = {}
            values = list(map(self.known.get, cut.distinct))
            missing = [p for p, v in zip(cut.distinct, values) if v is None]
            if missing:
                self.learn(missing)
                values = list(map(self.known.__getitem__, cut.distinct))
            for raw in cut.gather(values):
                yield np.frombuffer(raw, "<u4")


_ENCODERS: dict[str, Pieces] = {}


def encoder_of(raw: str) -> Pieces:
    """The worker's encoder for a tokenizer file."""
    if raw not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[raw] = Pieces(raw)
    return _ENCODERS[raw]


def write_shards(docs: DataFrame, folder: str, raw: str, end_id: int = 2, bits: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) into shards below `folder`; returns the manifest, already stored.

    One row per shard: shard (0.. in ascending doc_id order), path, doc_ids, n_docs, n_ids. Null
    texts are empty and get the end id alone; null doc_ids come first; documents with equal ids
    are ordered by text hash. An empty table gives no shards. A task holds a few texts at a time.
    """
    import json

    spec = json.loads(raw)
    top = max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"]), end_id)
    width = bits or bits_for(top + 1)
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def write(batches):
        writer, ids, path = None, [], ""
        encoder = encoder_of(shared.value)
        end = np.array([end_id], "<u4")
        for batch in batches:
            if writer is None:
                path = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
                writer = ShardWriter(path, width)
            ids += [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for tokens in encoder.arrays(t or "" for t in batch["text"]):
                writer.append(np.concatenate([tokens, end]))
        if writer is not None:
            writer.close()
            yield pd.DataFrame({
                "part": [TaskContext.get().partitionId()], "path": [path], "doc_ids": [ids], "n_docs": [len(ids)], "n_ids": [writer.starts[-1]]})
    # Sorted text, not sorted ids, crosses the network: encoding after the exchange runs once, though the range sample reads twice.
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = stage_table(
        map_pandas(ordered, write, "part long, path string, doc_ids array<long>, n_docs long, n_ids long"), "manifest")
    return manifest


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shard files.

    `start` counts the ids of all documents before it: the shards before are summed from the
    manifest (one row per shard), the rest is in the shard.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("part", "n_ids").select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches):
        for batch in batches:
            for part, path, ids in zip(batch["part"], batch["path"], batch["doc_ids"]):
                reader = ShardReader(path)
                for at, starts, tokens in reader.groups():
                    local = (starts - starts[0]).astype(np.int64)
                    yield pd.DataFrame({
                        "part": part, "doc_id": pd.array(list(ids[at:at + len(starts) - 1]), dtype="Int64"), "local": starts[:-1].astype(np.int64),
                        "n_tokens": np.diff(local), "ids_crc32": [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(local[:-1], local[1:])]})
    # A number of partitions that is given is not merged at run time: about one shard per task.
    shards = max(1, manifest.select("part").count())
    rows = map_pandas(
        manifest.select("part", "path", "doc_ids").repartition(shards, "part"), read, "part long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(placed, "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def packing_digest(spark: SparkSession, docs: DataFrame, raw: str | None = None) -> DataFrame:
    """Query op6: documents written as shards in the shared folder and read back."""
    from tracewell.llm.bpe import tokenizer_text

    folder = shared_folder(spark, "token-ids")
    return read_shards(write_shards(docs, folder, raw or tokenizer_text()))
