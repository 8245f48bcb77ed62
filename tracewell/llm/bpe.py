"""Byte-level BPE encoding and decoding by a trie whose nodes share the encodings of prefixes.

The distinct words of a chunk of texts form a trie of bytes. A node stands for a prefix; its
state is the last token of the prefix' encoding. That is enough: a sequence of tokens is the
encoding of its bytes exactly if every two neighbours are (merging the bytes of both gives the same
two tokens), so the last token of a prefix is the one token ending there that fits the last token of
what stands before it, and an encoding is read off backwards along the path. States are computed
depth first, once per node: words that share a prefix share its encoding.

Texts are cut at blanks and line feeds between other characters, where no pre-token of this
tokenizer can span, so each distinct piece of a chunk is encoded once (see `pieces`). Words of earlier
chunks are remembered up to a bound.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import map_pandas, ship
from tracewell.llm.pieces import Cut, chunks

#: Pairs of tokens whose fit a worker remembers; beyond them it starts anew, with the same results.
MAX_PAIRS = 600_000
#: Pre-tokens whose ids a worker remembers; beyond them it starts anew, with the same results.
MAX_WORDS = 250_000
#: Characters of text whose ids are handed back at once.
SLICE_CHARS = 1_500_000
#: A blank and Latin letters are one pre-token, a mark behind them is another.
PLAIN_WORD = re.compile(r"( [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([,.])?")
#: Bits that hold any token id, to pack a pair of ids into one key.
PAIR_SHIFT = 24


class Vocabulary:
    """A byte-level BPE tokenizer file: tokens as bytes, merge ranks, special tokens, pattern.

    Supports what such files of this kind hold: no normalizer, ByteLevel pre-tokenizer without a
    prefix blank, merges over the whole vocabulary. Other settings are refused, not ignored.
    """

    def __init__(self, raw: str):
        import regex

        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"]
        unsupported = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if unsupported or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match plainly")
        to_byte = {c: b for b, c in byte_alphabet().items()}
        spell = lambda token: bytes(to_byte[c] for c in token)
        self.ids = {spell(t): i for t, i in model["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        #: of a token made by a merge: its rank and parts; single bytes have rank -1
        self.rank = {i: -1 for i in self.bytes}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (spell(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            made, a, b = self.ids[left + right], self.ids[left], self.ids[right]
            self.merge_rank[a << PAIR_SHIFT | b] = rank
            if made not in self.parts:
                self.rank[made], self.parts[made] = rank, (a, b)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, number in self.special.items():
            self.bytes[number] = content.encode()
        self.special_pattern = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(PRE_TOKENS)
        # A token is of use only if its own bytes are encoded as it: its parts are, and nothing crosses them before.
        for made, (a, b) in self.parts.items():
            if self.bytes[a] not in self.ids or self.bytes[b] not in self.ids or not self.fits(a, b, self.rank[made]):
                del self.ids[self.bytes[made]]
        #: every beginning of a token: the longest one a prefix ends with bounds the candidates for its last token
        self.beginnings = {t[:i] for t in self.ids for i in range(1, len(t) + 1)}
        self.lengths = {i: len(t) for i, t in self.bytes.items()}
        #: each id as it stands in a list, with the comma behind it
        self.digits = {i: b"%d," % i for i in self.bytes}

    def fits(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether the bytes of two tokens are encoded as these two tokens, so that no merge crosses.

        Going back from the finished tokens, the younger of the two that touch is taken apart; while
        both stood there, a merge of them wins if its rank is below that of the merge that ended this.
        Of equal ranks the left one is merged first. With `limit`, only merges below that rank count.
        """
        rank, merges, parts = self.rank, self.merge_rank, self.parts
        while True:
            crossing = merges.get(left << PAIR_SHIFT | right)
            if crossing is not None and crossing < limit:
                return False
            if rank[left] > rank[right]:
                limit, left = rank[left], parts[left][1]
            elif rank[right] < 0:
                return True
            else:
                limit, right = rank[right] + 1, parts[right][0]


#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that spells it in byte-level vocabularies: printable ones spell themselves, the rest follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Endings:
    """The ends of prefixes that begin a token, numbered as they are met: number 0 is the empty one.

    The longest such end of a prefix bounds what its last token can be: the tokens that end there.
    There are at most as many as beginnings of tokens, so this never outgrows the vocabulary.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.ids, self.beginnings = vocabulary.ids, vocabulary.beginnings
        #: number and byte -> number after that byte
        self.after: dict[int, int] = {}
        self.numbers: dict[bytes, int] = {b"": 0}
        self.texts: list[bytes] = [b""]
        #: per number: tokens with their lengths, longest first
        self.tokens: list[list[tuple[int, int]]] = [[]]

    def step(self, move: int) -> int:
        """The number after one more byte; move is number << 8 | byte."""
        text = self.texts[move >> 8] + bytes((move & 255,))
        while text not in self.beginnings:
            text = text[1:]
        number = self.numbers.get(text)
        if number is None:
            number = self.numbers[text] = len(self.texts)
            self.texts.append(text)
            tails = [text[i:] for i in range(len(text))]
            self.tokens.append([(self.ids[t], len(t)) for t in tails if t in self.ids])
        self.after[move] = number
        return number


class Trie:
    """Distinct words as a trie, walked depth first to encode them all.

    In sorted order words with a common prefix are neighbours, so the sorted words are the trie and
    the path to the current node is all that is held: going to the next word drops the nodes below
    the common prefix and computes states for what follows it. Each node is visited once.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.endings = Endings(vocabulary)
        #: pairs of tokens seen so far, and whether they fit
        self.pairs: dict[int, bool] = {}
        #: nodes visited so far
        self.nodes = 0

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of each pre-token."""
        vocabulary, pairs = self.vocabulary, self.pairs
        after, step, tails, fits, lengths = self.endings.after, self.endings.step, self.endings.tokens, vocabulary.fits, vocabulary.lengths
        # path: the last token of each prefix of the current word; ends: the number of its ending
        out, path, ends, previous = {}, [-1], [0], b""
        for raw, word in sorted((w.encode("utf-8"), w) for w in words):
            depth = 0
            for a, b in zip(previous, raw):
                if a != b:
                    break
                depth += 1
            del path[depth + 1:], ends[depth + 1:]
            ending = ends[depth]
            self.nodes += len(raw) - depth
            for byte in raw[depth:]:
                depth += 1
                move = ending << 8 | byte
                ending = after.get(move)
                if ending is None:
                    ending = step(move)
                for token, length in tails[ending]:
                    if length == depth:
                        break
                    pair = path[depth - length] << PAIR_SHIFT | token
                    fit = pairs.get(pair)
                    if fit is None:
                        fit = pairs[pair] = fits(pair >> PAIR_SHIFT, token)
                    if fit:
                        break
                path.append(token)
                ends.append(ending)
            ids, end = [], depth
            while end:
                token = path[end]
                ids.append(token)
                end -= lengths[token]
            out[word] = ids[::-1]
            previous = raw
            if len(pairs) > MAX_PAIRS:
                pairs.clear()
        return out


class Codec:
    """Encoder and decoder of whole texts in a worker."""

    def __init__(self, raw: str):
        self.vocabulary = Vocabulary(raw)
        self.trie = Trie(self.vocabulary)
        #: pre-tokens of earlier chunks
        self.known: dict[str | tuple[str], list[int]] = self.specials()

    def specials(self) -> dict[str | tuple[str], list[int]]:
        return {(text,): [number] for text, number in self.vocabulary.special.items()}

    def pre_tokens(self, text: str) -> list[str | tuple[str]]:
        """Pre-tokens of a text; a special token spelled in it stands as a tuple among them."""
        plain = PLAIN_WORD.fullmatch(text)
        if plain:
            return [g for g in plain.groups() if g]
        vocabulary, out = self.vocabulary, []
        for part in vocabulary.special_pattern.split(text) if vocabulary.special_pattern else [text]:
            out += [(part,)] if part in vocabulary.special else vocabulary.pattern.findall(part)
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the distinct pre-tokens that were in no earlier chunk are one trie."""
        apart = [self.pre_tokens(t) for t in texts]
        if len(self.known) > MAX_WORDS:
            self.known = self.specials()
        ids = self.known
        ids.update(self.trie.encode({w for words in apart for w in words if w not in ids}))
        return [ids[words[0]] if len(words) == 1 else list(chain.from_iterable(map(ids.__getitem__, words))) for words in apart]

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def arrays(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text as an array."""
        for chunk in chunks(texts):
            cut = Cut(chunk)
            for raw in cut.gather([np.array(ids, "<i4").tobytes() for ids in self.encode_all(cut.distinct)]):
                yield np.frombuffer(raw, "<i4")

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, sha256 of the comma-joined ids, sha256 of the text decoded from them) of each text."""
        digits, spelled = self.vocabulary.digits.__getitem__, self.vocabulary.bytes.__getitem__
        for chunk in chunks(texts):
            cut = Cut(chunk)
            ids = self.encode_all(cut.distinct)
            listed = cut.gather([b"".join(map(digits, i)) for i in ids])
            decoded = cut.gather([b"".join(map(spelled, i)) for i in ids])
            for count, one, other in zip(cut.total([len(i) for i in ids]), listed, decoded):
                text = str(other, "utf-8", "replace").encode("utf-8")
                yield count, hashlib.sha256(one[:-1]).hexdigest(), hashlib.sha256(text).hexdigest()


_CODECS: dict[int, Codec] = {}


def codec_of(raw: str) -> Codec:
    """The worker's codec for a tokenizer file; one per worker process."""
    key = hash(raw)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def tokenizer_text(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer file as text, read once on the driver; it is broadcast (1.6 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def slices(batch: pd.DataFrame, text: str, size: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """The rows of a batch in runs of about `size` characters: the ids of a batch are several times its text, those of a run are few."""
    runs = (batch[text].str.len().fillna(0).cumsum() // size).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.iloc[a:b]


def encoded(docs: DataFrame, raw: str | None = None, text: str = "text") -> DataFrame:
    """docs plus ids array<int>, n_tokens long and round_trip boolean (decoding the ids gives the text).

    Null texts are empty. One pass, no shuffle; columns of docs with these names are replaced.
    """
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

    shared = docs.sparkSession.sparkContext.broadcast(raw or tokenizer_text())
    own = docs.drop("ids", "n_tokens", "round_trip")

    def encode(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            for part in slices(batch, text):
                texts = [t or "" for t in part[text]]
                ids = list(codec.arrays(texts))
                yield part.assign(ids=ids, n_tokens=[len(i) for i in ids], round_trip=[codec.decode(i.tolist()) == t for i, t in zip(ids, texts)])
    schema = StructType(list(own.schema.fields))
    for name, kind in (("ids", ArrayType(IntegerType())), ("n_tokens", LongType()), ("round_trip", BooleanType())):
        schema = schema.add(name, kind)
    return map_pandas(own, encode, schema)


def decoded(docs: DataFrame, raw: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs plus the text of the id array `ids`; null arrays give null."""
    import pyspark.sql.functions as F
    from pyspark.sql.types import StringType

    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(raw or tokenizer_text())

    @F.pandas_udf(StringType())
    def texts(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(shared.value)
        for batch in arrays:
            yield batch.map(lambda a: None if a is None else codec.decode(list(a)))
    return docs.withColumn(out, texts(F.col(ids)))


def bpe_digest(spark: SparkSession, docs: DataFrame, raw: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text).

    Null texts are empty: no tokens, digests of the empty string. Rows are independent, so nulls in
    doc_id and repeated rows pass through. Arrow batches bound what a worker holds to some texts.
    """
    shared = spark.sparkContext.broadcast(raw or tokenizer_text())

    def digests(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            rows = list(codec.digests(t or "" for t in batch["text"]))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_pandas(docs.select("doc_id", "text"), digests, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
