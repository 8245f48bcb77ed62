"""Taking texts apart into pieces that are encoded on their own, and joining the pieces' values.

A byte-level BPE pre-token never spans a blank or a line feed that stands between two other
characters, so a text may be cut before it. A chunk of texts is cut, its distinct pieces are
encoded once, and every text's value is gathered from theirs, all as Arrow arrays: what runs per
piece of text is no Python, what runs in Python is done per distinct piece. Memory is bounded by the
size of a chunk, and results do not depend on the order of texts.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ADJACENT_SPACES = re.compile(r"\s\s")
#: Where a text with adjacent white space may be cut; others may be before every blank and line feed.
LONE_SPACE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Characters of text cut at once; a longer text is a chunk of its own.
CHUNK_CHARS = 4_000_000


def chunks(texts: Iterable[str], size: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about `size` characters."""
    chunk, held = [], 0
    for text in texts:
        chunk.append(text)
        held += len(text)
        if held >= size:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def unused_character(texts: list[str]) -> str:
    """A character that none of the texts holds: private ones first, then any other that is no white space."""
    every = map(chr, chain(range(0xE000, 0xF900), range(0x1, 0xD800), range(0xF900, 0x110000)))
    return next(c for c in every if not c.isspace() and not any(c in t for t in texts))


class Cut:
    """Texts cut into pieces: the distinct ones, and for each text which of them it consists of."""

    def __init__(self, texts: list[str]):
        mark = unused_character(texts)
        cut = pa.array([
            LONE_SPACE.sub(mark, t) if ADJACENT_SPACES.search(t) else t.replace(" ", mark + " ").replace("\n", mark + "\n") for t in texts], pa.large_string())
        lists = pc.split_pattern(cut, mark)
        coded = lists.flatten().dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_pylist()
        self.numbers = coded.indices
        #: text n is the pieces from bounds[n] to bounds[n + 1]
        self.bounds = lists.offsets.to_numpy()

    def gather(self, values: list[bytes]) -> list[memoryview]:
        """Of each text the values of its pieces, one behind the other; values are those of `distinct`."""
        taken = pa.array(values, pa.large_binary()).take(self.numbers)
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, "<i8", len(taken) + 1)[self.bounds].tolist()
        whole = memoryview(data or b"")
        return [whole[a:b] for a, b in zip(at, at[1:])]

    def total(self, values: list[int]) -> list[int]:
        """Of each text the sum of its pieces' values."""
        running = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[self.numbers.to_numpy()])])
        return np.diff(running[self.bounds]).tolist()
