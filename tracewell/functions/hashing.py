"""Identifiers and digests (F1-F6, F32, F33) as column expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

_UNIT = "\u001f"


def _text(part: Column | str | int) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def stable_json(struct: Column) -> Column:
    """compact JSON of a struct whose fields are already in name order; nulls are kept."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def stable_hash(*parts: Column | str, length: int = 24) -> Column:
    """SHA-256 over the parts, each closed by the unit separator. A null part is JSON null."""
    closed = [F.concat(F.coalesce(_text(p).cast("string"), F.lit("null")), F.lit(_UNIT)) for p in parts]
    return F.substring(F.sha2(F.concat(*closed), 256), 1, length)


def make_id(prefix: str, *parts: Column | str) -> Column:
    """prefixed 24-hex identifier."""
    if not re.fullmatch(r"(?=.*[^\W_])\w+", prefix):
        raise ValueError(f"invalid id prefix: {prefix!r}")
    return F.concat(F.lit(prefix + "_"), stable_hash(*parts))


def text_hash(text: Column) -> Column:
    """SHA-256 of UTF-8 text."""
    return F.sha2(text, 256)


def evidence_fingerprint(filing_id: Column, start: Column, end: Column, quote_hash: Column) -> Column:
    """F5."""
    return F.sha2(F.concat_ws(_UNIT, filing_id, start.cast("string"), end.cast("string"), quote_hash), 256)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """16-hex identifier over `|`-joined parts; a null part is spelled None."""
    joined = F.concat_ws("|", *[F.coalesce(_text(p).cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 16))


def cycle_id(deal_slug: Column, sequence: int = 1) -> Column:
    return stable_id("cycle", deal_slug, str(sequence))


def digest(values: Column, length: int = 12) -> Column:
    """F32: short digest of an array of strings, in sorted order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(values), "\n"), 256), 1, length)


def content_version(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """one hash over (name, bytes) of a handful of rule files, in name order.

    The input is the rule book itself (a few text files), not data, so one row is its size.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(content).cast("binary").alias("c"))))
    nul = F.lit(bytearray(b"\0"))
    joined = F.aggregate(
        ordered,
        F.lit(bytearray(b"")),
        lambda acc, f: F.concat(acc, F.encode(f["n"], "utf-8"), nul, f["c"], nul),
    )
    return files.agg(F.sha2(joined, 256).alias("content_version"))


def prompt_hash(system: Column, user: Column) -> Column:
    return F.sha2(F.concat(system, F.lit("\n---\n"), F.coalesce(user, F.lit(""))), 256)
