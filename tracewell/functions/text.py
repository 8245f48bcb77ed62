"""Text normal forms, label tests and cell formatting."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from tracewell.schemas import COHORT_TOKENS, GROUP_TOKENS

# White space as the source format counts it: Unicode white space and the four separators.
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"
UNICODE = "(?U)"
# Letters whose case fold is not their lower case (fixed values).
_FOLDS = {"ß": "ss", "ς": "σ", "ſ": "s", "µ": "μ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def let(value: Column, body) -> Column:
    """Bind a column once so that a lambda body may use it many times without re-evaluation."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{UNICODE}{SPACE}+", " "))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(f"{UNICODE}{NON_SPACE}")


def has_text(value: Column) -> Column:
    """Neither null nor empty."""
    return value.isNotNull() & (value.cast("string") != "")


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def cell(value: Column) -> Column:
    """text cell, null -> ''."""
    return F.coalesce(value.cast("string"), F.lit(""))


def actor_key(label: Column) -> Column:
    """case-folded label with collapsed white space."""
    folded = F.lower(label)
    for letter, fold in _FOLDS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(fold))
    return collapse(folded)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def normal_text(text: Column) -> Column:
    """F8: NFKC, collapsed, lower case; null -> ''.

    Plain ASCII is its own NFKC form, so only other text is sent to Python (nulls go in its place).
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    other = _nfkc(F.when(~text.rlike(r"^\p{ASCII}*$"), text))
    return F.lower(collapse(F.coalesce(other, text)))


def ascii_normal_text(text: Column) -> Column:
    """F8 for columns known to hold ASCII only (codes, dates, enum values): stays in the JVM."""
    return F.lower(collapse(F.coalesce(text.cast("string"), F.lit(""))))


def _product(a: Column, b: Column) -> tuple[Column, Column]:
    """a*b as an unevaluated exact sum of two doubles (Dekker's product)."""
    def halves(x: Column) -> tuple[Column, Column]:
        c = x * 134217729.0
        high = c - (c - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    high = a * b
    return high, ((ah * bh - high) + ah * bl + al * bh) + al * bl


def _six_digits(size: Column, exponent: Column) -> Column:
    """The first six significant digits as a whole number, rounded half to even on the exact binary value."""
    shift = F.lit(5) - exponent
    power = F.pow(F.lit(10.0), F.abs(shift).cast("double"))
    high, low = _product(size, power)
    quotient = size / power
    back_high, back_low = _product(quotient, power)
    scaled = F.when(shift >= 0, F.struct(high.alias("h"), low.alias("l"))).otherwise(
        F.struct(quotient.alias("h"), ((size - back_high) - back_low).alias("l")))

    def round_even(x: Column) -> Column:
        whole = F.floor(x["h"])
        part = x["h"] - whole
        up = (part > 0.5) | ((part == 0.5) & ((x["l"] > 0) | ((x["l"] == 0) & (whole % 2 == 1))))
        return whole + F.when(up, 1).otherwise(0)

    return let(scaled, round_even)


def number_text(value: Column) -> Column:
    """a number as %g prints it (six significant digits, no trailing zeros)."""
    value = value.cast("double")
    size = F.abs(value)
    lead = F.regexp_extract(F.format_string("%.16e", size), r"e([+-]\d+)$", 1).cast("int")

    def strip(text: Column) -> Column:
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0*$", "")).otherwise(text)

    def spell(d: Column) -> Column:
        digits, e = d["n"], d["e"]
        mantissa = strip(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, 2, 5)))
        power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        small = strip(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
        plain = strip(F.concat(F.left(digits, e + 1), F.lit("."), F.substring(digits, e + 2, F.lit(6))))
        return F.when((e < -4) | (e >= 6), F.concat(mantissa, power)).when(e < 0, small).otherwise(plain)

    def settle(x: Column) -> Column:
        # rounding can reach the next power of ten
        over = x["n"] >= 1_000_000
        return F.struct(
            F.when(over, "100000").otherwise(x["n"].cast("string")).alias("n"), (x["e"] + F.when(over, 1).otherwise(0)).alias("e"))

    digits = let(lead, lambda e: let(F.struct(_six_digits(size, e).alias("n"), e.alias("e")), lambda x: let(settle(x), spell)))
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(value.isNull(), "").when(value == 0, "0").otherwise(F.concat(sign, digits))


def contains_any(text: Column, tokens) -> Column:
    hit = F.lit(False)
    for token in tokens:
        hit = hit | text.contains(token)
    return hit


def looks_group(label: Column) -> Column:
    """F13."""
    return F.coalesce(contains_any(F.lower(label), GROUP_TOKENS), F.lit(False))


def looks_cohort(label: Column) -> Column:
    """F14."""
    return contains_any(F.lower(F.coalesce(label, F.lit(""))), COHORT_TOKENS)


# Alias patterns (fixed values), applied to the F8 form.
ANONYMOUS_ALIASES = (
    r"^party [a-z0-9]+$",
    r"^bidder [a-z0-9]+$",
    r"^financial sponsor [a-z0-9]+$",
    r"^strategic party [a-z0-9]+$",
    r"^unnamed\b",
    r"^anonymous\b",
)
ANONYMOUS_ALIAS = "|".join(ANONYMOUS_ALIASES)
COHORT_ALIAS = r"\b(?:party|bidder|sponsor|strategic party|financial sponsor)\s+[a-z0-9]+\b"


def is_anonymous_alias(normal: Column) -> Column:
    return normal.rlike(ANONYMOUS_ALIAS)


def is_cohort_alias(normal: Column) -> Column:
    return normal.rlike(COHORT_ALIAS)


def bidder_class(value: Column) -> Column:
    """short forms spelled out, anything else null."""
    return (
        F.when(value.isin("strategic", "financial", "mixed", "unknown"), value)
        .when(value == "s", "strategic")
        .when(value == "f", "financial")
    )


def bidder_class_or_unknown(value: Column) -> Column:
    return F.when(value.isin("strategic", "financial", "mixed", "unknown"), value).otherwise("unknown")


def humanize(code: Column) -> Column:
    """code -> Title Case."""
    return F.initcap(F.trim(F.replace(code, F.lit("_"), F.lit(" "))))


def split_cell(value: Column) -> Column:
    """a ` | `-joined cell -> array of non-blank parts."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r" \| "), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def join_cell(values: Column, separator: str = " | ") -> Column:
    """joined non-empty values."""
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), separator)


def row_fingerprint(slug: Column, row: dict[str, Column]) -> Column:
    """fifteen normalised fields of a review row."""
    def normal(name: str) -> Column:
        return normal_text(row[name])

    return F.concat_ws(
        " | ",
        slug, F.lit("review"),
        *[ascii_normal_text(row[n]) for n in ("event_type", "event_subtype", "event_date")],
        normal("actor_label"),
        *[normal(n) for n in ("actor_kind", "actor_role")],
        *[number_text(row[n]) for n in ("bid_value", "bid_value_lower", "bid_value_upper")],
        *[ascii_normal_text(row[n]) for n in ("bid_value_unit", "consideration_type")],
        cell(row["bound_source_page"]),
        F.substring(normal("bound_source_quote"), 1, 180),
    )


def bid_state(value: Column, lower: Column, upper: Column, unit: Column, consideration: Column) -> Column:
    """which parts of a bid value are present."""
    def state(name: str, part: Column) -> Column:
        return F.when(has_text(part), F.lit(name)).otherwise(F.lit(f"no_{name}"))

    return F.concat_ws(
        "/", F.lit("review"), state("value", value), state("lower", lower), state("upper", upper),
        F.concat(F.lit("unit:"), F.coalesce(blank_to_null(unit), F.lit("null"))),
        F.concat(F.lit("consideration:"), F.coalesce(blank_to_null(consideration), F.lit("null"))),
    )


def strict_json(text: Column) -> Column:
    """The text as a variant if it is one JSON value and nothing else, otherwise null.

    The parser stops behind the first value, so what follows it is seen only inside brackets: a text that
    closes a list early does not fit an object, and the other way round.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = (F.size(listed.cast("array<variant>")) == 1) & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_parse_json(text))


_BLOCK = 256


def sums_before(sizes: Column) -> Column:
    """For each place of an array of numbers the sum of all earlier ones, in time near its length.

    Sums of blocks come first, then sums of the blocks before each block; a place adds what stands before
    it in its own block.
    """
    add = lambda a, n: a + n
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), add)
    places = lambda count: F.filter(F.sequence(F.lit(0), count), lambda i: i < count)

    def spread(sizes: Column) -> Column:
        blocks = F.ceil(F.size(sizes) / _BLOCK).cast("int")
        own = F.transform(places(blocks), lambda b: total(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = let(own, lambda own: F.transform(own, lambda _, b: total(F.slice(own, F.lit(1), b))))
        return let(before, lambda before: F.transform(sizes, lambda _, i: F.get(before, F.floor(i / _BLOCK).cast("int")) + total(
            F.slice(sizes, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))

    return let(F.transform(sizes, lambda n: n.cast("long")), spread)


def stamp(time: Column) -> Column:
    """a point in time as text, whole seconds, with Z for UTC; the session's zone must be UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def instant(stamped: Column | str) -> Column:
    """whole seconds since 1970 of a stamp; null for anything that is none."""
    return F.unix_seconds(F.try_to_timestamp(stamped, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
