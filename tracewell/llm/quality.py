"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure is one bit of `failed`, beside the
measurements it was judged on. Policies are versioned sets of rules: applying one is a bitwise
AND, and an ablation ("what if rule r were dropped?") groups documents by their failed bits.
All of it is one pass of built-in functions without a shuffle; nothing depends on other documents.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import NON_SPACE, words_of

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """One rule: its bit in the ledger, and the SQL condition under which a document fails it."""
    name: str
    bit: int
    fails: str


#: Bits are never reused: a stored ledger stays readable when rules are added.
RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("exclamations", 4, "10 * n_exclaims > 3 * n_words"),
    Rule("word_length", 5, "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)
#: Version -> names of the rules that reject. "base" is the fixed minimum, "v1" the production policy.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "exclamations", "word_length"),
}


def mask_of(policy: str) -> int:
    """The bits of a policy."""
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _covered(words: str) -> str:
    """SQL: how many words lie in a window of five words whose sequence stands twice or more in `words`.

    Windows are sorted with their place, so equal ones are neighbours; the places that have an
    equal neighbour, sorted, each add the words not yet covered by the place before.
    """
    windows = f"transform(sequence(0, size({words}) - {WINDOW}), i -> struct(concat_ws(' ', slice({words}, i + 1, {WINDOW})) as w, i as i))"
    return f"""aggregate(array({windows}), 0L, (total, raw) -> aggregate(
        array(sort_array(raw)), 0L, (sum0, s) -> aggregate(
            array(sort_array(transform(filter(s, (x, k) -> x.w = get(s, k - 1).w OR x.w = get(s, k + 1).w), x -> x.i))), 0L,
            (sum1, p) -> aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x))))"""


def measurements(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_exclaims, n_lines, n_dup_lines, n_repeat_words.

    A null text has no words, lines or symbols; every count is 0. Whole texts are measured, however
    long. Columns of docs with these names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(NON_SPACE))
    step = docs.withColumns({"_words": words_of(body), "_lines": lines})
    # Equal windows have equal hashes: documents whose hashes all differ repeat nothing and skip the exact count.
    hashes = (f"transform(_words, (w, i) -> if(i + {WINDOW} <= size(_words), "
              + "xxhash64(w, " + ", ".join(f"get(_words, i + {k})" for k in range(1, WINDOW)) + "), NULL))")
    step = step.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_exclaims": F.length(F.regexp_replace(body, r"[^!]+", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.expr(f"slice({hashes}, 1, greatest(0, size(_words) - {WINDOW - 1}))"),
    })
    repeats = f"CASE WHEN size(array_distinct(_hashes)) < size(_hashes) THEN {_covered('_words')} ELSE 0L END"
    return step.withColumn("n_repeat_words", F.expr(repeats)).drop("_words", "_lines", "_hashes")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """`measurements` plus `failed`: the bits of all rules the document fails."""
    bits: Column = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs, text).withColumn("failed", bits)


def rejected_by(policy: str) -> Column:
    """True for ledger rows that the policy rejects."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(policy)).cast("long")) != 0


def kept_documents(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs.

    The verdict passes through a generator: a filter straight on it would be pushed down and
    would evaluate every rule again for each place its measurements are used in.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.struct(*columns).alias("_row"), F.col(f"`{text}`").alias("text"))
    judged = ledger(own).select("_row", F.explode_outer(F.array(rejected_by(policy))).alias("_rejected"))
    return judged.where(~F.col("_rejected")).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail only it, and what is kept without it.

    The ledger is reduced to one row per combination of failed bits (at most 2^rules) before rules
    are looked at, so texts and measurements are never read again.
    """
    mask = mask_of(policy)
    combos = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    per_rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules]))
    wide = combos.select("bits", "n", per_rule.alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return wide.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        count(F.col("bits") == F.col("bit"))("n_failed_only"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("bit")))("n_kept_without"))


def quality_digest(docs: DataFrame) -> DataFrame:
    """The row per document of query op5: measurements, verdict of the base rules, verdict of the policy."""
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rejected_by("base").alias("base_failed"), (~rejected_by("v1")).alias("kept"), "failed")
