"""Personal data by bootstrapped contextual extraction.

Four fixed patterns (email, ip, card, phone) give the base spans and the seeds. The words around a
seed are lexical patterns: the two words before it, and the word before with the word after it.
Patterns and the instances they surround (seeds, and other words with a digit or an @) form a graph
whose edges are distinct pairs over the whole corpus. Spark scores it in rounds: a pattern of a kind
is worth the mean score of all its instances, an instance the noisy-or of its patterns, seeds
staying at one. Words that reach `accept` through patterns with enough distinct seeds are spans too.

Only DataFrame and SQL functions are used. Texts are read in one pass; what is shuffled are spans,
candidates and graph edges. Groups are reduced by sums map-side. Positions are code points: matches
and the gaps between them are two splits of the same text, whose lengths add up.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewell.llm.common import stage_table
from tracewell.session import cut_lineage

#: Kinds in the order of the result, and last the candidates: any word with a digit or an @.
KINDS = ("email", "ip", "card", "phone")
#: Matching is linear: quantifiers are possessive where what follows cannot begin inside, and a match
#: begins where the text does not continue one that has failed (after a match, \G lets it begin).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "word": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
}
#: A text that lacks this cannot match; most texts are settled by it.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{12}", "phone": r"\+[0-9]", "word": "[0-9@]"}
#: Characters on either side of a match that are looked at for context words.
CONTEXT = 64
ROUNDS = 3
ACCEPT = 0.8
LEAST_SEEDS = 3
#: Most weight one pattern can give.
TRUST = 0.95


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, version, kind, start, end, value, before, after): every raw match of every pattern.

    version is the hash of the text, so rows with equal ids and different texts stay apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("version"), text.alias("text"))
    found = []
    for kind, pattern in PATTERNS.items():
        quoted = _quoted(pattern)
        gaps = f"split(text, '{quoted}', -1)"
        item = "struct(length(g) as gap, get(m, i) as value, right(g, {0}) as before, left(get(gs, i + 1), {0}) as after)".format(CONTEXT)
        both = f"""aggregate(array({gaps}), cast(array() as array<struct<gap:int,value:string,before:string,after:string>>),
            (none, gs) -> aggregate(array(regexp_extract_all(text, '{quoted}', 0)), none, (none2, m) -> transform(slice(gs, 1, size(m)), (g, i) -> {item})))"""
        found.append(F.expr(f"CASE WHEN text rlike '{_quoted(NEEDS[kind])}' THEN {both} END").alias(kind))
    wide = base.select("doc_id", "version", *found)
    kinds = ", ".join(f"struct('{k}' as kind, {k} as found)" for k in PATTERNS)
    rows = wide.where(" OR ".join(f"size({k}) > 0" for k in PATTERNS)).selectExpr("doc_id", "version", f"explode(array({kinds})) as k")
    rows = rows.where("size(k.found) > 0").selectExpr("doc_id", "version", "k.kind as kind", "posexplode(k.found) as (n, x)").distinct()
    upto = Window.partitionBy("doc_id", "version", "kind").orderBy("n")
    end = F.sum(F.col("x.gap") + F.length("x.value")).over(upto)
    return rows.select(
        "doc_id", "version", "kind", (end - F.length("x.value")).alias("start"), end.alias("end"), F.col("x.value").alias("value"),
        F.col("x.before").alias("before"), F.col("x.after").alias("after"))


def valid() -> F.Column:
    """Whether a raw match is what its pattern stands for: octets, Luhn sum, number of digits."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    luhn = F.expr("""aggregate(sequence(1, length(value)), struct(0 as sum, 0 as odd), (s, i) -> CASE
        WHEN substring(value, length(value) - i + 1, 1) rlike '[0-9]' THEN struct(
          s.sum + CASE WHEN s.odd = 1 THEN (2 * int(substring(value, length(value) - i + 1, 1))) % 10 + int(2 * int(substring(value, length(value) - i + 1, 1)) >= 10)
                  ELSE int(substring(value, length(value) - i + 1, 1)) END as sum, 1 - s.odd as odd)
        ELSE s END, s -> s.sum % 10 = 0)""")
    octet = "(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]))"
    return (F.when(F.col("kind") == "email", True)
            .when(F.col("kind") == "ip", F.col("value").rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(F.col("kind") == "card", F.when(F.length(digits).between(14, 19), luhn).otherwise(False))
            .when(F.col("kind") == "phone", F.length(digits).between(10, 15))
            .otherwise(True))


def _occurrences(found: DataFrame) -> DataFrame:
    """Base spans and the words that touch none of them."""
    here = Window.partitionBy("doc_id", "version")
    ahead = here.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = here.orderBy(F.col("start").desc(), F.col("end").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.col("kind") != "word"
    # A word touches a base span if one that starts before it ends inside it, or the next one starts inside it.
    marked = found.withColumns({"_last": F.max(F.when(base, F.col("end"))).over(ahead), "_next": F.min(F.when(base, F.col("start"))).over(behind)})
    free = (F.coalesce(F.col("_last"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("_next") >= F.col("end"), F.lit(True)))
    return marked.where(base | free).drop("_last", "_next")


def edges(occurrences: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, kind) edges; kind is null for words. Instances are lower-cased values."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    before, after = words(F.col("before")), words(F.col("after"))
    last, previous, first = F.element_at(before, -1), F.when(F.size(before) > 1, F.element_at(before, -2)), F.get(after, F.lit(0))
    pair = F.array(
        F.concat_ws(" ", F.lit("before:"), previous, last), F.when(first.isNotNull(), F.concat_ws(" ", F.lit("around:"), last, F.lit("_"), first)))
    return occurrences.withColumn("_p", F.when(F.size(before) > 1, pair)).select(
        F.explode("_p").alias("pattern"), F.lower("value").alias("instance"),
        F.when(F.col("kind") != "word", F.col("kind")).alias("kind")).where("pattern is not null").distinct()


def scored_instances(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, score) of words after some rounds over the graph; seeds are not repeated."""
    graph = stage_table(graph, "graph")
    size = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = graph.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    # Patterns with too few seeds can never extract: they leave before the rounds.
    useful = stage_table(seeds.where(F.col("seeds") >= LEAST_SEEDS).join(size, "pattern"), "patterns")
    open_ = stage_table(graph.where("kind is null").select("pattern", "instance").join(useful, "pattern"), "open")
    scores = None
    for _ in range(rounds):
        gained = useful.select("pattern", "kind", F.col("seeds").cast("double").alias("sum"))
        if scores is not None:
            gained = gained.union(open_.join(scores, ["instance", "kind"]).select("pattern", "kind", "score")).groupBy("pattern", "kind").agg(F.sum("sum").alias("sum"))
        worth = gained.join(useful.select("pattern", "kind", "n"), ["pattern", "kind"]).select("pattern", "kind", (F.col("sum") / F.col("n")).alias("worth"))
        doubt = F.sum(F.log(1 - TRUST * F.least(F.col("worth"), F.lit(1.0))))
        scores = cut_lineage(open_.select("pattern", "kind", "instance").join(worth, ["pattern", "kind"]).groupBy("instance", "kind").agg(
            (1 - F.exp(doubt)).alias("score")))
    return scores


def extracted(docs: DataFrame) -> DataFrame:
    """(doc_id, version, kind, start, end, base): base spans, and the spans that patterns found."""
    found = matches(docs.select("doc_id", "text"))
    spans = stage_table(_occurrences(found.where(valid())), "spans")
    scores = scored_instances(edges(spans)).where(F.col("score") >= ACCEPT)
    best = scores.groupBy("instance").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
    words = spans.where("kind = 'word'").drop("kind").withColumn("instance", F.lower("value")).join(best, "instance")
    columns = ["doc_id", "version", "kind", "start", "end"]
    return spans.where("kind <> 'word'").select(*columns, F.lit(True).alias("base")).union(words.select(*columns, F.lit(False).alias("base")))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Query op3: counts and digest of the base spans, and all spans, per row of docs (doc_id, text).

    Null and empty texts have no spans: zeros, the digest of the empty string and an empty string.
    Null ids are documents like others; repeated rows get equal results.
    """
    order = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(KINDS)) + " END")
    item = F.struct("start", order.alias("order"), "end", "kind")
    joined = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    per_doc = extracted(docs).groupBy("doc_id", "version").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), True)).alias(f"n_{k}") for k in KINDS],
        joined(F.collect_list(F.when(F.col("base"), item))).alias("_base"), joined(F.collect_list(item)).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("version"))
    spans = per_doc.withColumnRenamed("doc_id", "_id").withColumnRenamed("version", "_version")
    both = rows.join(spans, (F.col("version") == F.col("_version")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    empty = F.lit("")
    return both.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("_base", empty), 256).alias("base_sha256"), F.coalesce("spans", empty).alias("spans"))
