"""Binding quotes to source units, and diagnosing what does not bind."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.hashing import evidence_fingerprint, make_id, stable_hash, text_hash
from tracewell.functions.keyset import KeySet
from tracewell.functions.ranking import running_total
from tracewell.functions.text import SPACE, UNICODE, is_blank, let
from tracewell.operators.contains import EDGE, contains_pairs, first_texts, token_array
from tracewell.session import Staging, stored

RUN = ["deal_slug", "run_id"]
CLAIM = RUN + ["claim_id"]
CANDIDATE_LIMIT = 8  # part of the feature: a flag lists the first eight candidate units
STITCH_SLACK = 1000
_BUCKET = 4096
ACTION_PLAIN = "Choose the correct citation unit and exact quote, or reject the claim."
ACTION_OTHER = "Correct the citation unit to one where the supplied quote appears exactly, or reject the claim."
ACTION_STITCH = "Split the quote into exact per-unit evidence refs, each with its own citation_unit_id, or reject the claim."
FAILED = "evidence_ref_binding_failed"


def claim_refs(claims: DataFrame) -> DataFrame:
    """One row per evidence reference; a claim without any gives one row with a null index."""
    return claims.select(
        *CLAIM, "filing_id", "family", "claim_type", "claim_index", "claim_sequence",
        F.size("evidence_refs").alias("_refs"), F.posexplode_outer("evidence_refs").alias("ref_index", "_r"),
    ).select("*", F.col("_r.citation_unit_id").alias("citation_unit_id"), F.col("_r.quote_text").alias("quote_text")).drop("_r")


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def binding_error(unit_text: Column) -> Column:
    """Why a reference does not bind, else null."""
    index, unit, quote = F.col("ref_index"), F.col("citation_unit_id"), F.col("quote_text")
    at = F.concat(F.lit("QuoteBindingError: evidence_refs["), index, F.lit("]"))
    return (
        F.when(index.isNull(), "QuoteBindingError: claim has no evidence_refs")
        .when(unit.isNull() | (unit == ""), F.concat(at, F.lit(".citation_unit_id is missing")))
        .when(quote.isNull() | (quote == ""), F.concat(at, F.lit(".quote_text is missing")))
        .when(is_blank(quote), "MissingQuoteError: quote_text is blank")
        .when(unit_text.isNull(), F.concat(F.lit("UnknownCitationUnitError: unknown citation_unit_id "), _quoted(unit)))
        .when(~unit_text.contains(quote), F.concat(
            F.lit("MissingQuoteError: quote_text is not an exact substring of citation_unit_id "), _quoted(unit)))
    )


def span_columns(filing_id: Column, quote: Column, unit_text: Column) -> list[Column]:
    """The span of a bound quote: first occurrence in its unit."""
    start = F.col("char_start") + F.position(quote, unit_text) - 1
    return [start.alias("_start"), (start + F.length(quote)).alias("_end"), text_hash(quote).alias("quote_text_hash")]


def bind_refs(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Every reference with its span or its error.

    An equi-join on (deal, unit); the unit side is unique, so a much-cited unit only makes the
    reference side skewed, which adaptive execution splits. Adds per claim: n_bound, ordinal.
    """
    return with_evidence_ids(placed_refs(claims, units))


def placed_refs(claims: DataFrame, units: DataFrame) -> DataFrame:
    """`bind_refs` without the digests that follow from its other columns: what a stage needs to keep.

    `first_claim` is the first claim that cites the same place, null where that is the claim itself: a place is a quote in a
    unit, so it is read off the rows where the join left them. Only claims of several references are brought together again.
    """
    u = units.select(
        "deal_slug", F.col("unit_id").alias("citation_unit_id"), F.col("text").alias("_unit"), "sequence",
        "char_start", F.col("char_end").alias("_unit_end"), "page_number", F.lit(True).alias("_known"))
    rows = claim_refs(claims).join(u, ["deal_slug", "citation_unit_id"], "left")
    rows = rows.withColumn("error", binding_error(F.col("_unit")))
    ok = F.col("error").isNull()
    filing, quote = F.col("filing_id"), F.col("quote_text")
    start, end, _ = span_columns(filing, quote, F.col("_unit"))
    rows = rows.select("*", start, end)
    rows = rows.select(
        *CLAIM, "filing_id", "family", "claim_type", "claim_index", "claim_sequence", "_refs", "ref_index",
        "citation_unit_id", "quote_text", "error",
        F.when(ok, F.col("_start")).alias("span_start"), F.when(ok, F.col("_end")).alias("span_end"),
        F.when(ok, F.col("page_number")).alias("source_page"),
        # half the bytes of its digits
        F.when(ok, F.unhex(stable_hash(filing, F.col("citation_unit_id"), F.col("sequence"), F.col("char_start"), F.col("_unit_end"), F.col("_unit")))).alias("_paragraph"),
    )
    own = F.struct("claim_sequence", "claim_id")
    per_place = Window.partitionBy("deal_slug", "citation_unit_id", "run_id", "filing_id", "quote_text")
    rows = rows.withColumn("first_claim", F.min(F.when(F.col("error").isNull(), own)).over(per_place))
    rows = rows.withColumn("first_claim", F.when(F.col("error").isNull() & (F.col("first_claim") != own), F.col("first_claim")))
    # The window is one claim: its references came out of one payload row.
    per_claim = Window.partitionBy(*CLAIM)
    bound = F.when(F.col("error").isNull(), 1).otherwise(0)
    alone, several = rows.filter("_refs <= 1").drop("_refs"), rows.filter("_refs > 1").drop("_refs")
    alone = alone.select("*", bound.cast("long").alias("n_bound"), bound.cast("long").alias("ordinal"))
    return alone.unionByName(several.select(
        "*", F.sum(bound).over(per_claim).alias("n_bound"),
        F.sum(bound).over(per_claim.orderBy("ref_index").rowsBetween(Window.unboundedPreceding, 0)).alias("ordinal")))


def with_evidence_ids(rows: DataFrame) -> DataFrame:
    """Adds quote_text_hash and evidence_id to `placed_refs`, where they are read: random text compresses neither on its way nor in a stage."""
    quote = F.col("quote_text")
    evidence_id = make_id("ev", F.col("filing_id"), F.col("span_start"), F.col("span_end"), text_hash(quote))
    return rows.select(
        *CLAIM, "filing_id", "family", "claim_type", "claim_index", "claim_sequence", "ref_index", "citation_unit_id", "quote_text",
        text_hash(quote).alias("quote_text_hash"), "error", "span_start", "span_end", "source_page",
        F.when(F.col("error").isNull(), evidence_id).alias("evidence_id"),
        F.concat(F.lit("para_"), F.lower(F.hex("_paragraph"))).alias("paragraph_id"), "n_bound", "ordinal", "first_claim")


def spans(bound: DataFrame) -> DataFrame:
    """A1: one row per evidence id."""
    ok = bound.filter("error is null")
    return ok.select(
        *RUN, "evidence_id", "filing_id", "paragraph_id",
        F.lit("provider_evidence_ref").alias("span_basis"), F.lit("claim_quote").alias("span_kind"),
        F.lit(None).cast("string").alias("parent_evidence_id"), F.lit("evidence_ref_binding").alias("created_by_stage"),
        F.col("span_start").alias("char_start"), F.col("span_end").alias("char_end"), "quote_text", "quote_text_hash",
        evidence_fingerprint(F.col("filing_id"), F.col("span_start"), F.col("span_end"), F.col("quote_text_hash")).alias("evidence_fingerprint"),
        "source_page",
    ).dropDuplicates(RUN + ["evidence_id"])


def claim_evidence(bound: DataFrame) -> DataFrame:
    """Claim -> bound evidence, in reference order, with what a row shows of it."""
    return bound.filter("error is null").select(
        *CLAIM, "evidence_id", F.col("ordinal").cast("int").alias("ordinal"), "quote_text", "source_page", "first_claim")


def rejected_claims(bound: DataFrame) -> DataFrame:
    """G1's input: the claims none of whose references bound, with their first failure. One row per such claim."""
    failed = bound.filter("error is not null AND n_bound = 0")
    return failed.groupBy(*CLAIM).agg(F.min(F.struct(F.coalesce("ref_index", F.lit(-1)).alias("i"), "error"))["error"].alias("first_error"))


# ---- diagnosis -----------------------------------------------------------------------
def bind_anywhere(quotes: DataFrame, units: DataFrame, scope: list[str]) -> DataFrame:
    """Bind a quote that carries no address; exactly one occurrence in the scope binds.

    quotes(scope, quote_id, quote_text); units(scope, filing_id, unit columns). Repeated texts
    are compared once and counted by multiplicity, so boilerplate never becomes pairs.
    Returns every quote with status bound | missing | ambiguous and its occurrence count.
    """
    texts = units.select(*scope, "text", F.col("paragraph_hash").alias("text_hash"))
    hits = stored(contains_pairs(quotes, texts, scope), "pairs")
    units = KeySet(hits.select(*scope, F.col("text_hash").alias("paragraph_hash")), scope + ["paragraph_hash"]).kept(units)
    copies = units.groupBy(*scope, F.col("paragraph_hash").alias("text_hash")).agg(F.count(F.lit(1)).alias("copies"))
    counted = hits.join(copies, scope + ["text_hash"]).groupBy(*scope, "quote_text").agg(
        F.sum(F.col("overlapping") * F.col("copies")).alias("occurrences"), F.min("text_hash").alias("text_hash"))
    single = counted.filter("occurrences = 1").join(
        units.withColumnRenamed("paragraph_hash", "text_hash"), scope + ["text_hash"])
    quote = F.col("quote_text")
    single = single.select(*scope, "quote_text", *[c for c in single.columns if c not in scope + ["quote_text", "occurrences", "text_hash"]])
    single = single.select("*", *span_columns(F.col("filing_id"), quote, F.col("text")))
    single = single.select(
        *scope, "quote_text", "filing_id", "unit_id", "paragraph_id", "page_number",
        *([] if "deal_slug" in scope else ["deal_slug"]),
        F.col("_start").alias("span_start"), F.col("_end").alias("span_end"), "quote_text_hash",
        make_id("ev", F.col("filing_id"), F.col("_start"), F.col("_end"), F.col("quote_text_hash")).alias("evidence_id"),
        evidence_fingerprint(F.col("filing_id"), F.col("_start"), F.col("_end"), F.col("quote_text_hash")).alias("evidence_fingerprint"))
    status = (
        F.when(is_blank(quote), "blank").when(F.col("occurrences").isNull(), "missing")
        .when(F.col("occurrences") > 1, "ambiguous").otherwise("bound"))
    out = quotes.join(counted.drop("text_hash"), scope + ["quote_text"], "left").join(single, scope + ["quote_text"], "left")
    return out.withColumn("status", status).withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))


def candidate_units(quotes: DataFrame, units: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """For each distinct (deal, quote) the first `limit` units that hold it, in filing order.

    The limit is the feature. Texts are looked into in filing order until a quote has enough, and the
    order is cut text by text first, so that no more than `limit` copies of one text ever reach the final
    ordering of a quote. A quote of white space alone has candidates like any other; an empty one has none.
    """
    scope = ["deal_slug"]
    key = F.unhex("paragraph_hash").alias("text_hash")  # half the bytes of its digits
    texts = units.select("deal_slug", "text", key)
    order = units.select("deal_slug", key, F.col("sequence").alias("at"))
    hits, _ = first_texts(quotes, texts, scope, order, limit)
    per_text = Window.partitionBy("deal_slug", "text_hash").orderBy("sequence")
    places = units.select("deal_slug", key, "sequence", "unit_id", "page_number", "paragraph_index")
    places = KeySet(hits, ["deal_slug", "text_hash"]).kept(places).join(hits.select("deal_slug", "text_hash").distinct(), ["deal_slug", "text_hash"], "left_semi")
    places = places.withColumn("_n", F.row_number().over(per_text)).filter(F.col("_n") <= limit).drop("_n")
    per_quote = Window.partitionBy("deal_slug", "quote_text").orderBy("sequence")
    return (
        hits.join(places, ["deal_slug", "text_hash"])
        .withColumn("rank", F.row_number().over(per_quote)).filter(F.col("rank") <= limit)
        .select("deal_slug", "quote_text", "rank", F.col("unit_id").alias("citation_unit_id"), "page_number",
                "paragraph_index", F.col("plain").alias("match_count")))


def stitched_units(refs: DataFrame, units: DataFrame, slack: int = STITCH_SLACK) -> DataFrame:
    """The adjacent units that together hold a quote none of them holds alone.

    refs(deal_slug, citation_unit_id, quote_text). The cited unit must be part of the run of
    units, and a run stops growing at len(quote)+slack characters, so only units within that
    distance of the cited one matter: an equi-join on position buckets finds them.
    A reference without an address is looked up by its seams instead; a quote that one unit holds alone
    binds there and is not searched for.
    Returns (deal_slug, citation_unit_id, quote_text, stitched array<string>).
    """
    key = ["deal_slug", "citation_unit_id", "quote_text"]
    refs = stored(refs.select(*key).filter(F.col("quote_text") != "").distinct(), "refs")
    units = KeySet(refs, ["deal_slug"]).kept(units)
    placed = stored(_stitch_positions(units), "places")
    anchors = placed.select("deal_slug", F.col("unit_id").alias("anchor"), F.col("at").alias("p"), F.col("size").alias("psize"))
    # A unit is listed in every bucket it touches, so that long units are found from either side.
    listed = placed.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("at") / _BUCKET), F.floor((F.col("at") + F.col("size")) / _BUCKET))))

    def search(anchored: DataFrame, by: list[str], cited: Column) -> DataFrame:
        reach = F.length("quote_text") + slack + 4
        wide = anchored.withColumn("lo", F.col("p") - reach).withColumn("hi", F.col("p") + F.col("psize") + reach)
        wide = wide.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / _BUCKET), F.floor(F.col("hi") / _BUCKET))))
        wide = stored(wide.drop("p", "psize", "sequence"), "anchored")
        # Places are numbers; texts come in only where a reference may look at them.
        near = stored(KeySet(wide, ["deal_slug", "bucket"]).kept(listed), "listed")
        texts = KeySet(near, ["deal_slug", "unit_id"]).kept(units.select("deal_slug", "unit_id", "text"))
        near = wide.join(near.join(texts, ["deal_slug", "unit_id"]), ["deal_slug", "bucket"]).filter(
            (F.col("at") <= F.col("hi")) & (F.col("at") + F.col("size") >= F.col("lo")))
        run = near.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("at", "unit_id", "text"))).alias("u"))
        return _stitch(run, cited, slack).filter("stitched is not null")

    cited = anchors.withColumnRenamed("anchor", "citation_unit_id")
    exact = refs.join(KeySet(refs, ["deal_slug", "citation_unit_id"]).kept(cited), ["deal_slug", "citation_unit_id"])
    found = search(exact, key, F.col("citation_unit_id")).select(*key, "stitched")
    # A reference without any address may be stitched anywhere: at the seams its tokens can lie across.
    loose = refs.filter("citation_unit_id is null").select("deal_slug", "quote_text").distinct()
    if loose.isEmpty():
        return found
    hits = stored(_seam_hits(loose, units), "seams")
    loose = hits.join(KeySet(hits, ["deal_slug", "anchor"]).kept(anchors), ["deal_slug", "anchor"])
    any_run = search(loose, ["deal_slug", "quote_text", "anchor"], F.lit(None).cast("string"))
    any_run = any_run.groupBy("deal_slug", "quote_text").agg(F.min(F.struct("at", "stitched"))["stitched"].alias("stitched"))
    return found.unionByName(any_run.select("deal_slug", F.lit(None).cast("string").alias("citation_unit_id"), "quote_text", "stitched"))


def _seam_keys(left: Column, right: Column, inner_left: bool, inner_right: bool, a: Column | int, b: Column | int) -> Column:
    """Key of a seam: the tokens next to it, whole where the quote goes on beyond them, else their nearest a and b characters."""
    x = left if inner_left else F.right(left, F.lit(a) if isinstance(a, int) else a)
    y = right if inner_right else F.left(right, F.lit(b) if isinstance(b, int) else b)
    size = lambda inner, n: F.lit(-1) if inner else (F.lit(n) if isinstance(n, int) else n)
    return F.xxhash64(size(inner_left, a), x, size(inner_right, b), y)


def _seam_hits(quotes: DataFrame, units: DataFrame) -> DataFrame:
    """(deal_slug, quote_text, anchor): units before a seam that the quote may lie across.

    Units end and begin with whole tokens, so a quote across a seam has two neighbouring tokens on its
    two sides: the last of the unit before and the first of the unit behind, of which the first and last
    token of the quote show only a part. The index lists each seam under the pair of its tokens and
    under the pairs with up to EDGE characters of one or both; a quote asks for all its neighbours.
    """
    seams = units.select("deal_slug", F.col("unit_id").alias("anchor"), "sequence", F.element_at(token_array(F.col("text")), -1).alias("x")).join(
        units.select("deal_slug", (F.col("sequence") - 1).alias("sequence"), F.get(token_array(F.col("text")), F.lit(0)).alias("y")), ["deal_slug", "sequence"])
    x, y, sizes = F.col("x"), F.col("y"), range(EDGE + 1)
    listed = [_seam_keys(x, y, True, True, 0, 0)]
    listed += [F.when(F.length(x) >= a, _seam_keys(x, y, False, True, a, 0)) for a in sizes]
    listed += [F.when(F.length(y) >= b, _seam_keys(x, y, True, False, 0, b)) for b in sizes]
    listed += [F.when((F.length(x) >= a) & (F.length(y) >= b), _seam_keys(x, y, False, False, a, b)) for a in sizes for b in sizes]
    index = seams.select("deal_slug", "anchor", F.explode(F.array_compact(F.array(*listed))).alias("key"))

    def asked(t: Column) -> Column:
        last = F.size(t) - 2
        shown = lambda token: F.least(F.lit(EDGE), F.length(token))

        def key(i: Column) -> Column:
            left, right = F.get(t, i), F.get(t, i + 1)
            a, b = shown(left), shown(right)
            return (
                F.when((i > 0) & (i < last), _seam_keys(left, right, True, True, 0, 0))
                .when(i > 0, _seam_keys(left, right, True, False, 0, b))
                .when(i < last, _seam_keys(left, right, False, True, a, 0))
                .otherwise(_seam_keys(left, right, False, False, a, b)))
        return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), key)))

    keys = stored(quotes.select("deal_slug", "quote_text", F.explode(let(token_array(F.col("quote_text")), asked)).alias("key")), "asked")
    return KeySet(keys, ["deal_slug", "key"]).kept(index).join(keys, ["deal_slug", "key"]).select("deal_slug", "quote_text", "anchor").distinct()


def _stitch_positions(units: DataFrame) -> DataFrame:
    """Start and size of each unit in the text of its deal's units joined by blank lines."""
    rows = units.select("deal_slug", "unit_id", "sequence", F.length("text").alias("size"))
    return running_total(rows.withColumn("_w", F.col("size") + 2), ["deal_slug"], "sequence", {"_w": "at"})


def _stitch(rows: DataFrame, cited: Column, slack: int) -> DataFrame:
    """The first run of the units `u` (neighbours, in order) that holds the quote, names the cited unit and did not outgrow its limit before.

    Runs are pieces of the one text of all units joined by blank lines; a run is looked into by places, never built up.
    """
    quote = F.col("quote_text")
    limit = F.length(quote) + slack

    def from_start(u: Column, text: Column, cites: Column, s: Column) -> Column:
        first, origin = F.get(u, s), F.get(u, F.lit(0))["at"]

        def look(found: Column, end: Column) -> Column:
            # the units before `end` are joined already, `end` is the one that comes on
            size = F.get(u, end)["at"] - 2 - first["at"]
            named = cited.isNull() | F.exists(cites, lambda c: (c >= s) & (c <= end))
            open_ = (end == s + 1) | (size <= limit)
            before = F.substring(text, (first["at"] - origin + 1).cast("int"), size.cast("int"))
            holds = let(F.struct(before.alias("b"), F.get(u, end)["text"].alias("t")), lambda x: (
                F.concat(x["b"], F.lit("\n\n"), x["t"]).contains(quote) | F.concat(x["b"], F.lit("\n"), x["t"]).contains(quote)
                | F.concat(x["b"], F.lit(" "), x["t"]).contains(quote)))
            return F.when(found.isNotNull(), found).when(named & open_ & holds, end)

        ends = F.when(s + 1 < F.size(u), F.sequence(s + 1, F.size(u) - 1)).otherwise(F.array().cast("array<int>"))
        last = F.aggregate(ends, F.lit(None).cast("int"), look)
        return let(last, lambda e: F.when(e.isNotNull(), F.struct(
            first["at"].cast("bigint").alias("at"), F.transform(F.slice(u, s + 1, e - s + 1), lambda x: x["unit_id"]).alias("ids"))))

    def search(u: Column, text: Column, cites: Column) -> Column:
        none = F.lit(None).cast("struct<at:bigint,ids:array<string>>")
        # No run that starts behind the cited unit names it.
        stop = F.when(cited.isNull(), F.size(u) - 1).otherwise(F.coalesce(F.array_max(cites), F.lit(-1)))
        starts = F.when(stop >= 0, F.sequence(F.lit(0), stop)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(starts, none, lambda acc, s: F.when(acc.isNotNull(), acc).otherwise(from_start(u, text, cites, s)))

    # Whatever the separators, the quote without white space must occur in the texts without it.
    bare = lambda text: F.regexp_replace(text, f"{UNICODE}{SPACE}+", "")
    places = lambda u: F.filter(F.transform(u, lambda x, i: F.when(x["unit_id"] == cited, i)), lambda i: i.isNotNull())
    hit = let(F.col("u"), lambda u: let(F.array_join(F.transform(u, lambda x: x["text"]), "\n\n"), lambda text: F.when(
        bare(text).contains(bare(quote)), let(places(u), lambda cites: search(u, text, cites)))))
    # outer: keeps the optimizer from searching once more as a filter
    out = rows.select(*rows.columns, F.explode_outer(F.array(hit)).alias("_hit")).filter("_hit is not null")
    return out.withColumn("stitched", F.col("_hit.ids")).withColumn("at", F.col("_hit.at")).drop("u", "_hit")


# ---- flags ---------------------------------------------------------------------------
def claim_summary_struct() -> Column:
    """the identifying fields of a claim, by type, as JSON."""
    def pick(*names: str) -> Column:
        return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})

    kind = F.col("claim_type")
    return (
        F.when(kind == "actor", pick("actor_label", "actor_kind", "observability"))
        .when(kind == "actor_relation", pick("subject_label", "relation_type", "object_label", "effective_date_first"))
        .when(kind == "event", pick("event_type", "event_subtype", "event_date", "actor_label"))
        .when(kind == "bid", pick("bidder_label", "bid_date", "bid_value", "bid_value_lower", "bid_value_upper", "bid_value_unit"))
        .otherwise(pick("process_stage", "actor_class", "count_min", "count_max", "count_qualifier"))
    )


def binding_flags(claims: DataFrame, bound: DataFrame, units: DataFrame, staging: Staging | None = None) -> DataFrame:
    """One review flag per failed reference, with its diagnosis as metadata."""
    keep = (staging or Staging()).keep
    failed = bound.filter("error is not null")
    quotes = failed.filter(F.col("quote_text") != "").select("deal_slug", "quote_text").distinct()
    candidates = candidate_units(quotes, units)
    unit = F.struct("rank", "citation_unit_id", "page_number", "paragraph_index", "match_count")
    listed = candidates.groupBy("deal_slug", "quote_text").agg(F.array_sort(F.collect_list(unit)).alias("candidate_units"))
    rows = failed.join(listed, ["deal_slug", "quote_text"], "left")
    cited = F.col("citation_unit_id")
    elsewhere = F.coalesce(F.exists("candidate_units", lambda c: cited.isNull() | (c["citation_unit_id"] != cited)), F.lit(False))
    rows = keep("failed_refs", rows.withColumn("_elsewhere", elsewhere))
    stitched = stitched_units(rows.filter(~F.col("_elsewhere")), units)
    # Null-safe on the address: a reference may have none.
    rows = rows.withColumn("_cu", F.coalesce("citation_unit_id", F.lit("\0")))
    stitched = stitched.withColumn("_cu", F.coalesce("citation_unit_id", F.lit("\0"))).drop("citation_unit_id")
    rows = rows.join(stitched, ["deal_slug", "_cu", "quote_text"], "left")
    is_stitched = ~F.col("_elsewhere") & F.col("stitched").isNotNull()
    summary = KeySet(failed, CLAIM).kept(claims).select(*CLAIM, "evidence_refs", claim_summary_struct().alias("claim_summary"))
    rows = rows.join(summary, CLAIM)
    flag_id = make_id("flag", F.col("deal_slug"), F.col("run_id"), F.col("claim_id"), F.lit(FAILED), F.col("ref_index"))
    metadata = F.struct(
        flag_id.alias("flag_id"), F.col("deal_slug").alias("slug"), "run_id", F.col("family").alias("claim_family"), "claim_type",
        "claim_index", "claim_id", "claim_summary", F.col("ref_index").alias("evidence_ref_index"),
        cited.alias("provided_citation_unit_id"), F.col("quote_text").alias("provided_quote_text"),
        F.col("evidence_refs").alias("supplied_evidence_refs"), F.lit(FAILED).alias("reason_code"), F.col("error").alias("reason"),
        F.coalesce(F.transform("candidate_units", lambda c: F.struct(
            c["citation_unit_id"].alias("citation_unit_id"), c["page_number"].alias("page_number"),
            c["paragraph_index"].alias("paragraph_index"), c["match_count"].alias("match_count"))),
            F.array().cast("array<struct<citation_unit_id:string,page_number:int,paragraph_index:int,match_count:int>>")).alias("candidate_units"),
        F.when(F.col("_elsewhere"), ACTION_OTHER).when(is_stitched, ACTION_STITCH).otherwise(ACTION_PLAIN).alias("suggested_action"),
        F.when(F.col("_elsewhere"), "quote_matches_different_citation_unit").when(is_stitched, "cross_unit_quote_stitching").alias("diagnostic_subcode"),
        F.when(is_stitched, F.col("stitched")).alias("stitched_citation_unit_ids"),
    )
    return rows.select(
        *RUN, flag_id.alias("flag_id"), F.lit(None).cast("string").alias("deal_id"),
        F.when(F.col("n_bound") == 0, "blocking").otherwise("soft").alias("severity"), F.lit(FAILED).alias("code"),
        F.col("error").alias("reason"), F.lit("claims").alias("row_table"), F.col("claim_id").alias("row_id"),
        F.lit("open").alias("status"), F.lit(True).alias("current"),
        F.struct("claim_sequence", F.coalesce("ref_index", F.lit(-1)).alias("ref_index")).alias("flag_order"),
        metadata.alias("metadata"))
