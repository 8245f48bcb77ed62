"""Locating and slicing the narrative section of each filing."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.text import let, sums_before

_SENTINEL = "\u0001"  # neither white space nor a letter: keeps `^` from matching at a cut

# The heading that ends the narrative section (fixed value).
_END = (
    r"(?:^|[\r\n]|\s{2,})(?:\*{1,3}\s*(?:COMMAND=STYLE_ADDED,[^\r\n]*?\s+)?(?:Reasons\s+for\s+the\s+(?:Merger|Offer)"
    r"|Recommendation\s+(?:of|and)|Reasons\s+and\s+Recommendation|Opinion\s+of|Purpose\s+of\s+the\s+Offer"
    r"|The\s+Merger\s+Agreement|Certain\s+Effects\s+of|Interests\s+of|Financing|Projected\s+Financial\s+Information"
    r"|[A-Za-z]+(?:'|’)?s\s+Reasons\s+for\s+the\s+Merger)|\d{1,2}\.\s*(?:The\s+Merger\s+Agreement"
    r"|Purpose\s+of\s+the\s+Offer|Certain\s+Effects\s+of|Reasons\s+for\s+the\s+(?:Merger|Offer))"
    r"|(?:Reasons\s+for\s+the\s+(?:Merger|Offer)|Recommendation\s+(?:of|and)|Reasons\s+and\s+Recommendation|Opinion\s+of"
    r"|Purpose\s+of\s+the\s+Offer|Certain\s+Effects\s+of|Interests\s+of|Financing|Projected\s+Financial\s+Information"
    r"|[A-Za-z]+(?:'|’)?s\s+Reasons\s+for\s+the\s+Merger))\b"
)


@dataclass(frozen=True)
class SectionSpec:
    """What opens and closes the section. The defaults are fixed values of the filing format."""
    start: str = r"\bBackground\s+of\s+the\s+(?:Merger|Offer|Transaction)\b"
    cross_reference: str = r"\b(?:see|under|entitled|beginning on page|described above|described below)\b"
    narrative: str = (
        r"following\s+chronology|chronology\s+summarizes|regularly\s+reviewed|frequently\s+reviews|"
        r"ongoing\s+evaluation|strategic\s+options|strategic\s+opportunit(?:y|ies)|strategic\s+alternatives|"
        r"last\s+few\s+years|material\s+key\s+events"
    )
    end: str = _END
    deep_page: int = 15
    min_score: int = 5
    max_pages: int = 35
    min_chars: int = 1500


def _search(pattern: str) -> str:
    return "(?isU)" + pattern


def match_array(text: Column, pattern: str) -> Column:
    """All non-overlapping matches as array<struct<start, stop>> (0-based, in code points)."""
    tiling = F.lit(rf"(?isU)\G(.*?)({pattern})")
    gaps, heads = F.regexp_extract_all(text, tiling, F.lit(1)), F.regexp_extract_all(text, tiling, F.lit(2))
    pairs = F.zip_with(gaps, heads, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))

    def place(p: Column) -> Column:
        def spans(before: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                start = (F.get(before, i) + x["g"]).cast("int")
                return F.struct(start.alias("start"), (start + x["h"]).alias("stop"))
            return F.transform(p, one)
        return let(sums_before(F.transform(p, lambda x: x["g"] + x["h"])), spans)

    return let(pairs, place)


def window_text(text: Column, start: Column, stop: Column) -> Column:
    """text[start:stop] with 0-based bounds; start must not be negative."""
    return F.substring(text, start + 1, F.greatest(stop - start, F.lit(0)))


def _pipes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))


def start_candidates(pages: DataFrame, spec: SectionSpec = SectionSpec()) -> DataFrame:
    """Every start heading of every page with its score."""
    content = F.coalesce("content", F.lit(""))
    zero = F.lit(0)
    rows = pages.filter(content.rlike(_search(spec.start))).select(
        "deal_slug", "page_pos", "number", "content", F.explode(match_array(content, spec.start)).alias("m"))
    start, stop = F.col("m.start"), F.col("m.stop")
    before = window_text(F.col("content"), F.greatest(start - 120, zero), start)
    after = window_text(F.col("content"), stop, stop + 700)
    around = window_text(F.col("content"), F.greatest(start - 180, zero), stop + 220)
    rows = rows.select("deal_slug", "page_pos", "number", start.alias("start"), before.alias("before"), after.alias("after"), around.alias("around"))
    marked = F.right("before", F.lit(24)).contains("**") | F.substring("after", 1, 24).contains("**")
    points = lambda condition, value: F.when(condition, value).otherwise(0)
    score = (
        points(F.col("number") >= spec.deep_page, 6) + points(marked, 3)
        + points(F.col("after").rlike(_search(spec.narrative)), 3)
        + points(F.right("before", F.lit(100)).rlike(_search(spec.cross_reference)) & ~marked, -8)
        + points((_pipes(F.col("around")) >= 4) & ~marked, -8)
    )
    return rows.select("deal_slug", "page_pos", "number", "start", score.alias("score"))


def _end_hits(content: Column, search_start: Column, spec: SectionSpec) -> Column:
    """Start of the first accepted end heading at or after `search_start`, else null."""
    text = F.when(search_start > 0, F.concat(F.lit(_SENTINEL), F.substring(content, search_start + 1, 2**31 - 1))).otherwise(content)
    shift = F.when(search_start > 0, search_start - 1).otherwise(0)

    def accepted(m: Column) -> Column:
        start, stop = m["start"] + shift, m["stop"] + shift
        before = window_text(content, F.greatest(search_start, start - 120), start)
        around = window_text(content, F.greatest(search_start, start - 200), stop + 200)
        return ~before.rlike(_search(spec.cross_reference)) & (_pipes(around) < 4)

    hits = F.filter(match_array(text, spec.end), accepted)
    return F.get(hits, 0)["start"] + shift


def section_bounds(pages: DataFrame, spec: SectionSpec = SectionSpec()) -> DataFrame:
    """One row per deal: the bounds, or the reason there are none.

    Only minima per deal are aggregated. Page text meets a start by ranges of `max_pages` pages, of which a
    section touches two, so a deal of very many pages is not one key.
    """
    candidates = start_candidates(pages, spec)
    best = candidates.groupBy("deal_slug").agg(
        F.min(F.struct((-F.col("score")).alias("loss"), "number", "start", "page_pos")).alias("b"))
    best = best.select(
        "deal_slug", (-F.col("b.loss")).alias("score"), F.col("b.page_pos").alias("start_pos"),
        F.col("b.number").alias("start_page"), F.col("b.start").alias("start_index"))
    good = best.filter(F.col("score") >= spec.min_score)
    rank = lambda place: F.floor(place / F.lit(spec.max_pages))
    reach = good.withColumn("_range", F.explode(F.array(rank(F.col("start_pos")), rank(F.col("start_pos")) + 1)))
    near = pages.withColumn("_range", rank(F.col("page_pos"))).join(reach, ["deal_slug", "_range"]).filter(
        (F.col("page_pos") >= F.col("start_pos")) & (F.col("page_pos") < F.col("start_pos") + spec.max_pages))
    search = F.when(F.col("page_pos") == F.col("start_pos"), F.col("start_index") + 1).otherwise(0)
    near = near.select(
        "deal_slug", "page_pos", "number", _end_hits(F.coalesce("content", F.lit("")), search, spec).alias("hit"))
    ends = near.filter("hit is not null").groupBy("deal_slug").agg(F.min(F.struct("page_pos", "hit", "number")).alias("e"))
    deals = pages.select("deal_slug").distinct()
    joined = deals.join(best, "deal_slug", "left").join(ends, "deal_slug", "left")
    reason = (
        F.when(F.col("score").isNull(), "Background section heading not found in filing pages")
        .when(F.col("score") < spec.min_score, "Background section heading candidates were only table-of-contents/cross-reference hits")
        .when(F.col("e").isNull(), F.concat(
            F.lit(f"Background section end heading not found within {spec.max_pages} pages of start page "), F.col("start_page")))
    )
    return joined.select(
        "deal_slug", reason.alias("reason"), "score", "start_pos", "start_page", "start_index",
        F.col("e.page_pos").alias("end_pos"), F.col("e.number").alias("end_page"), F.col("e.hit").alias("end_index"))


def slice_section(pages: DataFrame, bounds: DataFrame) -> DataFrame:
    """The pages of the section, cut at its bounds. Other page columns are kept."""
    keep = [c for c in pages.columns if c != "content"]
    b = bounds.filter("reason is null").select("deal_slug", "start_pos", "start_index", "end_pos", "end_index")
    rows = pages.join(b, "deal_slug").filter(F.col("page_pos").between(F.col("start_pos"), F.col("end_pos")))
    content = F.coalesce("content", F.lit(""))
    start = F.when(F.col("page_pos") == F.col("start_pos"), F.col("start_index")).otherwise(0)
    stop = F.when(F.col("page_pos") == F.col("end_pos"), F.col("end_index")).otherwise(F.length(content))
    return rows.select(*keep, window_text(content, start, stop).alias("content"))


def short_sections(section_pages: DataFrame, spec: SectionSpec = SectionSpec()) -> DataFrame:
    """T9's minimum-length check: deals whose section holds too little text."""
    total = section_pages.groupBy("deal_slug").agg(
        F.sum(F.length("content")).alias("chars"), F.min("number").alias("a"), F.max("number").alias("b"))
    return total.filter(F.col("chars") < spec.min_chars).select(
        "deal_slug",
        F.concat(
            F.lit("Background section extraction produced too little filing text: "), F.col("chars"),
            F.lit(" chars from pages "), F.col("a"), F.lit(".."), F.col("b")).alias("reason"))


def extractor_documents(manifests: DataFrame, bounds: DataFrame, section_pages: DataFrame, units: DataFrame) -> DataFrame:
    """One JSON input document per deal (a section is at most `max_pages` pages)."""
    pages = section_pages.groupBy("deal_slug").agg(
        F.array_sort(F.collect_list(F.struct("page_pos", "number", "content"))).alias("p"))
    unit_rows = units.groupBy("deal_slug").agg(F.array_sort(F.collect_list(
        F.struct("page_pos", "paragraph_index", "page_number", "text", "unit_id"))).alias("u"))
    joined = bounds.filter("reason is null").join(pages, "deal_slug").join(unit_rows, "deal_slug").join(
        manifests, "deal_slug")
    return joined.select(
        "deal_slug",
        F.to_json(F.struct(
            F.transform("u", lambda u: F.struct(u["page_number"].alias("page_number"), u["paragraph_index"].alias("paragraph_index"),
                                                u["text"].alias("text"), u["unit_id"].alias("unit_id"))).alias("citation_units"),
            F.col("manifest"),
            F.transform("p", lambda p: F.struct(p["content"].alias("content"), p["number"].alias("number"))).alias("pages"),
            F.struct(F.col("end_page"), F.lit("Background").alias("name"), F.lit("verbatim slices from the source filing pages").alias("source"),
                     F.col("start_page")).alias("section"),
            F.col("deal_slug").alias("slug"),
        ), {"ignoreNullFields": "false"}).alias("document"))
