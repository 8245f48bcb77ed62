"""Grounding of quotes in page text."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.functions.text import split_cell
from tracewell.operators.units import page_of_unit

PAGE = ["deal_slug", "page_number"]


def grounded(quotes: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """quotes(deal_slug, key..., page_number, quote) with `grounded`: is the quote on that page?

    Equal quotes of a page are tested once; the verdicts are joined back.
    """
    distinct = quotes.select(*PAGE, "quote").distinct()
    text = pages.select("deal_slug", F.col("number").alias("page_number"), "content")
    verdicts = distinct.join(text, PAGE, "left").groupBy(*PAGE, "quote").agg(
        F.coalesce(F.bool_or(F.col("content").contains(F.col("quote")) & (F.col("quote") != "")), F.lit(False)).alias("grounded"))
    keyed = quotes.join(verdicts, PAGE + ["quote"], "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
    return keyed


# Three kinds of rows claim to quote a page. Each becomes probes (deal_slug, page_number, quote, message):
# the message says what is wrong if the quote is not on the page.
_PROBE = ["deal_slug", "page_number", "quote", "message"]


def ref_probes(refs: DataFrame) -> DataFrame:
    """Q2: evidence references (deal_slug, ref, citation_unit_id, quote_text); an address without a page has no page number."""
    page = page_of_unit(F.col("citation_unit_id"))
    name = F.concat(F.lit("evidence_ref["), F.col("ref"), F.lit("]"))
    message = F.when(page.isNull(), F.concat(name, F.lit(" has invalid citation_unit_id"))).otherwise(
        F.concat(name, F.lit(" quote_text is not an exact substring of Filing page "), page))
    return refs.select("deal_slug", page.alias("page_number"), F.when(page.isNotNull(), F.col("quote_text")).alias("quote"), message.alias("message"))


def span_probes(spans: DataFrame) -> DataFrame:
    """Q2: graph spans (deal_slug, evidence_id, source_page, quote_text)."""
    return spans.select("deal_slug", F.col("source_page").alias("page_number"), F.col("quote_text").alias("quote"), F.concat(
        F.lit("graph evidence "), F.col("evidence_id"), F.lit(" quote_text is not an exact substring of Filing page "),
        F.coalesce(F.col("source_page").cast("string"), F.lit("None"))).alias("message"))


def review_probes(review: DataFrame) -> DataFrame:
    """Q2, J17's list form: one probe per part of a review row's quote cell, zipped with its page cell.

    A single page serves all quotes of a row; otherwise both cells must have as many parts, and a row whose
    cells do not fit has one probe without a quote. Rejected claims without a quote quote nothing.
    """
    rows = review.filter(~((F.col("review_status") == "rejected_claim") & (F.coalesce("bound_source_quote", F.lit("")) == "")))
    rows = rows.select("deal_slug", "review_row_id", split_cell(F.col("bound_source_quote")).alias("q"), split_cell(F.col("bound_source_page")).alias("p"))
    rows = rows.withColumn("p", F.when((F.size("p") == 1) & (F.size("q") > 1), F.array_repeat(F.get("p", 0), F.size("q"))).otherwise(F.col("p")))
    fits = (F.size("q") > 0) & (F.size("q") == F.size("p"))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("q"), F.lit(None).cast("string").alias("p")))
    parts = F.when(F.coalesce(fits, F.lit(False)), F.zip_with("q", "p", lambda q, p: F.struct(q.alias("q"), p.alias("p")))).otherwise(nothing)
    return rows.select("deal_slug", "review_row_id", F.explode(parts).alias("x")).select(
        "deal_slug", F.col("x.p").try_cast("int").alias("page_number"), F.col("x.q").alias("quote"), F.concat(
            F.lit("review row "), F.col("review_row_id"), F.lit(" bound_source_quote is not an exact substring of its Filing page")).alias("message"))


def failed_probes(probes: DataFrame, pages: DataFrame) -> DataFrame:
    """(deal_slug, message) of the probes that do not ground, each message once: all probes meet the pages in one join."""
    return grounded(probes.select(*_PROBE), pages, ["message"]).filter("not grounded").select("deal_slug", "message").distinct()


def ref_failures(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """Q2: evidence references that do not ground."""
    return failed_probes(ref_probes(refs), pages)


def span_failures(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Q2: graph spans that do not ground."""
    return failed_probes(span_probes(spans), pages)


def review_failures(review: DataFrame, pages: DataFrame) -> DataFrame:
    """Q2: review rows whose quote cell does not ground on their page cell, part by part."""
    return failed_probes(review_probes(review), pages)


def run_id_failures(progress: DataFrame, outputs: DataFrame) -> DataFrame:
    """Q2: the output must be of the run the state names."""
    rows = progress.select("deal_slug", "last_run_id").join(outputs.select("deal_slug", "run_id"), "deal_slug", "left")
    return rows.filter(F.col("last_run_id").isNull() | ~F.col("run_id").eqNullSafe(F.col("last_run_id"))).select(
        "deal_slug", F.when(F.col("last_run_id").isNull(), "progress last_run_id is missing").otherwise(F.concat(
            F.lit("extraction run_id "), F.coalesce("run_id", F.lit("None")), F.lit(" does not match progress last_run_id "), F.col("last_run_id"))).alias("message"))


def verification_failures(refs: DataFrame, spans: DataFrame, review: DataFrame, pages: DataFrame, progress: DataFrame, outputs: DataFrame) -> DataFrame:
    """Q2: all data checks of a verification."""
    probes = ref_probes(refs).unionByName(span_probes(spans)).unionByName(review_probes(review))
    return failed_probes(probes, pages).unionByName(run_id_failures(progress, outputs))
