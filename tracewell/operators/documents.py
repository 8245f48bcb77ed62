"""Source resolution: URL parts, index-page links, choice of document."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Form types (fixed values).
PRIMARY_FORMS = ("DEFM14A", "PREM14A", "SC TO-T", "SC TO-T/A", "SC 14D9", "SC 14D9/A", "S-4", "S-4/A")
EXCLUDED_FORMS = ("425",)
TENDER_FORMS = ("SC TO-T", "SC TO-T/A")
OFFER_EXHIBIT = r"(?i)^EX-99(?:\.\d+)?\.?\(?A\)?\(?1\)?\(?A\)?"
ARCHIVE_ROOT = "https://www.sec.gov"
# Patterns of the three URL forms (fixed values).
INDEX_URL = r"/data/(\d+)/(?:\d{18}/)?([0-9\-]+)-index\.htm"
DIRECT_URL = r"/data/(\d+)/(\d{18})(?:[/?]|$)"
INDEX_ROW = (
    r'(?i)<a href="([^"]+\.(?:htm|html))"[^>]*>([^<]+)</a>\s*</td>\s*'
    r"<td[^>]*>([^<]*)</td>\s*<td[^>]*>([^<]*)</td>"
)


def clean_url(url: Column) -> Column:
    """Drop the fragment, then the query string."""
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def url_parts(df: DataFrame, url: str = "url", index_pattern: str = INDEX_URL, direct_pattern: str = DIRECT_URL) -> DataFrame:
    """Cik, accession and canonical index URL; all null where the URL has no known form."""
    clean = clean_url(F.col(url))

    def pick(group: int) -> Column:
        first = F.nullif(F.regexp_extract(clean, index_pattern, group), F.lit(""))
        second = F.nullif(F.regexp_extract(clean, direct_pattern, group), F.lit(""))
        return F.coalesce(first, second)

    parsed = df.withColumn("cik", pick(1)).withColumn("accession", F.replace(pick(2), F.lit("-"), F.lit("")))
    return parsed.withColumn("index_url", canonical_index_url(F.col("cik"), F.col("accession")))


def canonical_index_url(cik: Column, accession: Column) -> Column:
    dashed = F.concat_ws(
        "-", F.substring(accession, 1, 10), F.substring(accession, 11, 2), F.substring(accession, 13, 1000))
    path = F.concat(F.lit(f"{ARCHIVE_ROOT}/Archives/edgar/data/"), cik, F.lit("/"), accession, F.lit("/"))
    return F.concat(path, dashed, F.lit("-index.htm"))


def html_rows(df: DataFrame, html: str = "html", pattern: str = INDEX_ROW, groups: int = 4) -> DataFrame:
    """One row per link row of an index page, in page order; non-matching pages give no row."""
    found = [F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(g + 1)) for g in range(groups)]
    names = ("href", "name", "form_type", "size")[:groups]
    others = [c for c in df.columns if c != html]
    rows = df.select(*others, *[c.alias(n) for c, n in zip(found, names)])
    rows = rows.select(*others, F.posexplode(F.arrays_zip(*names)).alias("pos", "_row"))
    return rows.select(*others, "pos", *[F.col(f"_row.{n}").alias(n) for n in names])


def document_rows(links: DataFrame) -> DataFrame:
    """Trimmed cells, absolute URL and numeric size of T13 rows."""
    size = F.trim("size")
    return links.select(
        *[c for c in links.columns if c not in ("href", "name", "form_type", "size")],
        F.trim("name").alias("name"),
        F.trim("form_type").alias("form_type"),
        F.when(size.rlike(r"^\d+$"), size.try_cast("long")).alias("size_bytes"),
        F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(ARCHIVE_ROOT), F.col("href"))).alias("url"),
    )


def pick_document(docs: DataFrame, key: list[str]) -> DataFrame:
    """The substantive document of each filing, or the reason there is none.

    One pass of ordered minima per filing; no window, so large filings aggregate map-side.
    """
    form = F.col("form_type")
    row = F.struct("pos", "name", "form_type", "size_bytes", "url")

    def first(condition: Column) -> Column:
        return F.min(F.when(condition, row))

    best = docs.groupBy(*key).agg(
        first(form.isin(*PRIMARY_FORMS)).alias("_primary"),
        first(~F.upper(form).startswith("EX-")).alias("_plain"),
        first(form.rlike(OFFER_EXHIBIT)).alias("_offer"),
    )
    primary = F.coalesce("_primary", "_plain")
    best = best.withColumn("_p", primary)
    tender = F.col("_p.form_type").isin(*TENDER_FORMS)
    chosen = F.when(tender & F.col("_offer").isNotNull(), F.col("_offer")).otherwise(F.col("_p"))
    issue = (
        F.when(F.col("_p").isNull(), "no primary document identifiable")
        .when(F.col("_p.form_type").isin(*EXCLUDED_FORMS), F.concat(F.lit("excluded form type "), F.col("_p.form_type")))
        .when(~F.col("_p.form_type").isin(*PRIMARY_FORMS), F.concat(F.lit("unknown substantive form type "), F.col("_p.form_type")))
    )
    best = best.withColumn("issue", issue).withColumn("_c", F.when(issue.isNull(), chosen))
    return best.select(
        *key, "issue",
        F.when(F.col("issue").isNull() & tender & F.col("_offer").isNull(), "cover form used; no offer exhibit found").alias("warning"),
        *[F.col(f"_c.{n}").alias(n) for n in ("name", "form_type", "size_bytes", "url")],
    )
