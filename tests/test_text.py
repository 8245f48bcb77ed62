"""Splitting, offsets, searching and formatting against plain Python on random and awkward texts."""
import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracewell.functions.hashing import content_version, evidence_fingerprint, make_id, stable_id
from tracewell.functions.ranking import ordinal, running_total
from tracewell.functions.text import is_anonymous_alias, is_cohort_alias, normal_text, number_text, sums_before
from tracewell.operators.binding import bind_anywhere, stitched_units
from tracewell.operators.contains import candidate_texts, contains_pairs, first_texts, hashed_quotes, verified
from tracewell.operators.documents import document_rows, html_rows, pick_document, url_parts
from tracewell.operators.ledger import date_precision, float_text
from tracewell.operators.sections import SectionSpec, match_array, section_bounds, short_sections, slice_section, start_candidates
from tracewell.operators.units import citation_units, page_of_unit, paragraph_array

PARAGRAPH = r"\S(?:.*?\S)?(?=\n\s*\n|\Z)"


def random_texts(count=400, seed=1):
    rng = random.Random(seed)
    pieces = ["a", "b", "é", "\n", " ", "\n\n", " ", "Xy", "\t", "12", "”", "\x1c", "😀"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(count)]


def test_paragraphs_and_offsets(spark):
    texts = random_texts() + ["A\n\nBcd", "A\n\nBcd\n", "first \n\nsecond", "one\n", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = {r.i: [(p.text, p.start) for p in r.p] for r in df.select("i", paragraph_array(F.col("content")).alias("p")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == [(m.group(0), m.start()) for m in re.finditer(PARAGRAPH, text, flags=re.DOTALL)], repr(text)


def test_unit_offsets_run_over_the_filing(spark):
    pages = ["One.\n\n7\n\nTwo.", "Table of Contents\n\nThree.", "", "ZEQ.=1\n\n  Four.\n\nlost "]
    df = spark.createDataFrame([("d", i, i + 5, t) for i, t in enumerate(pages)], "deal_slug string, page_pos int, number int, content string")
    rows = sorted(citation_units(df).collect(), key=lambda r: r.sequence)
    whole = "\n".join(pages)
    assert [r.unit_id for r in rows] == ["page_5_paragraph_1", "page_5_paragraph_2", "page_6_paragraph_1", "page_8_paragraph_1"]
    # a one-character paragraph closes only together with its neighbour
    assert rows[1].text == "7\n\nTwo." and [whole[r.char_start:r.char_end] for r in rows] == [r.text for r in rows]
    assert [r.sequence for r in rows] == [0, 1, 2, 3]
    assert rows[0].paragraph_hash == hashlib.sha256(rows[0].text.encode()).hexdigest()


def test_ordinal_and_running_total_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 3), rng.choice("xyz"), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, l1 int, l2 string, i int, v int")
    got = {r.i: r.ordinal for r in ordinal(df, ["k"], ["l1", "l2"], [F.col("i")]).collect()}
    total = {r.i: r.before for r in running_total(df, ["k"], "i", {"v": "before"}, block=16).collect()}
    for k in "ab":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2], r[3]))
        assert [got[r[3]] for r in mine] == list(range(1, len(mine) + 1))
        s = 0
        for r in sorted(mine, key=lambda r: r[3]):
            assert total[r[3]] == s
            s += r[4]


def test_contains_pairs_equals_nested_loop(spark):
    rng = random.Random(5)
    words = ["the", "board", "of", "company", "aa", "a", "bid", "offer."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    quotes = set()
    for t in texts:
        i = rng.randint(0, len(t) - 1)
        quotes.add(t[i:i + rng.choice([1, 2, 3, 5, 12, 30, 60])])
    quotes |= {"not there at all today", "zz", "q"}
    quotes = {q for q in quotes if q.strip()}
    tdf = spark.createDataFrame([(t, hashlib.sha256(t.encode()).hexdigest()) for t in texts], "text string, text_hash string")
    qdf = spark.createDataFrame([(q,) for q in quotes], "quote_text string")
    got = {(r.quote_text, r.text_hash): (r.overlapping, r.plain) for r in contains_pairs(qdf, tdf, []).collect()}
    want = {}
    for q in quotes:
        for t in set(texts):
            if q in t:
                want[(q, hashlib.sha256(t.encode()).hexdigest())] = (sum(t.startswith(q, i) for i in range(len(t))), t.count(q))
    assert got == want


def test_bind_anywhere(spark):
    df = spark.createDataFrame(
        [("d", 0, 1, "Alpha one two three four five.\n\nAlpha one two three four six.\n\nAlpha one two three four six.\n\nshort bit")],
        "deal_slug string, page_pos int, number int, content string")
    quotes = ["two three four five", "one two three four", "Alpha one two three four six.", "rt bi", "nowhere to be found at all", " "]
    qdf = spark.createDataFrame([("d", i, q) for i, q in enumerate(quotes)], "deal_slug string, i int, quote_text string")
    rows = {r.i: r for r in bind_anywhere(qdf, citation_units(df), ["deal_slug"]).collect()}
    assert [rows[i].status for i in range(6)] == ["bound", "ambiguous", "ambiguous", "bound", "missing", "blank"]
    assert rows[0].unit_id == "page_1_paragraph_1" and (rows[0].span_start, rows[0].span_end) == (10, 29)
    assert rows[1].occurrences == 3


def _stitched(quote, cited, units):
    """The search as a plain loop over (id, text) pairs."""
    for s in range(len(units)):
        text, ids = units[s][1], [units[s][0]]
        for e in range(s + 1, len(units)):
            grown = ids + [units[e][0]]
            if any(quote in text + sep + units[e][1] for sep in ("\n\n", "\n", " ")) and (cited is None or cited in grown):
                return grown
            text, ids = text + "\n\n" + units[e][1], grown
            if len(text) > len(quote) + 60:
                break
    return None


def test_stitching_equals_plain_search(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(3, 30))).strip() or "x" for _ in range(40)]
    df = spark.createDataFrame([("d", 0, 1, "\n\n".join(t + "!!" for t in texts))], "deal_slug string, page_pos int, number int, content string")
    units = sorted(citation_units(df).collect(), key=lambda r: r.sequence)
    plain = [(u.unit_id, u.text) for u in units]
    refs = [("d", "page_9_paragraph_9", "a!! b")]
    for _ in range(40):
        i = rng.randint(0, len(plain) - 3)
        quote = plain[i][1][-4:] + rng.choice(["\n\n", "\n", " "]) + plain[i + 1][1][:4]
        refs.append(("d", rng.choice([None, plain[i][0], plain[i + 1][0], plain[rng.randint(0, len(plain) - 1)][0]]), quote))
    rdf = spark.createDataFrame(refs, "deal_slug string, citation_unit_id string, quote_text string")
    got = {(r.citation_unit_id, r.quote_text): r.stitched for r in stitched_units(rdf, citation_units(df), slack=60).collect()}
    for _, cited, quote in refs:
        assert got.get((cited, quote)) == _stitched(quote, cited, plain), (cited, quote)


def test_stitching_anywhere_equals_plain_search(spark):
    """Quotes across one and more seams, with white space at their ends, one-token units and repeated seams."""
    rng = random.Random(31)
    words = ["ab", "c", "de.", "fgh", "Ij", "klm."]
    deals = {f"d{k}": [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) + "!" for _ in range(60)] for k in range(3)}
    pages = [(k, 0, 1, "\n\n".join(ts)) for k, ts in deals.items()]
    units = citation_units(spark.createDataFrame(pages, "deal_slug string, page_pos int, number int, content string"))
    refs = set()
    for k, ts in deals.items():
        for _ in range(60):
            i, n = rng.randint(0, 55), rng.randint(1, 3)
            whole = "\n\n".join(ts[i:i + n]) + rng.choice(["\n\n", "\n", " "]) + ts[i + n]
            last = whole.rindex(ts[i + n])
            refs.add((k, None, whole[rng.randint(0, len(ts[i])):rng.randint(last, len(whole))]))
    refs = [r for r in refs if r[2] and not any(r[2] in t for t in deals[r[0]])]
    got = {(r.deal_slug, r.quote_text): r.stitched for r in stitched_units(
        spark.createDataFrame(refs, "deal_slug string, citation_unit_id string, quote_text string"), units, slack=60).collect()}
    known = {k: [(f"page_1_paragraph_{i + 1}", t) for i, t in enumerate(ts)] for k, ts in deals.items()}
    for deal, _, quote in refs:
        assert got.get((deal, quote)) == _stitched(quote, None, known[deal]), (deal, quote)


def _search_frames(spark, quotes, texts):
    q = spark.createDataFrame([("d", x) for x in quotes], "deal_slug string, quote_text string")
    t = spark.createDataFrame([("d", i, x) for i, x in enumerate(texts)], "deal_slug string, at int, text string").withColumn("text_hash", F.sha2("text", 256))
    return q, t


def test_short_quotes_meet_few_texts(spark):
    """300 quotes "x of y" on 300 texts full of "of": the characters next to "of" part them."""
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    quotes = [f"{a[-rng.randint(1, 5):]} of {b[:rng.randint(3, 5)]}" for a, b in zip(names, reversed(names))]
    texts = [f"the {a} of {b} and the rest of it" for a, b in zip(names, reversed(names))]
    q, t = _search_frames(spark, quotes, texts)
    hashed = hashed_quotes(q, ["deal_slug"])
    met = candidate_texts(hashed, t, ["deal_slug"])
    assert met.count() < 3000
    pairs = {(r.quote_text, r.text_hash) for r in verified(met, hashed, t, ["deal_slug"]).collect()}
    assert pairs == {(x, hashlib.sha256(y.encode()).hexdigest()) for x in quotes for y in texts if x in y}


def test_first_texts_look_into_few_texts(spark):
    """A quote that every text holds costs `limit` looks; one that few hold is looked for to the end."""
    texts = [f"number {i} says that all of this is so" for i in range(400)] + ["a quote  of\tblanks"]
    quotes = ["says that all of this", "that all of", "number 7 says that", "  ", "\t", " ", "not there at all my friend"]
    q, t = _search_frames(spark, quotes, texts)
    found, looked = first_texts(q, t, ["deal_slug"], t.select("deal_slug", "text_hash", "at"), 8)
    got = {}
    for r in found.join(t, ["deal_slug", "text_hash"]).collect():
        got.setdefault(r.quote_text, []).append(r.at)
    want = {x: [i for i, y in enumerate(texts) if x in y][:8] for x in quotes}
    assert {x: sorted(v)[:8] for x, v in got.items()} == {x: v for x, v in want.items() if v}
    assert looked <= 3 * sum(map(len, got.values()))


def test_numbers_print_like_percent_g(spark):
    rng = random.Random(2)
    values = [0.0, 1.0, -2.5, 130904.5, 13090.45, 999999.5, 999998.5, 1e-5, 0.0001, 123456789.0, 1e16, 2.5e-7, 21.0, 100000.0, 1000000.0]
    values += [round(rng.uniform(0, 10 ** rng.randint(-3, 9)), rng.randint(0, 4)) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", number_text(F.col("v")).alias("t"), float_text(F.col("v")).alias("f")).collect():
        assert r.t == f"{r.v:g}", r.v
    floats = [12500000.0, 0.0005, 21.0, 8.55, 123456789.25]
    got = [r.f for r in spark.createDataFrame([(v,) for v in floats], "v double").select(float_text(F.col("v")).alias("f")).collect()]
    assert got == [str(v) for v in floats]


def test_normal_text_and_aliases(spark):
    texts = ["Party  A", "ﬁnancial Sponsor B", "Ｕnnamed Bidder", None, "strategic party 7", "The Party"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(normal_text(F.col("t")).alias("n")).select(
        "n", is_anonymous_alias(F.col("n")).alias("a"), is_cohort_alias(F.col("n")).alias("c")).collect()
    want = ["" if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip().lower() for t in texts]
    assert [r.n for r in rows] == want
    assert [r.a for r in rows] == [True, True, True, False, True, False]
    assert [r.c for r in rows] == [True, True, False, False, True, False]


def test_identifiers(spark):
    row = spark.range(1).select(
        make_id("ev", F.lit("f"), F.lit(3), F.lit(None)).alias("m"), stable_id("actor", F.lit("d"), F.lit(None), F.lit("x")).alias("s"),
        evidence_fingerprint(F.lit("f"), F.lit(1), F.lit(2), F.lit("h")).alias("e")).first()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert row.m == "ev_" + sha("f\x1f3\x1fnull\x1f")[:24] and row.s == "actor_" + sha("d|None|x")[:16] and row.e == sha("f\x1f1\x1f2\x1fh")
    files = spark.createDataFrame([("b.md", bytearray(b"two")), ("a.md", bytearray(b"one"))], "name string, content binary")
    assert content_version(files).first()[0] == hashlib.sha256(b"a.md\0one\0b.md\0two\0").hexdigest()
    with pytest.raises(ValueError):
        make_id("bad-prefix", F.lit("x"))


def test_date_precision_and_unit_pages(spark):
    dates = ["2014-01-03", "2014-01", "2014", "early 2014", "", None]
    rows = spark.createDataFrame([(d,) for d in dates], "d string").select(date_precision(F.col("d")).alias("p")).collect()
    assert [r.p for r in rows] == ["exact", "month", "year", "rough", "unknown", "unknown"]
    ids = ["page_12_paragraph_3", "page_x", "page_1_paragraph_2 ", None]
    assert [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(page_of_unit(F.col("i"))).collect()] == [12, None, None, None]


def section_pages(spark, contents):
    return spark.createDataFrame([("d", i, i + 1, t) for i, t in enumerate(contents)], "deal_slug string, page_pos int, number int, content string")


def test_section_is_found_behind_contents_and_cross_references(spark):
    toc = "| Background of the Merger | 20 | x | y | z |"
    cross = "For details see Background of the Merger in this document."
    story = "**Background of the Merger** The following chronology summarizes the talks. " + "Party A called. " * 150
    end = "More talks.\n\n**Reasons for the Merger** The board decided."
    pages = section_pages(spark, [toc, cross] + ["filler"] * 16 + [story, end])
    assert {r.score for r in start_candidates(pages).collect()} == {-8, 12}
    bounds = section_bounds(pages)
    b = bounds.first()
    assert (b.reason, b.start_page, b.start_index, b.end_page, b.end_index) == (None, 19, 2, 20, 11)
    cut = sorted(slice_section(pages, bounds).collect(), key=lambda r: r.page_pos)
    assert cut[0].content == story[2:] and cut[1].content == end[:11]
    assert short_sections(slice_section(pages, bounds)).count() == 0


def test_sums_before_and_many_headings(spark):
    rng = random.Random(6)
    sizes = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1100)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(sizes)], "i int, x array<int>").select("i", sums_before(F.col("x")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: [sum(x[:k]) for k in range(len(x))] for i, x in enumerate(sizes)}
    text = "".join(rng.choice(["Of The", "é", "x ", "\n"]) for _ in range(3000))
    spans = spark.createDataFrame([(text,)], "t string").select(match_array(F.col("t"), "of the").alias("m")).first().m
    assert [(s.start, s.stop) for s in spans] == [m.span() for m in re.finditer("of the", text, re.I)]


def test_section_end_is_sought_up_to_the_window(spark):
    """A start on page 20; the end heading lies on the last page of the window, or on the first behind it."""
    story = "text\n**Background of the Merger**\nThe following chronology summarizes events. " + "words " * 400
    for gap, found in ((33, True), (34, False)):
        pages = section_pages(spark, ["filler"] * 20 + [story] + ["more"] * gap + ["\nReasons for the Merger\nwhy"])
        bounds = section_bounds(pages).first()
        assert bounds.start_pos == 20 and (bounds.reason is None) == found
        assert bounds.end_pos == (20 + gap + 1 if found else None)


def test_section_failures_are_rows(spark):
    only_toc = section_bounds(section_pages(spark, ["| Background of the Merger | 1 | 2 | 3 |"])).first()
    assert "only table-of-contents" in only_toc.reason
    assert "heading not found" in section_bounds(section_pages(spark, ["nothing"])).first().reason
    no_end = section_bounds(section_pages(spark, ["x"] * 15 + ["**Background of the Offer** text"])).first()
    assert no_end.reason == "Background section end heading not found within 35 pages of start page 16"
    short = section_pages(spark, ["x"] * 15 + ["**Background of the Offer** text.\n\nOpinion of the banker"])
    assert "too little filing text" in short_sections(slice_section(short, section_bounds(short)), SectionSpec()).first().reason


def test_urls_and_documents(spark):
    urls = [
        "https://www.sec.gov/Archives/edgar/data/12/0001193125-16-696911-index.htm#toc", "https://www.sec.gov/Archives/edgar/data/12/000119312516696911/0001193125-16-696911-index.htm",
        "https://www.sec.gov/Archives/edgar/data/12/000119312516696911/d.htm?highlight=1", "https://example.com/x"]
    rows = url_parts(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert {(r.cik, r.accession) for r in rows[:3]} == {("12", "000119312516696911")} and rows[3].cik is None
    assert rows[0].index_url.endswith("/data/12/000119312516696911/0001193125-16-696911-index.htm")
    html = lambda *forms: "".join(f'<tr><td><a href="/d{i}.htm">doc{i}.htm</a></td>\n<td scope="row">{f}</td> <td>{i}00</td></tr>' for i, f in enumerate(forms))
    filings = {"merger": html("EX-99.1", "DEFM14A"), "tender": html("SC TO-T", "EX-99.(A)(1)(B)", "EX-99.(A)(1)(A)"), "cover": html("SC TO-T", "EX-10"),
               "excluded": html("425", "EX-1"), "unknown": html("10-K"), "none": html("EX-1", "EX-2")}
    df = spark.createDataFrame(list(filings.items()), "filing string, html string")
    got = {r.filing: r for r in pick_document(document_rows(html_rows(df)), ["filing"]).collect()}
    assert (got["merger"].form_type, got["merger"].name, got["merger"].size_bytes) == ("DEFM14A", "doc1.htm", 100)
    assert got["merger"].url == "https://www.sec.gov/d1.htm" and got["tender"].form_type == "EX-99.(A)(1)(A)"
    assert got["cover"].form_type == "SC TO-T" and got["cover"].warning
    assert got["excluded"].issue == "excluded form type 425" and got["unknown"].issue.endswith("10-K") and got["none"].issue.startswith("no primary")
