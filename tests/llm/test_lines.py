"""Line dedup: maximal repeated runs by prefix doubling against brute force."""
from __future__ import annotations

import random
import re

import pytest

from tracewell.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(rows, need=1):
    """doc_id -> [(line number of the start, length in lines with a word)] of maximal runs that begin earlier too."""
    first, out = {}, {}
    lines = {d: [(n, x) for n, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t in rows}
    for doc in sorted(lines):
        texts = [x for _, x in lines[doc]]
        for a in range(len(texts)):
            for b in range(a, len(texts)):
                first.setdefault(tuple(texts[a:b + 1]), (doc, a))
    for doc, own in lines.items():
        texts, reach, out[doc] = [x for _, x in own], 0, []
        for a in range(len(texts)):
            stop = a
            while stop < len(texts) and first[tuple(texts[a:stop + 1])] < (doc, a):
                stop += 1
            if stop > max(a, reach):
                reach = stop
                if sum(len(WORD.findall(x)) for x in texts[a:stop]) >= need:
                    out[doc].append((own[a][0], stop - a))
    return out


def runs_of(frame, need=1):
    rows = linededup.without_repeated_runs(frame, min_words=need).collect()
    return {r["row"].doc_id: [(x.start, x.length) for x in r.runs] for r in rows}


def spliced(seed, documents, letters, pieces):
    """Documents cut together from one another, so that runs of all lengths meet, overlap and break off."""
    pick, texts = random.Random(seed), []
    for _ in range(documents):
        own = []
        for _ in range(pick.randint(0, pieces)):
            if texts and pick.random() < 0.6:
                source = pick.choice(texts)
                at = pick.randint(0, max(0, len(source) - 1))
                own += source[at:at + pick.randint(1, 24)]
            else:
                own += [pick.choice(["", " ", *(f"line {i}" for i in range(letters))]) for _ in range(pick.randint(1, 6))]
        texts.append(own)
    return [(5 * i, "\n".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "documents", "letters", "pieces", "need"), [(1, 30, 3, 6, 1), (2, 25, 400, 6, 1), (3, 25, 12, 5, 9)])
def test_maximal_runs_equal_brute_force(spark, seed, documents, letters, pieces, need):
    rows = [*spliced(seed, documents, letters, pieces), (900, None), (901, ""), (902, "\n".join(["same"] * 37)), (903, "\n".join(f"u {i}" for i in range(70)))]
    rows += [(904, rows[-1][1]), (905, rows[-1][1] + "\nline 1"), (906, "\n".join(f"u {i}" for i in [*range(20, 53), 3, 4, 5, *range(60, 70)]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = linededup.suffix_ranks(linededup.line_table(frame))
    assert len(ranks) == 7  # lengths 1 to 64
    want = runs_by_hand(rows, need)
    assert max(length for own in want.values() for _, length in own) == 70
    assert runs_of(frame, need) == want


def test_rows_without_id_are_told_apart_by_their_texts(spark):
    shape = "doc_id long, text string, place int, runs string"
    rows = [(None, "b\na", 1, "x"), (None, "b\na", 1, "x"), (None, "c\nb\na", 2, None), (4, "a", 3, "y"), (None, None, None, None)]
    got = linededup.cleaned(spark.createDataFrame(rows, shape))
    texts = {(r.doc_id, r.place): r.text for r in got.collect()}
    assert got.count() == 5 and got.columns == ["doc_id", "text", "place", "runs"]
    assert texts[4, 3] == "a" and texts[None, None] is None
    # One of the two different texts without id keeps the shared lines where they are first; 'a' of document 4 comes before them.
    assert {texts[None, 1], texts[None, 2]} in ({"b", "c"}, {"", "c\nb"})


def test_nothing_repeats_and_nothing_given(spark):
    shape = "doc_id long, text string"
    assert linededup.line_digest(spark.createDataFrame([], shape)).count() == 0
    assert runs_of(spark.createDataFrame([(1, "a\nb"), (2, "c"), (3, "")], shape)) == {1: [], 2: [], 3: []}


def test_near_dedup_of_the_pipeline_is_the_fingerprint_operator(spark):
    """The stage keeps what operator 8 keeps: the smallest id of each group linked by its fingerprints, null and blank texts included."""
    import corpus_pipeline
    from tracewell.llm import simhash
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:399] + ["end"]), " ".join(words), " ".join(words[::-1]), "", None, "a b c"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    groups = simhash.near_duplicates(docs).collect()
    kept = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in groups if r.doc_id == r.component_id)
    assert {2, 5} <= {r.doc_id for r in groups if r.doc_id != r.component_id}
    assert any("fingerprints-" in f for f in kept.inputFiles())
