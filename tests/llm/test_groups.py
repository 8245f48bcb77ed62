"""Conversation trie, spelling variants and SuperMinHash against brute force on small fixtures."""
from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tracewell.llm import convtrie, spelling, superminhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(text):
    return zlib.crc32(text.encode())


# conversation trie


def trie_by_hand(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in turns:
        h = crc(str(c)) % 4
        rebuilt[c] = turns.get(c - c % 20, [])[:h] + turns[c][h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, ts in sorted(rebuilt.items()):
        ends[tuple(ts)].append(str(c))
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)

    def under(p):
        return [q for q in members if q[:len(p)] == p]
    out = []
    for p, cs in members.items():
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in under(p) if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], sum(not children[q] for q in under(p)), saved,
                    hashlib.sha256(",".join(ends[p]).encode()).hexdigest()))
    return sorted(out, key=str)


def tries_agree(spark, rows, shape="conv_id long, turn long, role string, text string"):
    got = [tuple(r) for r in convtrie.trie_digest(spark.createDataFrame(rows, shape)).collect()]
    assert sorted(got, key=str) == trie_by_hand([r[:4] for r in rows])


def test_trie_small_cases(spark):
    assert convtrie.trie_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    rows = [(1, 0, "user", "a b"), (1, 1, None, "c"), (0, 0, "user", "a b"), (0, 1, "", None), (0, 1, "", None), (21, None, "user", "x y z"),
            (21, None, "user", "x y z"), (21, 0, "bot", None), (None, 0, "user", "lost"), (25, 3, "user", ""), (38, 5, None, None)]
    tries_agree(spark, [r + (7, "clash") for r in rows], "conv_id long, turn long, role string, text string, place int, w string")


def test_trie_random_copies_and_a_long_conversation(spark):
    pick = random.Random(11)
    rows = []
    for c in range(120):
        turns = [("user", pick.choice("pq")) for _ in range(pick.randint(0, 6))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rows += [(2000, t, "user", f"long {t}") for t in range(90)] + [(2001, t, "user", f"long {t}") for t in range(7)]
    # one conversation that many ids repeat, over several blocks of ids
    rows += [(c, t, "user", f"same {t}") for c in range(8000, 20000, 40) for t in range(2)]
    tries_agree(spark, rows)


def test_trie_node_turns(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "bot", "ho"), (20, 0, "user", "hi")]
    turns = convtrie.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    named = convtrie.node_turns(convtrie.prefix_trie(turns, turns.select("conv_id").distinct()), turns).collect()
    assert sorted((r.depth, r.n_convs, r.role, r.text) for r in named if r.depth) == [(1, 2, "user", "hi"), (2, 1, "bot", "ho")]


# spelling


def variants_by_hand(counts):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if abs(len(a) - len(b)) != 1:
            return False
        short, long_ = sorted((a, b), key=len)
        return any(long_[:i] + long_[i + 1:] == short for i in range(len(long_)))
    near_of = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, vs in near_of.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, counts[w], len(near_of[w]), form[w] or "", counts.get(form[w]) or 0, root(w)) for w in counts)


def check_variants(spark, counts):
    got = spelling.variants(spark.createDataFrame(list(counts.items()) + [(None, 4), ("", 9)], "word string, n long"))
    assert sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in got.collect()) == variants_by_hand(counts)


def test_variants_random_words(spark):
    pick = random.Random(3)
    words = {"".join(pick.choice("abé") for _ in range(pick.randint(1, 6))) for _ in range(250)}
    check_variants(spark, {w: pick.randint(1, 40) for w in words})


def test_variants_runs_ties_and_long_words(spark):
    check_variants(spark, {"aaaa": 5, "aaaaa": 10, "aaa": 1, "aaaab": 10, "baaaa": 10, "x" * 3000: 2, "x" * 2999: 4, "x" * 3001: 8, "y": 1, "ÿ": 9})


def test_node_numbers_are_a_preorder_across_blocks(spark):
    pick = random.Random(5)
    words = sorted({"".join(pick.choice("abc") for _ in range(pick.randint(1, 7))) for _ in range(600)})
    frame = spark.createDataFrame([(w,) for w in words], "word string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paths = {r.word: list(r.path) for r in spelling.numbered(frame, "test").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    prefixes = sorted({w[:i] for w in words for i in range(1, len(w) + 1)})
    number = {p: i + 1 for i, p in enumerate(prefixes)}
    assert paths == {w: [number[w[:i]] for i in range(1, len(w) + 1)] for w in words}


def test_spelling_digest_from_texts(spark):
    pick = random.Random(8)
    base = ["lantern", "lanterns", "Lanterne", "harbour", "harbor", "école", "ÉCOLE", "tiny", "abcde"]
    rows = [(i, " ".join(pick.choice(base) for _ in range(pick.randint(0, 60))) + ("" if i % 3 else "-x1lantern,HARBOUR")) for i in range(300)]
    rows += [(None, "lantern abcde"), (7, None), (8, ""), (9, "\n"), (7, "harbor harbor")]
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = crc(f"{'' if doc is None else doc}:{run}")
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = spelling.spelling_digest(spark.createDataFrame([r + (1, "c") for r in rows], "doc_id long, text string, n int, word string"))
    assert sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in got.collect()) == variants_by_hand(counts)
    assert spelling.spelling_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# SuperMinHash


def shingles_by_hand(text):
    words = WORD.findall((text or "").translate(str.maketrans(spelling.UPPER, spelling.LOWER)))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def near_by_hand(rows, link):
    sets = [shingles_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= link * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), least.get(find(i), -1), d is not None and least[find(i)] == d) for i, (d, _) in enumerate(rows))


def edited(pick, words, times):
    words = list(words)
    for _ in range(times):
        words[pick.randrange(len(words))] = f"e{pick.random()}"
    return words


@pytest.mark.parametrize("block", [1 << 18, 300])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(superminhash, "BLOCK_SHINGLES", block)
    pick = random.Random(block)
    texts = [None, "", " \n\t", "one two", "ONE two", "one  two", "a b c d e", "a b c d e f"]
    for size in (8, 40, 120, 300):
        for g in range(4):
            words = [f"w{pick.randint(0, 10**6)}" for _ in range(size)]
            texts += [" ".join(edited(pick, words, n)) for n in (0, 0, 1, 1, 2, 3, 4, 6)]
    chain = [f"c{i}" for i in range(200)]  # each near the next, the ends far apart
    for i in range(12):
        texts.append(" ".join(chain))
        chain = chain[6:] + [f"d{i}_{k}" for k in range(6)]
    texts.append(" ".join(f"z{i}" for i in range(60_000)))
    texts.append(" ".join(f"z{i}" for i in range(50, 60_000)))
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(None, "one two"), (None, "alone here"), (3, "a b c d e"), (3, "a b c d e")]
    got = superminhash.near_duplicates(spark.createDataFrame([r + (1, "x") for r in rows], "doc_id long, text string, n int, digest string"))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in got.collect()) \
        == near_by_hand(rows, 85)


def test_near_duplicates_in_one_large_group(spark):
    """600 near copies of one text, some only near through others, are one component; no pair is lost to the size of the group."""
    pick = random.Random(21)
    base = [f"w{pick.randint(0, 10**6)}" for _ in range(150)]
    rows = [(i, " ".join(edited(pick, base, pick.randint(0, 3)))) for i in range(600)]
    rows += [(5000 + i, " ".join(f"q{i}_{k}" for k in range(50))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(docs).collect()}
    want = {d: c for d, _, c, _ in near_by_hand(rows, 85)}
    assert got == want
    left = {r.doc_id for r in superminhash.deduplicated(docs).collect()}
    assert left == {d for d, c in want.items() if d == c}


def test_near_duplicates_without_rows_or_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert superminhash.near_duplicates(empty).count() == 0 and superminhash.deduplicated(empty).count() == 0
    blank = spark.createDataFrame([(2, None), (1, ""), (None, " ")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in superminhash.near_duplicates(blank).collect()) == [
        ("1", 0, "1", True), ("2", 0, "2", True), ("None", 0, "None", False)]
    assert sorted(str(r.doc_id) for r in superminhash.deduplicated(blank).collect()) == ["1", "None"]


def test_signature_is_that_of_the_sequential_rule():
    """The block-wise signature equals the rule element by element, and the estimate is close to the similarity."""
    pick = np.random.default_rng(2)
    own = np.unique(pick.integers(0, 2**63, 90, dtype=np.uint64))
    want = np.full(superminhash.SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for element in own:
        order = list(range(superminhash.SLOTS))
        for place in range(superminhash.SLOTS):
            draw = int(superminhash._mixed(np.array([(int(element) + int(superminhash._GOLDEN) * (place + 1)) % 2**64], np.uint64))[0])
            other = place + ((draw >> 32) * (superminhash.SLOTS - place) >> 32)
            order[place], order[other] = order[other], order[place]
            want[order[place]] = min(int(want[order[place]]), place << 32 | draw & 0xFFFFFFFF)
    both = superminhash.signatures([own, np.empty(0, np.uint64), own[10:]])
    assert (both[0] == want).all() and (both[1] == np.iinfo(np.uint64).max).all()
    assert abs((both[0] == both[2]).mean() - 80 / 90) < 0.12
