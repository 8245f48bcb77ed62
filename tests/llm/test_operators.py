"""The training-data operators against brute force on small fixtures: nulls, empties, ties, repeats, clashes."""
from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from tracewell.llm import ann, bpe, linededup, mixing, packing, pieces, pii, quality, simhash, substring, toxicity

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string"


def frame(spark, rows, shape=SHAPE):
    return spark.createDataFrame(rows, shape)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def noise(seed, pieces, count, longest=40):
    pick = random.Random(seed)
    return ["".join(pick.choice(pieces) for _ in range(pick.randint(0, longest))) for _ in range(count)]


# quality rules


def quality_by_hand(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_and_verdicts(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 30, "é🎉 ok\n\né🎉 ok\nno"] + noise(1, ["a ", "b ", "cc\n", "#", "\n", "\t", " ", "é "], 60)
    texts += ["word%d " % i * 1 for i in range(3)] + [" ".join(f"w{i}" for i in range(5000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (0, None)]
    got = quality.quality_digest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    known = dict(rows)
    for r in got:
        want = quality_by_hand(known[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_keeps_columns_and_ablations_agree(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, 7, "x"), (2, "few words", 8, None), (3, good + " ##########", 9, "y"), (4, "few ####", 1, "z")]
    docs = frame(spark, rows, "doc_id long, text string, failed int, n_words string")
    assert [tuple(r) for r in quality.kept_documents(docs).collect()] == [rows[0]]
    assert quality.kept_documents(docs.limit(0)).count() == 0
    table = {r.rule: (r.n_failed, r.n_failed_only, r.n_kept_without) for r in quality.ablations(quality.ledger(docs.select("doc_id", "text"))).collect()}
    assert table["few_words"] == (2, 1, 2) and table["symbols"] == (2, 1, 2) and table["duplicate_lines"] == (0, 0, 1)


# mixing


def test_mixing_meets_targets(spark):
    pick = random.Random(4)
    rows = [(i, "w " * pick.randint(0, 30), s) for i, s in enumerate([None] * 5 + ["a"] * 300 + ["b"] * 3 + ["c"] * 40)]
    rows += [(9000, None, "b"), (9001, "", None), (9002, "one", "a"), (9002, "one", "a")]
    got = mixing.mixing_digest(frame(spark, rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order, total = ["a", "b", "c", None], sum(sizes.values())
    weight, full = {s: n % 3 + 1 for n, s in enumerate(order)}, set()
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] >= 3 * sizes[s]}
        if not more:
            break
        full |= more
    targets = {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in order}
    source_of = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got:
        source = source_of[r.doc_id]
        taken[source] += r.taken
        assert abs(r.target - targets[source]) < 1e-6 and r.source_size == sizes[source] and r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in order)


def test_mix_is_in_training_order_and_keeps_columns(spark):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(10)), "ab"[i % 2], 3, "k") for i in range(40)] + [(99, None, None, 1, "k")]
    docs = frame(spark, rows, "doc_id long, text string, source string, size int, _take string")
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    assert out == mixing.mixed(docs).collect()
    counts = collections.Counter(r.source for r in out for _ in WORD.findall(r.text))
    assert abs(counts["a"] - 400 / 3) < 1 and abs(counts["b"] - 800 / 3) < 1
    originals = dict((r[0], r[1]) for r in rows)
    assert all(originals[r.doc_id].startswith(r.text) for r in out)
    assert mixing.mixed(docs.limit(0)).count() == 0
    # The schedule of "b" falls over time: more of it stands in the first half.
    half = [r.source for r in out[:len(out) // 2]]
    assert half.count("b") > 1.2 * [r.source for r in out[len(out) // 2:]].count("b")


# byte-pair encoding and packed files


HARD = [None, "", "a", "<|endoftext|>", "x <|endoftext|>y\n<|endoftext|>\n\n z", "  two  spaces \n\n\n end \t\t", "日本語 テスト 🎉🎉 émoji", "a" * 3000,
        "!" * 999 + " " * 300, " lead", "trail ", "\nlead", "trail\n", "it's we'll I'd 's 'sabc", " x y　", "12 345.67, a,b. c.", "a\tb\r\nc"]


def test_bpe_equals_the_library(spark, tokenizer):
    texts = HARD + noise(3, list("ab c\n'sdé1.,-\t") + ["the", "ing", "🎉"], 300)
    rows = list(enumerate(texts)) + [(None, "the end"), (0, None)]
    wanted = dict(rows)
    for r in bpe.bpe_digest(spark, frame(spark, rows)).collect():
        ids = tokenizer.encode(wanted[r.doc_id] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    docs = bpe.encoded(frame(spark, [(i, t, 5) for i, t in enumerate(HARD)], "doc_id long, text string, ids int"))
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in docs.collect())
    assert [r.decoded for r in bpe.decoded(docs).orderBy("doc_id").collect()] == [t or "" for t in HARD]
    assert bpe.bpe_digest(spark, frame(spark, [])).count() == 0


def test_trie_forgets_without_changing_results(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PAIRS", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 10)
    monkeypatch.setattr(packing, "MAX_PIECES", 10)
    codec, library = bpe.Codec(bpe.tokenizer_text()), packing.Pieces(bpe.tokenizer_text())
    for text in noise(8, ["un", "der", "stand", "ing", " ", ",", "."], 50):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids == next(library.arrays([text])).tolist()
        assert next(codec.digests([text]))[0] == len(ids)


def test_trie_visits_shared_prefixes_once(tokenizer):
    words = [" under", " understand", " understanding", " undertow", " stand", " standing"]
    trie = bpe.Codec(bpe.tokenizer_text()).trie
    got = trie.encode(words)
    assert got == {w: tokenizer.encode(w, add_special_tokens=False).ids for w in words}
    assert trie.nodes == len({w[:i] for w in words for i in range(1, len(w) + 1)})


@pytest.mark.parametrize("size", [1, 40, 10**7])
def test_texts_are_whole_however_they_are_cut(tokenizer, size):
    texts = [t or "" for t in HARD] + ["\ue000 \ue001", "a\x00b c", "x" * 200_000, "long words " * 20_000] + noise(11, ["a", " ", "\n", "\t", "\u00a0", "b,"], 60)
    for chunk in pieces.chunks(texts, size):
        cut = pieces.Cut(chunk)
        assert [bytes(b).decode() for b in cut.gather([p.encode() for p in cut.distinct])] == chunk
        assert cut.total([len(p) for p in cut.distinct]) == [len(t) for t in chunk]
    codec = bpe.Codec(bpe.tokenizer_text())
    assert [i.tolist() for i in codec.arrays(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 32])
def test_packing_round_trip_and_random_access(tmp_path, bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 7, 300, 64, 0, 1000)]
    writer = packing.ShardWriter(str(tmp_path / "x" / "s.bin"), bits, block_ids=64)
    for part in ids:
        writer.append(part)
    writer.close()
    reader = packing.ShardReader(str(tmp_path / "x" / "s.bin"))
    for number, part in enumerate(ids):
        assert (reader.document(number) == part).all()
    flat = np.concatenate(ids)
    assert (reader.read(100, 900) == flat[100:900]).all() and len(reader.read(5, 5)) == 0


def test_packed_files_hold_the_corpus_in_order(spark, tokenizer):
    rows = [(i * 3 % 50, t) for i, t in enumerate(HARD)] + [(None, "a"), (7000, "same"), (7000, "same")]
    got = sorted(packing.packing_digest(spark, frame(spark, rows)).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    known = dict(rows)
    for r in got:
        ids = tokenizer.encode(known[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert packing.packing_digest(spark, frame(spark, [])).count() == 0


# near-duplicates


def fingerprint_by_hand(text):
    import xxhash
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_miss_no_link():
    own = simhash.golay_tables()
    assert (np.bincount(own) == 2048).all()
    rng = np.random.default_rng(5)
    left = rng.integers(0, 2**64, 400, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for k in rng.integers(1, 5, 400)]
    both = np.concatenate([left, left ^ np.array(flips, np.uint64)])
    key, row = simhash._keys(both)
    order = np.argsort(key, kind="stable")
    a, b = simhash.link_sorted(key[order], both[row[order]])
    assert {frozenset((int(x), int(y))) for x, y in zip(left, both[400:])} <= {frozenset((int(x), int(y))) for x, y in zip(a, b)}


def test_near_duplicates_equal_all_pairs(spark):
    pick = random.Random(6)
    rows = [(-5, None), (3, ""), (4, "  x"), (8, "A b"), (9, "a B"), (9, "a B")]
    for g in range(12):
        words = [pick.choice("the of and to in was for with her his Über nOt".split()) + str(pick.randint(0, 99)) for _ in range(300)]
        for c in range(8):
            copy = list(words)
            for _ in range(c):
                copy[pick.randrange(300)] = "x"
            rows.append((100 * g + 10 + c, " ".join(copy)))
    marks = [fingerprint_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    want = sorted((r[0], f"{m:016x}", least[find(i)]) for i, (r, m) in enumerate(zip(rows, marks)))
    assert sorted(tuple(r) for r in simhash.near_duplicates(frame(spark, rows)).collect()) == want
    kept = sorted(r.doc_id for r in simhash.deduplicated(frame(spark, rows)).collect())
    assert kept == sorted(d for d, _, c in want if d == c)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_long_runs_are_linked_without_pairs():
    chain = np.array([(1 << i) - 1 for i in range(0, 64, 4)], np.uint64)
    group = np.array([1 << i for i in range(40)], np.uint64) ^ np.uint64(0xF0F0F0F0F0F0F0F0)
    edges = simhash.spanning_edges(np.concatenate([chain, group]))
    assert len(edges) == len(chain) + len(group) - 2


# passages and lines


def passages_by_hand(rows):
    first, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 19):
            key = tuple(words[i:i + 20])
            if key in first:
                gone.update(range(i, i + 20))
            first.add(key)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings_equal_brute_force(spark):
    pick = random.Random(7)
    letters = lambda n: [pick.choice("abcdefgh") for _ in range(n)]
    base, rows = letters(300), []
    for i in range(50):
        words = letters(pick.randint(0, 50))
        for _ in range(pick.randint(0, 3)):
            at = pick.randint(0, 260)
            words += base[at:at + pick.randint(5, 60)] + letters(pick.randint(0, 8))
        rows.append((3 * i, " \t".join(["x"] * 70 if i % 9 == 8 else words)))
    rows += [(900, None), (901, ""), (902, rows[4][1]), (903, rows[4][1] + " tail"), (904, "é🎉 " * 45)]
    want = passages_by_hand(rows)
    got = substring.substring_digest(spark, frame(spark, [*rows, rows[3]])).collect()
    assert len(got) == len(rows) + 1
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)
    assert substring.substring_digest(spark, frame(spark, [])).count() == 0
    assert [r.n_removed for r in substring.without_repeats(frame(spark, [(None, "a " * 19), (None, "b")])).collect()] == [0, 0]


def lines_by_hand(rows, need=linededup.MIN_WORDS):
    known, first, out = dict(rows), set(), {}
    for doc_id in sorted(known):
        lines = (known[doc_id] or "").split("\n")
        run = [(n, x, len(WORD.findall(x))) for n, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for a in range(len(run)):
            key, words = (), 0
            for b in range(a, len(run)):
                key, words = (*key, run[b][1]), words + run[b][2]
                if key in first and words >= need:
                    gone.update(n for n, _, _ in run[a:b + 1])
                first.add(key)
        kept = "\n".join(x for n, x in enumerate(lines) if n not in gone)
        out[doc_id] = (0 if known[doc_id] is None else len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_line_runs_equal_brute_force(spark):
    pick = random.Random(9)
    pool = [" ".join(pick.choice("abcdef") for _ in range(pick.choice([1, 2, 3, 4, 12]))) for _ in range(8)] + ["", "  "]
    rows = [(2 * i, "\n".join(pick.choice(pool) for _ in range(pick.randint(0, 9)))) for i in range(30)]
    rows += [(900, None), (901, ""), (902, rows[4][1]), (903, rows[4][1] + "\ntail")]
    want = lines_by_hand(rows)
    got = linededup.line_digest(frame(spark, [*rows, rows[5]])).collect()
    assert len(got) == len(rows) + 1
    assert all((r.n_lines, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)
    docs = frame(spark, [(1, "a " * 12, 24, 5), (2, "a " * 12 + "\nb", 26, 6), (None, None, None, None)], "doc_id long, text string, n_chars long, row int")
    cleaned = sorted(linededup.cleaned(docs).collect(), key=str)
    assert sorted(map(tuple, cleaned), key=str) == sorted([(1, "a " * 12, 24, 5), (2, "b", 1, 6), (None, None, None, None)], key=str)


def test_short_repeated_lines_lose_their_later_copies(spark):
    rows = [(1, "one\nfirst two\nsolo"), (2, "first two\n\nown line\none"), (3, "one\none\nlast")]
    assert linededup.MIN_WORDS == 1
    kept = {r.doc_id: r.text for r in linededup.cleaned(frame(spark, rows)).collect()}
    assert kept == {1: rows[0][1], 2: "\nown line", 3: "last"}
    ten = {r.doc_id: r.text for r in linededup.cleaned(frame(spark, rows), min_words=10).collect()}
    assert ten == dict(rows)


# personal data


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_by_hand(text):
    def holds(kind, value):
        digits = [int(c) for c in value if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            doubled = [d if n % 2 == 0 else sum(divmod(2 * d, 10)) for n, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if holds(k, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_personal_data_base_spans_and_discovery(spark):
    pieces = ["a", "@", ".", "1", "23", "4", " ", "-", "+", "(", ")", "é🎉", "b.c", "x@y.z", "_", "\n", "4111111111111111", "+1415555"]
    texts = [None, "", "a@b.c_d@e.f.g 1.2.3.4.5.6.7.8", "🎉 +1 (415) 555-0199, 4111 1111 1111 1111 and 4111111111111112", "0.0.0.255 256.1.1.1 0000001.2.3.4",
             "1" * 30000 + "@", "a." * 9000 + "@x" + ".y" * 9000] + noise(2, pieces, 150)
    texts += [f"please write account number user{i}@mail.org today" for i in range(7)] + [f"please write account number A{i}-77{i} today" for i in range(3)]
    rows = list(enumerate(texts)) + [(None, "x@y.z"), (2, texts[2])]
    known, added = dict(rows), []
    got = pii.pii_digest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = spans_by_hand(known[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in base) for k in BASE)
        spans = [s for s in r.spans.split(",") if s]
        assert set(base) <= set(spans)
        added += [known[r.doc_id][int(s.split(":")[1]):int(s.split(":")[2])] for s in spans if s not in base]
    assert sorted(added) == [f"A{i}-77{i}" for i in range(3)]
    assert pii.pii_digest(frame(spark, [])).count() == 0


# nearest neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(20, 16))
    data = np.concatenate([centers[rng.integers(0, 20, 900)] + 0.4 * rng.normal(size=(900, 16)), rng.normal(size=(600, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(5000 + i, data[7].tolist()) for i in range(60)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (None, [1.0] * 16), (0, data[0].tolist())]
    table = frame(spark, rows + odd, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.ann_digest(table).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids = np.array([r[0] for r in rows])
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[at]
        score[at] = -9
        best = np.lexsort((ids, -np.round(score, 12)))[:5]
        found = sorted(got[ids[at]])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s - score[list(ids).index(v)]) < 1e-12 for _, v, s in found)
        hits += len(set(ids[best]) & {v for _, v, _ in found})
        total += 5
    assert hits / total >= 0.9 and set(got) == {int(i) for i in ids if i % 50 == 0}
    assert [v for _, v, _ in sorted(got[5000])] == [7, 5001, 5002, 5003, 5004]
    few = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in ann.ann_digest(few).collect()] == [(0, 1, 1)]
    assert ann.ann_digest(table.limit(0)).count() == 0


# toxicity


def test_toxicity_learns_from_two_folds(spark):
    pick = random.Random(12)
    syllables = "an er in th ti ea re ou st nd he ha wh sh ly".split()
    word = lambda: "".join(pick.choice(syllables) for _ in range(pick.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        words, toxic = [word() for _ in range(pick.randint(20, 80))], int(i % 5 == 0)
        for _ in range(5 * toxic):
            words.insert(pick.randrange(len(words)), pick.choice(["wretched", "moronic", "despicable", "vermin"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(2000, None), (2001, ""), (None, "the"), (0, rows[0][1])]
    docs, marks = frame(spark, rows), frame(spark, [*labels, (5000, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_digest(spark, docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, dict(labels)[r.doc_id]) for r in got if r.held_out and r.doc_id in dict(labels)]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    none = toxicity.toxicity_digest(spark, docs, frame(spark, [], "doc_id long, toxic int"))
    assert {r.score for r in none.collect()} == {0.0}


def test_toxicity_finds_stems_whose_endings_are_rare(spark):
    pick = random.Random(21)
    ours, theirs = "an er in th ti ea re ou st nd he ha wh sh ly".split(), "ung keit lich sch ein ver zu pf tz be ge ie ach".split()
    rows, toxic = [], set()
    for i in range(3000):
        other = i % 2
        word = lambda most=4: "".join(pick.choice(theirs if other else ours) for _ in range(pick.randint(1, most)))  # noqa: E731, B023
        words = [word() for _ in range(pick.randint(40, 120))]
        if pick.random() < 0.2:
            toxic.add(i)
            for _ in range(6):
                bad = pick.choice(["lowei", "lostra"]) + word(2) if other else pick.choice(["wretched", "moronic", "vermin"])
                words.insert(pick.randrange(len(words)), bad + pick.choice(["", ",", "!"]))
        rows.append((i, " ".join(words)))
    marks = frame(spark, [(i, int(i in toxic)) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_digest(spark, frame(spark, rows), marks).collect() if r.held_out}
    for other in (0, 1):
        caught = [got[i] for i in got if i in toxic and i % 2 == other]
        left = [1 - got[i] for i in got if i not in toxic and i % 2 == other]
        assert sum(caught) >= 0.8 * len(caught) and sum(left) >= 0.98 * len(left)
    again = toxicity.toxicity_digest(spark, frame(spark, rows).repartition(7), marks.repartition(3)).collect()
    assert {r.doc_id: r.predicted for r in again if r.held_out} == got


# the pipeline


def test_pipeline_stages_follow_brute_force(spark, tmp_path):
    import corpus_pipeline
    pick = random.Random(13)
    line = lambda: " ".join(pick.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(pick.randint(0, 999)) for _ in range(12))
    shared = line()
    rows = []
    for i in range(60):
        text = "\n".join([line() for _ in range(3)] + [shared] * (i % 4 == 0))
        rows.append((i, "too short" if i % 10 == 9 else text, "en", f"s{i % 3}", len(text)))
    rows += [(100 + i, rows[i][1].replace("\n", " "), "en", "s0", 0) for i in range(1, 4)] + [(200, None, None, None, None)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mix sources", "encode"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if len(WORD.findall(r[1] or "")) >= 10)
    lines = stage["line dedup"](spark, kept, str(tmp_path)).collect()
    want = lines_by_hand([(r.doc_id, r.text) for r in kept.collect()])
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2] for r in lines)
    near = stage["near dedup"](spark, frame(spark, lines, docs.schema), str(tmp_path)).collect()
    assert not {r.doc_id for r in near} & {101, 102, 103}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} <= {r.doc_id for r in near} and all(r.round_trip and r.n_tokens == len(r.ids) for r in final)
    total = sum(len(WORD.findall(r.text)) for r in near)
    assert abs(sum(len(WORD.findall(r.text)) for r in final) - total) <= 3


def test_packing_encodes_words_once_with_and_without_their_mark(monkeypatch):
    """Odd texts have the ids of the tokenizers library, and a mark behind a word is no second piece to encode."""
    import random
    from tokenizers import Tokenizer
    from tracewell.llm import bpe, packing
    raw = bpe.tokenizer_text()
    library, rnd = Tokenizer.from_str(raw), random.Random(7)
    parts = ["a", "b", "'s", " ", "  ", "\n", "\n\n", "\t", ".", ",", "é", "中", "1", "<|endoftext|>", "　", "\x85", "\x1c", "\U0001f600", " the", "٣", "x.", "' "]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(3000)]
    assert [a.tolist() for a in packing.Pieces(raw).arrays(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    asked, real = [], packing.encode_many
    monkeypatch.setattr(packing, "encode_many", lambda tokenizer, texts, *more: asked.extend(texts) or real(tokenizer, texts, *more))
    list(packing.Pieces(raw).arrays(["lorem ipsum, lorem ipsum. dolor ipsum"]))
    assert sorted(asked) == [" dolor", " ipsum", " lorem", "lorem"]


def test_encoded_hands_back_few_ids_at_once(spark, monkeypatch):
    """A batch of many texts goes back in runs of bounded text, all rows in order, null texts too."""
    import pandas as pd
    from tracewell.llm import bpe
    batch = pd.DataFrame({"doc_id": range(9), "text": ["ab " * 5, None, "", "x" * 100, "y", "z " * 30, None, "w" * 40, "v"]})
    parts = list(bpe.slices(batch, "text", 60))
    assert pd.concat(parts).equals(batch) and len(parts) > 3 and all(p["text"].fillna("").str.len()[1:].sum() <= 60 for p in parts)
    assert list(bpe.slices(batch[:0], "text")) == []
    rows = bpe.encoded(spark.createDataFrame(batch.astype(object).where(batch.notna(), None), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(9)) and all(r["round_trip"] or r["text"] is None for r in rows)
