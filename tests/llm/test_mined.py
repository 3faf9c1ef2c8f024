"""Phrase collocations, Lempel-Ziv fingerprints and pivot clusters: against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.llm import lz_fingerprint, phrases, pivot_kmeans


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _collocations(rows, floor, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", _lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if a >= floor and len(p) > 2}
    out = []
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        if any(len(q) > len(p) and q[0] == lang and 100 * b >= 80 * a and
               any(q[1 + i:1 + i + len(w)] == w for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
            continue
        score, k = min((2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]], n[lang]))
    rank, got = Counter(), []
    for lang, score, a, p, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, total, -score))
    return got


def _rows(rnd, n):
    words = "the of and naïve Mit license É 日本 x-y a b c d".split()
    return [(rnd.choice(["en", "en", "de", None, "und"]),
             "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rnd.randint(0, 60))))
            for _ in range(n)]


@pytest.mark.parametrize("sample,bits", [(4, 1 << 27), (50, 1 << 18), (1, 1 << 18)])
def test_collocations_against_brute_force(spark, frame, monkeypatch, sample, bits):
    """Good samples, poor ones whose border fails often, and the whole table as the sample."""
    monkeypatch.setattr(phrases, "SAMPLE", sample)
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    rows = _rows(random.Random(sample), 250)
    rows += [("en", rows[0][1])] * 5 + [("fr", None), ("fr", ""), (None, " . ,"), ("en", "a" * 3000 + " b c " + "a" * 3000)]
    docs = spark.createDataFrame([(i % 7 or None, t, g, "x") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, w1 string")
    got = [tuple(r) for r in phrases.collocations(docs, top=25, floor=6).collect()]
    want = _collocations(rows, 6, 25)
    assert len(want) > 60 and sorted(got) == sorted(want)
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(docs.select("lang", "text"), floor=10_000).count() == 0


def test_collocations_without_a_proposal(spark):
    """What is frequent over all rows but in no sample is found by the further passes."""
    docs = spark.createDataFrame([("en", "one two three four five")] * 40, "lang string, text string")
    marked = docs.selectExpr("lang", "text", f"pmod(xxhash64(text), {phrases.SAMPLE}) = 0 as p").first()["p"]
    text = next(t for i in range(99) if not spark.createDataFrame([(f"one two three four v{i}",)], "t string").selectExpr(
        f"pmod(xxhash64(t), {phrases.SAMPLE}) = 0").first()[0] for t in [f"one two three four v{i}"]) if marked else "one two three four five"
    got = phrases.collocations(spark.createDataFrame([("en", text)] * 40, "lang string, text string")).collect()
    assert [tuple(r) for r in got] == _collocations([("en", text)] * 40, 30, 2000)


def test_words_of_a_long_text_come_in_parts():
    rnd = random.Random(3)
    text = "".join(rnd.choice(["ab", "c", "Dé", "long" * 30]) + rnd.choice([" ", " ", "\t \t", "  .", "\n "]) for _ in range(150_000))
    texts = ["x y", "", text, "a b. c"]
    data, offsets = phrases.text_bytes(pa.array(texts))
    count = phrases._Counter(phrases.Marks(np.full(1024, 255, np.uint8)), None, 2, False)
    n = 0
    for w, first, begun, *_ in phrases._words(data, offsets, ["en"] * 4):
        n += len(w)
        count.add(np.concatenate([begun, w]), np.concatenate([np.arange(len(begun)) == 0, first]), len(begun))
    total = sum(int(c[3].sum()) for c in count.phrases())
    pieces = [re.findall("[^ \t]+", p) for t in texts for p in re.split("[.,;:!?\n-\r]", t)]
    assert n == sum(map(len, pieces)) and total == sum(max(0, len(p) - 1) for p in pieces)


def test_counts_are_sent_in_small_rows():
    """However few the ranges are, rows and batches of counts stay small, and every count arrives."""
    rng = np.random.default_rng(2)
    cols = [rng.integers(1, 1 << 63, 100_000, np.uint64) for _ in range(2)]
    counts = phrases.summed(None, cols, None, np.arange(1, 100_001))
    words = phrases.summed("en", cols[:1], [b"word%d" % i for i in range(100_000)], np.full(100_000, 3))
    rows = list(phrases._pack([counts, words], 2))
    assert max(len(b) for _, b in rows) < 4 * 32_768
    got = {None: {}, "en": {}}
    for i, data in rows:
        for lang, c, names, n in phrases._unpack(data):
            assert (phrases.phrase_hash(c) >> np.uint64(63) == i).all()
            got[lang].update(zip(zip(*(x.tolist() for x in c), names or [None] * len(n)), n.tolist()))
    assert got[None] == dict(zip(zip(*(x.tolist() for x in counts[1]), [None] * 100_000), counts[3].tolist()))
    assert got["en"] == dict(zip(zip(words[1][0].tolist(), words[2]), words[3].tolist()))
    batches = list(phrases._batches(rows))
    assert [b for x in batches for b in x.column("counts").to_pylist()] == [b for _, b in rows]
    assert max(x.nbytes for x in batches) < 2 * phrases._BATCH


def test_marks_never_miss(spark):
    rnd = random.Random(1)
    rows = list({tuple(rnd.randrange(1, 40) if j < k else 0 for j in range(4)) for k in (1, 2, 3, 4) for _ in range(200)})
    marks = phrases.Marks(phrases._marks(spark.createDataFrame(rows, "w1 long, w2 long, w3 long, w4 long")).value)
    for r in rows:
        assert marks.has(phrase_of(r)).all()
    others = [tuple(rnd.randrange(50, 90) for _ in range(4)) for _ in range(500)]
    assert sum(marks.has(phrase_of(r))[0] for r in others) < 50


def phrase_of(row):
    return phrases.phrase_hash([np.array([w], np.int64).view(np.uint64) for w in row if w])


def _phrases(data):
    """The dictionary of a text, by its definition."""
    known, at = set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in known:
            known.add(data[at:end])
            at = end
    return known


def test_phrases_are_those_of_lz78(monkeypatch):
    rnd = random.Random(2)
    for block in (lz_fingerprint.BLOCK, 64):
        monkeypatch.setattr(lz_fingerprint, "BLOCK", block)
        for n in (0, 1, 5, 63, 64, 65, 700):
            text = "".join(rnd.choices("ab né日", k=n))
            data = text.encode()
            parsed = lz_fingerprint.Document(text).whole
            assert b"".join(b for b, _ in parsed.blocks()) == data
            for part, keys in parsed.blocks():
                h, _ = lz_fingerprint.phrase_hashes([(part, keys)])
                want = _phrases(part)
                assert len(h) == len(set(h.tolist())) == len(want)
                one = {int(lz_fingerprint.span_hashes(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0]) for p in want}
                assert one == set(h.tolist())


def _follow(rows):
    """(doc_id, text, next text) by the rule: ids ascending, none last, then hash of the text."""
    return [(d, t, rows[(i + 1) % len(rows)][1]) for i, (d, t) in enumerate(rows)]


def test_edited_fingerprints_against_brute_force(spark, frame, odd_rows):
    rows = odd_rows + [(100 + i, "".join(random.Random(i % 37).choices("abc dé", k=i * 7 % 300)), "a") for i in range(300)]
    docs = frame(rows)
    got = Counter(tuple(r) for r in lz_fingerprint.edited_fingerprints(docs).collect())
    order = [(r["doc_id"], r["t"]) for r in docs.selectExpr("doc_id", "coalesce(text, '') t").selectExpr(
        "doc_id", "t", "xxhash64(t) h").orderBy(F.col("doc_id").asc_nulls_last(), "h").collect()]
    name = lambda t: lz_fingerprint.fingerprint_texts([lz_fingerprint.Parsed().feed(t).blocks()])[0]
    want = Counter()
    for d, t, after in _follow(order):
        q = len(t) // 4
        e = t[:len(t) - q] + after[:q]
        a, b, c = name(t), name(e), name(after)
        want[d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c)] += 1
    assert got == want
    one = Counter(tuple(r) for r in lz_fingerprint.fingerprints(docs).collect())
    assert one == Counter((d, len(t or ""), name(t or "")) for d, t, _ in rows)
    assert lz_fingerprint.edited_fingerprints(docs.where("false")).count() == 0


def test_a_row_that_repeats_follows_itself(frame):
    text = "the same text again and again, and one more time"
    got = Counter(tuple(r)[:2] + tuple(r)[5:] for r in lz_fingerprint.edited_fingerprints(
        frame([(5, text, "a")] * 3000 + [(6, "zzzz yyyy xxxx", "b")])).collect())
    assert sum(got.values()) == 3001 and len(got) == 3 and max(got.values()) == 2999
    alone = lz_fingerprint.edited_fingerprints(frame([(None, "abcdefgh", "a")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1 and alone[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_likeness_follows_shared_text():
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(400)]
    text = " ".join(rnd.choices(words, k=600))
    other = "".join(rnd.choices("klmnopqrst ", k=3000))
    names = lz_fingerprint.fingerprint_texts([lz_fingerprint.Parsed().feed(t).blocks() for t in (
        text, text, text[:2400] + other[:600], text[:600] + other[:2400], other, "")])
    near = [lz_fingerprint.likeness(names[0], n) for n in names[1:]]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] >= near[4] == 0
    a, b = (_phrases(t.encode()) for t in (text, text[:2400] + other[:600]))
    assert abs(near[1] - len(a & b) / len(a | b)) < 0.13


def _clusters(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    name = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [r[1] for r in sorted(kept, key=name)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, got) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    got = assign()
    each = Counter()
    for d, c in got:
        each[c] += d
    return Counter((i, c, d, each[c], sum(each.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, got))


def test_clusters_against_brute_force(spark):
    rnd = random.Random(8)
    centers = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, 0.4) for x in rnd.choice(centers)]) for i in range(400)]
    rows += [(7, rows[0][1])] * 30 + [(None, rows[1][1]), (None, [0.0] * 6), (900, None), (901, []), (902, [1.0] * 5), (903, [None] + [1.0] * 5),
                                      (904, [float("nan")] * 6), (905, [float("inf")] * 6), (906, [-100.0, 100.0, 0.0, 0.0, 0.0, 0.0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string")
    for k, rounds in ((8, 10), (3, 1), (500, 2)):
        assert Counter(tuple(r) for r in pivot_kmeans.centroid_clusters(docs, k, rounds, 6).collect()) == _clusters(rows, k, rounds, 6)
    empty = pivot_kmeans.centroid_clusters(docs.where("vec_id >= 900 and vec_id < 906"), 8, 10, 6)
    assert empty.count() == 0 and empty.columns == pivot_kmeans.centroid_clusters(docs, 2, 1, 6).columns
    huge = pivot_kmeans.centroid_clusters(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>"), 1, 1, 2)
    assert {r["distance"] for r in huge.collect()} == {(1 << 27) ** 2}


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(4)
    centers = rng.integers(-3000, 3000, (8, 16))
    x = centers[rng.integers(8, size=3000)] + rng.integers(-200, 200, (3000, 16))
    pivots = [c.tolist() for c in x[:8]]
    near = pivot_kmeans.Nearest((centers + 5).tolist(), pivots)
    far = np.stack([np.sqrt(pivot_kmeans.squared(x, np.array(p)).astype(float)) for p in pivots], axis=1)
    true = np.stack([pivot_kmeans.squared(x, c) for c in near.centroids], axis=1)
    assert (near.bounds(far) <= true).all()
    best, least, measured = near.assign(x, far)
    assert (least == true.min(axis=1)).all() and (best == true.argmin(axis=1)).all()
    assert measured < 0.6 * true.size
