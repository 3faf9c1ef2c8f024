"""Licence scan, near-duplicate vectors, Jaccard join, repeated spans, components: against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from askloom.llm import components, jaccard_join, licenses, spans, vector_neardup
from tests.llm.conftest import WORD


def _groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)]
    pairs += [(500, 500 + i) for i in range(1, 80)] + [(3, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(
        spark.createDataFrame(pairs + [(None, 4)], "u long, v long")).collect()}
    want = _groups(600, pairs)
    assert all(got.get(i, i) == want[i] for i in range(600))
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    a, b = np.array(pairs).T
    assert components.forest(600, a, b).tolist() == want


def _license_base(text):
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [k for k in range(len(w)) if w[k:k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_columns(frame, odd_rows):
    rnd = random.Random(3)
    words = "under the mit license Apache version 2 cc by nc CC-BY-NC é 0 of".split()
    rows = odd_rows + [(100 + i, " ".join(rnd.choices(words, k=rnd.randint(0, 60))), "a") for i in range(300)]
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                  for r in licenses.license_columns(licenses.scan_licenses(frame(rows))).collect())
    assert got == Counter((d, *_license_base(t)) for d, t, _ in rows)


def test_license_templates_survive_small_edits(frame):
    text = dict((l, t) for l, t in reversed(licenses.TEMPLATES) if l in ("mit", "bsd"))
    w = text["mit"].split()
    rows = [(1, "intro " + " ".join(w[:20] + ["(EDITED)"] + w[21:]) + " outro", "a"), (2, " ".join(w[:8]), "a"),
            (3, text["bsd"].upper(), "a"), (4, "the software is free of charge", "a")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(rows)).collect()}
    assert got[1]["labels"] == "mit" and 0.9 < got[1]["score"] < 1 and got[1]["spans"][0]["first"] == 1
    assert got[2]["labels"] == "" and got[3]["labels"] == "bsd" and got[3]["score"] == 1 and got[4]["labels"] == ""
    assert licenses.scan_licenses(frame([])).count() == 0


def test_license_notice_repeated_gives_every_span(frame):
    """Notices apart, back to back, edited, cut off at the start of another one; and very many of them."""
    w = [t.split() for l, t in licenses.TEMPLATES if l == "mit"][0]
    edited, part = w[:20] + ["edited"] + w[21:], w[:15]
    apart = ["x"] * 9
    text = w + apart + edited + w + w + part + w + apart + part
    starts = np.cumsum([0, len(w) + 9, len(w), len(w), len(w) + len(part)]).tolist()
    rows = [(1, " ".join(text), "a"), (2, " ".join((w + ["y"]) * 5000), "a")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(rows)).collect()}
    assert [(s["first"], s["past"], s["covered"]) for s in got[1]["spans"]] == [
        (a, a + len(w), len(w) - (k == 1)) for k, a in enumerate(starts)]
    assert [s["first"] for s in got[2]["spans"]] == [k * (len(w) + 1) for k in range(5000)]
    assert all(r["labels"] == "mit" and r["score"] == 1 for r in got.values())


def test_related_licenses_are_told_apart(frame):
    gnu = ("This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License "
           "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
    only = ("This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License "
            "version {} as published by the Free Software Foundation.")
    late = only.replace(" version {}", "").replace("Foundation.", "Foundation, version {}")
    cc = "This work is licensed under a Creative Commons Attribution{} International License."
    wants = []
    for label, what, name, v in [("gpl-2", "program", "", "2"), ("gpl-3", "file", "", "3"), ("lgpl-2", "library", "Library ", "2"),
                                 ("lgpl-2.1", "library", "Lesser ", "2.1"), ("lgpl-3", "program", "Lesser ", "3"),
                                 ("agpl-3", "program", "Affero ", "3")]:
        wants += [(label, form.format(what, name, v)) for form in (gnu, only, late + " of the License.", late + ".")]
        wants.append((label, f"This work is licensed under the GNU {name}General Public License version {v}"))
        wants.append((label, gnu.format(what, name, v).replace("redistribute it", "redistribute (EDITED) it").replace(", or", ", edited or")))
    wants += [("", gnu.format("program", "", "1")), ("gpl-2,lgpl-2.1", gnu.format("program", "", "2") + gnu.format("library", "Lesser ", "2.1"))]
    wants += [(label, cc.format(x)) for label, x in [
        ("cc-by", " 4.0"), ("cc-by-nc", "-NonCommercial 4.0"), ("cc-by-sa", "-ShareAlike 4.0"), ("cc-by-nd", "-NoDerivatives 4.0"),
        ("cc-by-nc-sa", "-NonCommercial-ShareAlike 4.0"), ("cc-by-nc-nd", "-NonCommercial-NoDerivatives 4.0"),
        ("cc-by", " 3.0"), ("cc-by-sa", "-ShareAlike 3.0")]]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(frame([(i, t, "a") for i, (_, t) in enumerate(wants)])).collect()}
    assert [(got[i], t) for i, (_, t) in enumerate(wants)] == wants


def test_matching_statistics_are_longest_matches():
    auto = licenses.Automaton([("x", "a b c a b d"), ("y", "b d e b")], {"a b": "p"})
    texts = [" ".join(t) + " " for t in (["a", "b", "c", "a", "b", "d"], ["b", "d", "e", "b"])]
    rnd = random.Random(1)
    for _ in range(200):
        words = rnd.choices(sorted(auto.ids), k=12)
        for i, (_, n) in enumerate(auto.statistics([auto.ids[w] for w in words])):
            fits = [k for k in range(i + 2) if any((" " + " ".join(words[i + 1 - k:i + 1]) + " ") in " " + t for t in texts) or k == 0]
            assert n == max(fits)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 24))
    rows = [(i, (base[rng.integers(30)] + rng.standard_normal(24) * rng.choice([0, 0.02, 0.08, 0.3])).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[5][1]) for i in range(50)] + [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [1.0] * 23 + [None]),
                                                          (3004, [float("nan")] + [1.0] * 23), (3005, [float("inf")] * 24), (3006, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, node string, n int")
    got = {r["vec_id"]: r for r in vector_neardup.near_duplicate_vectors(df).collect()}
    good = [r for r in rows if r[0] < 3000]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    mine = np.array([got[r[0]]["n_links"] for r in good])
    assert (mine <= links).all() and mine.sum() >= 0.99 * links.sum() and links.sum() > 1000
    root = _groups(len(good), zip(*np.nonzero(near)))
    assert np.mean([got[r[0]]["component_id"] == good[root[i]][0] for i, r in enumerate(good)]) > 0.99
    for i in range(3000, 3007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert vector_neardup.near_duplicate_vectors(df.where("false")).count() == 0


def test_vectors_of_a_large_bucket_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector_neardup, "BLOCK", 7)
    rows = [(i, [1.0, i * 1e-5, 0.0]) for i in range(60)] + [(60, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    got = vector_neardup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["n_links"] for r in got} == {61} and {r["component_id"] for r in got} == {0}


def _similar(rows):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    return pairs, _groups(len(rows), pairs)


@pytest.fixture
def near_rows():
    rnd = random.Random(6)
    rows = []
    for g in range(25):
        w = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([3, 5, 40, 120]))]
        for _ in range(rnd.choice([1, 2, 6, 12])):
            v = list(w)
            for _ in range(rnd.randint(0, 2)):
                v[rnd.randrange(len(v))] = f"e{rnd.randrange(50)}"
            rows.append((len(rows), rnd.choice(["", " "]) + " ".join(v), "a"))
    return rows + [(500, None, "a"), (501, " ", "a"), (502, rows[3][1], "a"), (503, rows[3][1], "a")]


@pytest.mark.parametrize("small", [512, 3])
def test_jaccard_join_against_brute_force(frame, near_rows, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    got = {r["doc_id"]: r for r in jaccard_join.similar_documents(frame(near_rows)).collect()}
    pairs, root = _similar(near_rows)
    links = Counter(i for p in pairs for i in p)
    for i, (d, _, _) in enumerate(near_rows):
        assert got[d]["n_links"] == links[i] and got[d]["class_id"] == near_rows[root[i]][0], d


def test_jaccard_join_of_odd_rows(frame, odd_rows):
    got = jaccard_join.similar_documents(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in got)
    # the two rows of doc 4, the one without id and the one with a tail are alike
    assert by[(4, 3, 4)] == 2 and by[(None, 3, 4)] == 1 and by[(5, 3, 4)] == 1 and by[(9, 1, 8)] == 1
    assert by[(1, 0, 1)] == 1 and by[(None, 0, None)] == 1
    assert jaccard_join.similar_documents(frame([])).count() == 0


def _repeats(rows):
    count = Counter(b[i:i + 200] for b in ((t or "").encode() for _, t, _ in rows) for i in range(len(b) - 199))
    out = Counter()
    for d, t, _ in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                cover[i] += 1
                cover[i + 200] -= 1
        gone = np.cumsum(cover)[:len(b)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[d, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize("largest", [1 << 15, 3])
def test_repeated_spans_against_brute_force(frame, monkeypatch, largest):
    monkeypatch.setattr(spans, "LARGEST", largest)
    rnd = random.Random(5)
    base = ["".join(rnd.choices("abc é\x00", k=rnd.randint(150, 900))) for _ in range(12)]
    rows = []
    for i in range(150):
        k = rnd.random()
        if k < 0.1:
            t = rnd.choice(base)
        elif k < 0.2:
            t = rnd.choice(["a", "xy z", "\x00"]) * rnd.randint(0, 900)
        elif k < 0.25:
            t = None
        else:
            t = "".join(rnd.choices("qwertyuiop \x00", k=rnd.randint(0, 300)))
            for _ in range(rnd.randint(1, 3)):
                b = rnd.choice(base)
                a = rnd.randint(0, len(b))
                t += b[a:a + rnd.randint(0, 500)] + rnd.choice(["", "\x00", "z", "ü"])
        rows.append((rnd.choice([None, i, i, i // 2]), t, "a"))
    assert Counter(tuple(r) for r in spans.repeat_digests(frame(rows)).collect()) == _repeats(rows)


def test_repeated_spans_of_odd_rows(frame, odd_rows):
    rows = [(d, t if len(t or "") < 50_000 else t[:40_000], s) for d, t, s in odd_rows]
    assert Counter(tuple(r) for r in spans.repeat_digests(frame(rows)).collect()) == _repeats(rows)
    assert spans.repeat_digests(frame([])).count() == 0


def test_long_texts_are_read_in_parts(monkeypatch):
    data = np.random.default_rng(1).integers(0, 4, 9000).astype(np.uint8)
    whole = spans.anchors(data)
    monkeypatch.setattr(spans, "_PART", 1000)
    place, first, last, _ = spans.anchors(data)
    anchor = np.zeros(9000 - spans.WINDOW + 1, int)
    for p, a, b in zip(place, first, last):
        anchor[a:b + 1] = p
    for p, a, b in zip(*whole[:3]):
        assert (anchor[a:b + 1] == p).all()


def test_rows_that_repeat_id_and_text_enter_a_tile_once(frame, monkeypatch):
    """A text many rows repeat, with and without an id, has near copies; its set must not be sent once a row."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:100 + k] + ["edited"] + words[101 + k:]) for k in range(4)]
    rows = [(1, texts[0], "a")] * 300 + [(None, texts[1], "b")] * 200 + [(3, texts[2], "a"), (4, texts[3], "a")]
    most, tiles_of = [], jaccard_join.over_tiles

    def seen(tiles, keys, *more):
        most.append(tiles.groupBy(*keys, "node").count().agg({"count": "max"}).first()[0])
        return tiles_of(tiles, keys, *more)
    monkeypatch.setattr(jaccard_join, "over_tiles", seen)
    got = jaccard_join.similar_documents(frame(rows)).collect()
    assert most[-1] == 1
    assert len(got) == 502 and {(r["n_links"], r["class_id"]) for r in got} == {(501, 1)}


def test_rows_of_a_group_of_near_copies_grow_with_its_size(frame, monkeypatch):
    """Links and tile rows follow the number of near copies, not its square, and none is lost."""
    links, rows = [], []
    stored_as, tiles_of = jaccard_join.stored, jaccard_join.over_tiles

    def kept(df, name):
        out = stored_as(df, name)
        links.append(out.count() if name == "links" else 0)
        return out

    def tiles(d, keys, *more):
        rows.append(d.count() if keys[0] == "path" else 0)
        return tiles_of(d, keys, *more)
    monkeypatch.setattr(jaccard_join, "stored", kept)
    monkeypatch.setattr(jaccard_join, "over_tiles", tiles)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    monkeypatch.setattr(jaccard_join, "SMALL", 32)
    words = [f"w{i}" for i in range(200)]
    for n in (128, 256, 512):
        links.clear()
        rows.clear()
        docs = frame([(i, " ".join(words[:i % 200] + [f"e{i}"] + words[i % 200 + 1:]), "a") for i in range(n)])
        assert {(r["n_links"], r["class_id"]) for r in jaccard_join.similar_documents(docs).collect()} == {(n - 1, 0)}
        assert sum(links) < 40 * n and sum(rows) < 120 * n, (n, links, rows)


def test_large_group_of_near_copies_takes_few_tables(frame, monkeypatch):
    """Every table written is a job over all partitions, however few its rows are."""
    made, stored_as = [], jaccard_join.stored

    def kept(df, name):
        made.append(name)
        return stored_as(df, name)
    monkeypatch.setattr(jaccard_join, "stored", kept)
    monkeypatch.setattr(components, "stored", kept)
    monkeypatch.setattr(jaccard_join, "SMALL", 32)
    words = [f"w{i}" for i in range(200)]
    docs = frame([(i, " ".join(words[:i % 200] + [f"e{i}"] + words[i % 200 + 1:]), "a") for i in range(256)])
    assert {(r["n_links"], r["class_id"]) for r in jaccard_join.similar_documents(docs).collect()} == {(255, 0)}
    assert len(made) < 30


def test_rounds_of_components_call_python_before_the_shuffle_only(spark):
    edges = spark.createDataFrame([(5, 1), (5, 2), (9, 5)], "u long, v long")
    plan = components._round(edges)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 2  # the same one on both sides of the join
