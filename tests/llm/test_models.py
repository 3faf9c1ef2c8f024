"""Quality classifier and toxicity grammar: held-out accuracy, edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.llm import common, quality, toxicity_grammar as tox

SF = "/root/testdata/sf0.1"


def test_word_spans_and_hashes_do_not_depend_on_place():
    texts = ["one two\tone", "", "two one\n", " é one", "one"]
    data, offs = common.text_bytes(pa.array(texts))
    s, e = common.word_spans(data, offs)
    words = [bytes(data[a:b]).decode() for a, b in zip(s, e)]
    assert words == [w for t in texts for w in t.split()]
    h = common.span_hashes(data, s, e)
    assert len({*h.tolist()}) == len({*words}) and len({*zip(words, h.tolist())}) == len({*words})


@pytest.mark.parametrize("most", [3, 7, 50, 1000])
def test_pieces_keep_words_whole(most):
    texts = ["aa bbb cccc dd", "", "x" * 40 + " y", " lead", "a  b   c", "trail "]
    data, offs = common.text_bytes(pa.array(texts))
    got = {k: [] for k in range(len(texts))}
    for first, part, o in common.pieces(data, offs, most):
        s, e = common.word_spans(part, o)
        for a, b, t in zip(s, e, np.searchsorted(o, s, "right") - 1):
            got[first + t].append(bytes(part[a:b]).decode())
    assert [got[k] for k in got] == [t.split() for t in texts]


def _accuracy(scored, labels, name, held):
    r = scored.join(labels, "doc_id").where(held).select("score", F.col(name).alias("y")).toPandas()
    p = r["score"] >= 0.7
    return (p & (r["y"] == 1)).sum() / max(1, p.sum()), (p & (r["y"] == 1)).sum() / (r["y"] == 1).sum(), (~p & (r["y"] == 0)).sum() / (r["y"] == 0).sum()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    precision, recall, rejected = _accuracy(quality.score_quality(docs, model), labels, "quality", common.crc_of_id() % 4 == 2)
    assert precision > 0.98 and recall > 0.98 and rejected > 0.9


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit_grammar(docs, labels)
    precision, recall, _ = _accuracy(tox.score_toxicity(docs, model), labels, "toxic", common.crc_of_id() % 3 == 1)
    assert precision > 0.9 and recall > 0.75


def test_clauses_not_words_decide():
    texts = ["you idiot", "an idiot", "you are no idiot", "he said you idiot", "kill the lights", "I will kill you. idiot",
             "no. idiot", None, "", "the Idiot you are", "I will not kill you", "no idiot like you"]
    m, _ = tox.marks(pa.array(texts, pa.string()), tox.lexicon())
    want = [["insult_at"], ["insult"], ["insult_negated"], ["insult_reported"], [], ["threat_at", "insult"], ["insult"], [], [],
            ["insult_at"], ["threat_negated"], ["insult_negated"]]
    assert [sorted(k for k, n in zip(tox.MARKS, r) if n) for r in m] == [sorted(w) for w in want]


KINDS = {tox.INSULT: "insult", tox.SLIGHT: "slight", tox.THREAT: "threat"}


def _plain_marks(kinds):
    """Marks of one clause, word by word and without machines."""
    reach, found = tox.REACH, {}
    near = lambda i, k: any(kinds[j] == k for j in range(max(0, i - reach), i))
    for i, k in enumerate(kinds):
        if k in KINDS:
            later = next((j for j in range(i + 1, len(kinds)) if kinds[j] == tox.TARGET or kinds[j] in KINDS), len(kinds))
            aimed = near(i, tox.TARGET) or later < len(kinds) and kinds[later] == tox.TARGET and later - i <= reach
            at = i if k != tox.THREAT or near(i, tox.TARGET) else later  # a threat counts where it meets its target
            if k == tox.THREAT and not aimed:
                continue
            if tox.REPORT in kinds[:i] or (k == tox.THREAT and tox.REPORT in kinds[:at]):
                end = "_reported"
            elif near(i, tox.NEGATION):
                end = "_negated"
            elif aimed and tox.REPORT in kinds[i:later] and not near(i, tox.TARGET):
                end = ""  # "idiot, he said to you": the target belongs to the report
            else:
                end = "_at" if aimed else ""
            found[KINDS[k] + end] = found.get(KINDS[k] + end, 0) + 1
    return found


def test_marks_and_paths_equal_a_plain_version():
    rng = np.random.default_rng(3)
    names = {tox.OTHER: "thing", tox.INSULT: "idiot", tox.SLIGHT: "meh", tox.THREAT: "kill", tox.TARGET: "you",
             tox.NEGATION: "no", tox.REPORT: "said"}
    clauses = [rng.choice(7, rng.integers(1, 12), p=[.4, .15, .1, .1, .1, .1, .05]).tolist() for _ in range(3000)]
    weight = tox.PRIOR | {"insult": 3.25, "slight_at": 2.75, "threat_negated": 0.125}
    m, total = tox.marks(pa.array([" ".join(names[k] for k in c) for c in clauses]), tox.lexicon(slights=["meh"]), weight)
    for c, row, t in zip(clauses, m, total):
        want = _plain_marks(c)
        assert {k: n for k, n in zip(tox.MARKS, row) if n} == want, c
        assert abs(t - sum(weight[k] * n for k, n in want.items())) < 1e-9


def test_fitted_weights_follow_the_grammar(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit_grammar(docs, labels)
    texts = ["you idiot", "an idiot", "you are no idiot", "he said you idiot", "I will kill you", "I will not kill you", "kill the lights"]
    _, t = tox.marks(pa.array(texts), model.words, model.weights)
    assert t[0] > t[1] > max(t[2], t[3]) and t[4] > t[1] > t[5] and t[6] == 0
    assert any(w for *_, w in tox.grammar(model.weights).arcs.values())


def test_a_hot_id_is_one_row_of_the_fit(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame([(4, "a you fool good"), (5, "x bad bad words"), (8, None)], "doc_id long, text string")
    often = once.unionByName(once.where("doc_id = 4").crossJoin(spark.range(2000)).select("doc_id", "text"))
    a, b = (quality.fit_quality(d, labels, held_out=False) for d in (once, often))
    assert np.array_equal(a.gain, b.gain) and a.bias == b.bias
    a, b = (tox.fit_grammar(d, labels, held_out=False, least=1) for d in (once, often))
    assert a == b
    few = quality.fit_quality(once, labels, held_out=False, max_pairs=1)  # the first document, whole
    assert not np.array_equal(few.gain, quality.fit_quality(once, labels, held_out=False).gain)


def test_scores_equal_a_plain_average():
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.25)
    texts = ["one two two three", "", None, "é ü", "a", "b  c\td"]
    got = quality._scores(pa.array(texts), model)
    for t, g in zip(texts, got):
        data, offs = common.text_bytes(pa.array([t or ""]))
        found = np.concatenate([k for k, _ in quality.grams(data, offs)])
        words = (t or "").split()
        chars = sum(sum(not any(c.isspace() for c in p[1:-1]) for p in
                        ((t or "")[i:i + n] for i in range(len(t or "") - n + 1))) for n in quality.NGRAMS)
        assert len(found) == len(words) + max(0, len(words) - 1) + sum(x == y for x, y in zip(words, words[1:])) + chars
        mean = model.gain[found].astype(float).mean() if len(found) else 0.0
        assert abs(g - 1 / (1 + np.exp(-mean - 0.25))) < 1e-6


def test_composition_is_running_one_after_the_other():
    a = tox.Transducer({(0, "x"): (1, "y", 1.0), (1, "x"): (0, "z", 0.0)})
    b = tox.Transducer({(0, "y"): (0, "Y", 0.5), (0, "z"): (0, "Z", 0.25)})
    assert a.then(b).run("xxx") == [("Y", 1.5), ("Z", 0.25), ("Y", 1.5)]


def test_odd_rows_have_scores(spark, frame, odd_rows):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(odd_rows)
    for out in (quality.score_quality(docs, quality.fit_quality(docs, labels)), tox.score_toxicity(docs, tox.fit_grammar(docs, labels))):
        rows = out.select("doc_id", "score").collect()
        assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.where("false")
    assert quality.score_quality(docs.where("false"), quality.fit_quality(docs.where("false"), none)).count() == 0
    assert tox.score_toxicity(docs.where("false"), tox.fit_grammar(docs.where("false"), none)).count() == 0


def test_crc_of_id(spark):
    df = spark.createDataFrame([(5,), (None,), (-12,)], "doc_id long").withColumn("c", common.crc_of_id())
    assert [r["c"] for r in df.collect()] == [zlib.crc32(b"5"), 0, zlib.crc32(b"-12")]
