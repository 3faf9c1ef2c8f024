"""Mixing and quality rules."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm import mixing, rules
from tests.llm.conftest import WORD


def test_mix_equals_its_sql_on_odd_rows(frame, odd_rows):
    import duckdb

    docs = frame(odd_rows)
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841  read by name
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM documents")
    want = Counter(con.execute(mixing.ORACLE).fetchall())
    assert Counter(tuple(r) for r in mixing.mix_documents(docs).collect()) == want


def test_mix_comes_near_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "abcde"[(i * i) % 5] if i % 3 else "a") for i in range(3000)]
    out = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).join(
        spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", "source"), "doc_id")
    s = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    total = sum(r["size"] for r in s)
    assert sum(r["target"] for r in s) == pytest.approx(total)
    assert all(abs(r["taken"] - r["target"]) <= 100 for r in s)
    assert all(r["taken"] <= 3 * r["size"] for r in out.select("taken", F.col("size")).collect())


def test_mix_of_nothing(frame):
    assert mixing.mix_documents(frame([])).count() == 0
    assert [r["taken"] for r in mixing.mix_documents(frame([(1, None, "a"), (2, " ", None)])).collect()] == [0, 0]


def _plain(text):
    t = text or ""
    w = WORD.findall(t)
    n = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_statistics_equal_plain_counts(frame, odd_rows):
    rows = odd_rows + [(50 + i, t, "a") for i, t in enumerate(
        ["a b c a b c", "a a a a", "x\nx\n\nx\r\nx", "a b c d a b c", "||| & <b>", "é é é é\n\n é"])]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter((r["doc_id"], *(r[n] for n in names)) for r in rules.with_statistics(frame(rows)).collect())
    assert got == Counter((d, *_plain(t)) for d, t, _ in rows)


def test_rules_are_learned_and_ordered(spark):
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(rules.FEATURES)))
    bad = (x[:, 1] > 0.8) | ((x[:, 3] > 0.7) & (x[:, 0] < 0.3))
    found = rules.learn_rules(x, bad)
    hit = np.zeros(len(x), bool)
    for r in found:
        hit |= rules._holds(r.tests, x)
    assert (hit == bad).mean() > 0.95 and 1 < len(found) <= 12
    assert "CASE WHEN" in str(rules.verdict(found)) and str(rules.verdict([])).count("true")
    assert rules.learn_rules(np.zeros((0, len(rules.FEATURES))), np.zeros(0, bool)) == []


def test_rules_without_labels_keep_what_the_base_keeps(spark, frame, odd_rows):
    labels = spark.createDataFrame([(None, 1), (4, None)], "doc_id long, quality int")
    out = rules.apply_rules(frame(odd_rows), rules.fit_rules(frame(odd_rows), labels)).collect()
    assert len(out) == len(odd_rows) and all(r["kept"] == (not r["base_failed"]) for r in out)
