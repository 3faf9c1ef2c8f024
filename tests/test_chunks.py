"""Chunking against a plain recursive splitter on random texts."""

import random

import pytest
from pyspark.sql import functions as F

from askloom.operators.chunk import SEPARATORS, chunk_pages, split_text
from askloom.plans.ingest import index_rows


def cut(text, sep):
    first, *rest = text.split(sep)
    return [p for p in [first] + [sep + r for r in rest] if p]


def pack(pieces, size, overlap):
    out, held, total = [], [], 0
    for p in pieces:
        if held and total + len(p) > size:
            out.append("".join(held))
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    return out + ["".join(held)]


def split(text, size, overlap, seps):
    here = next((i for i, s in enumerate(seps) if s in text), None)
    if here is None:
        return [text]
    out, short = [], []
    for p in cut(text, seps[here]):
        if len(p) < size:
            short.append(p)
            continue
        if short:
            out += pack(short, size, overlap)
            short = []
        out += split(p, size, overlap, seps[here + 1:])
    return out + (pack(short, size, overlap) if short else [])


def random_text(r):
    bits = ["a", "bb", "cccc", "é", "日本", "ddddddddd", " ", " ", "\n", "\n\n", "  ", "\n\n\n"]
    return "".join(r.choice(bits + ["x" * r.randint(1, 60)]) for _ in range(r.randint(0, 120)))


@pytest.mark.parametrize("size,overlap", [(15, 5), (50, 10), (20, 19), (1000, 150)])
def test_equals_plain_splitter(spark, size, overlap):
    r = random.Random(size)
    texts = [random_text(r) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.c for x in df.select("i", split_text("t", size, overlap).alias("c")).collect()}
    for i, t in enumerate(texts):
        want = [c.strip() for c in split(t, size, overlap, SEPARATORS)]
        assert got[i] == [c for c in want if c], repr(t)


def test_golden_row(spark):
    df = spark.createDataFrame([("aaaa bbbb cccc dddd eeee",)], "t string")
    assert df.select(split_text("t", 15, 5, [" "])).first()[0] == ["aaaa bbbb cccc", "cccc dddd eeee"]


def test_separators_are_taken_literally(spark):
    df = spark.createDataFrame([("a.b.c|d|e",)], "t string")
    assert df.select(split_text("t", 4, 0, ["|", "."])).first()[0] == ["a.b", ".c", "|d|e"]


def test_real_documents_respect_the_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    longest = chunk_pages(docs).agg(F.max(F.length("text"))).first()[0]
    assert 0 < longest <= 1000


def test_ids_pages_and_short_pages(spark):
    text = "first page with enough text\f   short  \fthird page with enough text"
    df = spark.createDataFrame([("/a/b.pdf", text)], "source string, content string")
    rows = sorted(index_rows(df, embed=None).collect(), key=lambda r: r.id)
    assert [(r.page, r.chunk_idx, r.filename) for r in rows] == [(1, 0, "b.pdf"), (3, 0, "b.pdf")]
    assert rows[0].id == f"doc_{rows[0].file_hash[:8]}_p1_c0"
