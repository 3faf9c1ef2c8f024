"""The pipeline's stages against plain versions on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_matching import _repeats, _similar


@pytest.fixture
def sf(spark, tmp_path, odd_rows):
    spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def _documents(frame, rows):
    return frame(rows).withColumn("n_chars", F.length("text").cast("long")).withColumn("`odd name.x`", F.lit(1))


def test_stages_keep_the_columns_of_documents(spark, frame, odd_rows, sf):
    for rows in (odd_rows, []):
        docs = _documents(frame, rows)
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.count() <= 3 * len(rows)
        assert cp.STAGES[-1][1](spark, docs, sf).count() == len(rows)


def test_near_copies_leave_one(spark, frame, sf):
    rnd = random.Random(8)
    rows = []
    for g in range(20):
        w = [f"w{rnd.randrange(4000)}" for _ in range(60)]
        for _ in range(rnd.choice([1, 3, 5])):
            v = list(w)
            v[rnd.randrange(60)] = f"e{rnd.randrange(3)}"
            rows.append((len(rows), " ".join(v), "a"))
    rows += [(900, None, "a"), (901, "", "a"), (902, None, "b")]
    _, root = _similar(rows)
    kept = {r["doc_id"] for r in cp.ngram_jaccard_join(spark, _documents(frame, rows), sf).collect()}
    assert kept == {rows[r][0] for r in root}


def test_repeats_leave_the_text(spark, frame, sf):
    shared = "the shared passage é " * 15
    rows = [(i, f"{i} begins {i * 7919} " + shared + f" ends {i}", "a") for i in range(4)] + [(9, "short", "a"), (10, None, "b")]
    out = {r["doc_id"]: r for r in cp.suffix_array_dedup(spark, _documents(frame, rows), sf).collect()}
    want = {d: n_removed for (d, _, n_removed, _, _), _ in _repeats(rows).items()}
    for d, t, _ in rows:
        if t is None:
            assert out[d]["text"] is None
            continue
        assert len(t.encode()) - len(out[d]["text"].encode()) in (want[d], want[d] + 1)  # a torn é goes whole
        assert out[d]["n_chars"] == len(out[d]["text"])


def test_mix_repeats_rows_as_taken(spark, frame, odd_rows, sf):
    from askloom.llm import mixing

    docs = _documents(frame, odd_rows)
    got = Counter((r["doc_id"], r["text"]) for r in cp.source_mix(spark, docs, sf).collect())
    sized = docs.select("doc_id", "source", mixing.n_words("text").alias("size"), mixing.shuffle_key().alias("key"), )
    want = Counter()
    for r in mixing.mix(sized).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter({d: n for d, n in Counter(k[0] for k in got.elements()).items()}) == Counter({d: n for d, n in want.items() if n})


def test_run_end_to_end(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
