"""The corpus pipeline: quality, near copies, repeated passages, mix, token ids.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the
columns of ``docs`` (whatever they are; doc_id, text and source are needed) but for the last,
which returns the encoded documents. Null ids and repeated rows are documents like any other; a
null text is an empty one; an empty table stays empty. Labels come from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from askloom.llm import bpe, common, jaccard_join, mixing, quality, spans

#: A document is kept from this score on.
LEAST_QUALITY = 0.7


def _row_key(docs: DataFrame):
    """Names for helper columns that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    n = 0
    while any(c.startswith(f"_p{n}") for c in taken):
        n += 1
    return f"_p{n}"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    common.prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    return quality.keep_quality(docs, model, LEAST_QUALITY)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the least doc_id stays, of rows that share it the least text.

    Rows without words have no copies and all stay. A group without any id keeps the least text.
    """
    common.prepare(spark)
    p = _row_key(docs)
    keyed = docs.withColumn(f"{p}k", jaccard_join.text_key("text"))
    members = common.stored(jaccard_join.similar_documents(docs.select("doc_id", "text"), by_text=True), "members")
    lost = members.where("not kept").select(F.col("node").alias(f"{p}k"))
    left = keyed.join(lost, f"{p}k", "left_anti")
    whole = F.struct(*[F.col(_name(c)) for c in docs.columns])  # the least is taken before the shuffle too
    some = left.where(F.col(f"{p}k").isNotNull()).groupBy(f"{p}k").agg(
        F.min_by(whole, F.struct(F.col("doc_id").isNull(), "doc_id")).alias(f"{p}r"))
    return some.select(f"{p}r.*").unionByName(left.where(F.col(f"{p}k").isNull()).select(*map(_name, docs.columns)))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 200-byte strings leave the text; a character torn by a cut leaves whole.

    ``n_chars`` follows the text where there is such a column. A null text stays null.
    """
    common.prepare(spark)
    p = _row_key(docs)
    lost = spans.without_repeats(docs.select("doc_id", "text"), as_text=True).select(
        F.col("node").alias(f"{p}k"), F.col("kept").alias(f"{p}t"))
    out = docs.withColumn(f"{p}k", F.xxhash64(F.coalesce("text", F.lit("")))).join(common.stored(lost, "lost"), f"{p}k", "left")
    new = F.when(F.col("text").isNotNull(), F.coalesce(F.col(f"{p}t"), F.col("text")))
    kind = dict(docs.dtypes).get("n_chars")
    return out.select(*[
        new.alias("text") if c == "text"
        else F.when(F.col(f"{p}t").isNotNull() & F.col("text").isNotNull(), F.length(f"{p}t")).otherwise(F.col(c)).cast(kind).alias(c)
        if c == "n_chars" else F.col(_name(c)) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times."""
    p = _row_key(docs)
    keyed = docs.withColumn(f"{p}k", mixing.shuffle_key())
    sized = common.stored(keyed.select("doc_id", "source", mixing.n_words("text").alias("size"), F.col(f"{p}k").alias("key")), "sizes")
    same = Window.partitionBy("key", "source").orderBy(F.desc("copies"))
    taken = mixing.mix(sized).select("key", "source", "copies").withColumn("no", F.row_number().over(same))
    taken = taken.where("copies > 0").select(
        F.col("key").alias(f"{p}k"), F.col("source").alias(f"{p}s"), F.col("no").alias(f"{p}n"), F.col("copies").alias(f"{p}c"))
    nth = F.row_number().over(Window.partitionBy(f"{p}k", "source").orderBy(F.lit(0)))
    out = keyed.withColumn(f"{p}n", nth).alias("d").join(
        taken.alias("t"), (F.col(f"d.{p}k") == F.col(f"t.{p}k")) & F.col("d.source").eqNullSafe(F.col(f"t.{p}s"))
        & (F.col(f"d.{p}n") == F.col(f"t.{p}n")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}c")))
    return out.select(*[F.col(f"d.{_name(c)}") for c in docs.columns], copies.alias(f"{p}e")).drop(f"{p}e")


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text of every row."""
    import public_tokenizers

    common.prepare(spark)
    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(coded, "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", bpe_round_trip),
]

#: SQL cannot express the trained classifier; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir.rstrip("/"))
        if k < len(STAGES) - 1:
            docs = common.stored(docs, "stage")
    return docs
