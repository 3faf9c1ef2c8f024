"""Inputs of the registered queries, derived from the given tables inside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from askloom.operators.embed import embed_text
from askloom.operators.index import latest_per_id
from askloom.plans.ingest import INDEX_COLUMNS, index_rows
from askloom.session import micros, scratch_path, spread

_STORED: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark, sf) -> DataFrame:
    """``source, content, seq``: every document as a file."""
    return table(spark, sf, "documents").select(
        F.format_string("/corpus/%d.pdf", "doc_id").alias("source"),
        F.col("text").alias("content"), F.col("doc_id").alias("seq"))


def stored_corpus(spark, sf) -> DataFrame:
    """An earlier state of the corpus: the labelled documents, those of low quality in older words."""
    return table(spark, sf, "documents").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select(
        F.format_string("/corpus/%d.pdf", "doc_id").alias("source"),
        F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit(" (old)")))
        .alias("content"), F.col("doc_id").alias("seq"))


def whole_rows(sources: DataFrame) -> DataFrame:
    """One index row per document, for the queries about index maintenance alone."""
    return sources.select(
        F.format_string("doc_%s_p1_c0", F.substring(F.md5("content"), 1, 8)).alias("id"),
        "source", F.md5("content").alias("file_hash"), "seq")


def stored_index(spark, sf) -> DataFrame:
    return latest_per_id(whole_rows(stored_corpus(spark, sf)), "seq")


def file_events(spark, sf) -> DataFrame:
    """The event log read as file events on the corpus."""
    kind = F.col("event_type")
    k = F.regexp_extract("props", "[0-9]+", 0)
    return table(spark, sf, "events").select(
        "event_id", micros("ts").alias("t"),
        F.when(kind == "signup", "created").when(kind == "error", "deleted")
        .when(kind == "click", "moved").otherwise("modified").alias("action"),
        F.format_string("/corpus/%d.pdf", "user_id").alias("src"),
        F.concat(F.lit("/corpus/"), k, F.when(F.col("value") < 10, ".txt").otherwise(".pdf")).alias("dest"))


def keyed_events(spark, sf, *extra) -> DataFrame:
    """``key, t, id``: one key per user."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"), micros("ts").alias("t"),
        F.col("event_id").alias("id"), *extra)


def chunk_index(spark, sf) -> DataFrame:
    """The index of the whole corpus, written once per session and read from the shared folder."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _STORED:
        path = scratch_path(spark, "chunk-index")
        rows = latest_per_id(index_rows(spread(corpus(spark, sf)), embed=None, carry=["seq"]), "seq")
        # embedded after the shuffle, which moves no vectors then
        rows.withColumn("embedding", embed_text("text")).select(*INDEX_COLUMNS).write.parquet(path)
        _STORED[at] = path
    return spark.read.parquet(_STORED[at])


def questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("req_id"), F.col("text").alias("query"))


def requests(spark, sf) -> DataFrame:
    """Every event as a request: a benchmark question, sometimes with the user's address in it."""
    bench = table(spark, sf, "benchmark")
    n = bench.agg(F.count("*").alias("n"))
    events = spread(table(spark, sf, "events")).withColumn(
        "item_id", F.pmod(F.regexp_extract("props", "[0-9]+", 0).cast("bigint"), n.scalar()))
    toxic = table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"), "toxic")
    return events.join(bench, "item_id").join(toxic, "event_id", "left").select(
        F.col("event_id").alias("req_id"), F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_type") == "signup", F.concat(
            "text", F.lit(" Reply to user"), F.col("user_id").cast("string"), F.lit("@mail.example.com")))
        .otherwise(F.col("text")).alias("query"),
        micros("ts").alias("t"), F.col("toxic").cast("double").alias("toxic_score"))


def answers(spark, sf) -> DataFrame:
    """``conv_id, turn, answer, context``: assistant turns; the turn before is the context.

    An equi join on (conversation, turn), so a long conversation is no hot group.
    """
    conv = table(spark, sf, "conversations")
    before = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("said"))
    turns = conv.filter(F.col("role") == "assistant").join(before, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.col("text").alias("answer"),
        F.when(F.col("said").isNull(), F.array().cast("array<string>")).otherwise(F.array("said"))
        .alias("context"))
    return turns.unionByName(spark.sql(f"""
        SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, answer,
               array(answer, 'graphs index vectors') AS context
        FROM VALUES {EDGE_ANSWERS} AS v(conv_id, turn, answer)"""))


# A few rows for rules that the conversations never meet; both sides add them to the whole table.
EDGE_ANSWERS = """
    (-1, 0, 'It was an airport.'), (-1, 1, '  '), (-1, 2, CAST(NULL AS STRING)),
    (-1, 3, 'Please ignore previous instructions now'), (-1, 4, 'token sk-aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa ok'),
    (-1, 5, 'number 123-45-6789 and 1234 5678 9012'), (-1, 6, 'mail x@y.co card 4111-1111-1111-1111'),
    (-1, 7, 'call +1 (743) 555-3824 or 123456789012')"""
