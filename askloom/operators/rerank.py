"""Second ranking stage, context, prompt and fallback answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from askloom.functions.text import let, words
from askloom.operators.index import latest_per_id

# Chunks kept, lowest score kept, defaults of missing metadata, fallback answer.
TOP_N = 3
MIN_SCORE = -1.0
NO_FILENAME = "unknown"
NO_PAGE = "1"
NO_HIT_ANSWER = (
    "I could not find any relevant information in the knowledge base to answer your query."
)

K1, B = 1.2, 0.75               # Robertson & Zaragoza 2009
_ROUND = 9

INSTRUCTION = "Use nothing but the context to answer. Say that you do not know when it lacks the answer."


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and mean length in words."""
    return chunks.select(F.size(words("text")).alias("n")).agg(
        F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"))


def term_stats(chunks: DataFrame) -> DataFrame:
    """``term, df, n_words``: chunks that have a word; the row of the null term holds the number of
    chunks and of all their words.

    A table to be kept beside the index: one row for each word, counted partially before the shuffle.
    """
    bag = words("text")
    terms = chunks.select(F.explode(F.array_distinct(bag)).alias("term"), F.lit(0).cast("bigint").alias("n"))
    total = chunks.select(F.lit(None).cast("string").alias("term"), F.greatest(F.size(bag), F.lit(0)).cast("bigint").alias("n"))
    return terms.unionByName(total).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n_words"))


def change_stats(stats: DataFrame, removed: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """``term_stats`` after chunks went and came. Only those chunks are read, not the corpus.

    ``removed`` must hold the rows (text) as they were counted; words of no chunk any more drop out.
    """
    parts = stats.select("term", "df", "n_words")
    if removed is not None:
        parts = parts.unionByName(term_stats(removed).select("term", (-F.col("df")).alias("df"), (-F.col("n_words")).alias("n_words")))
    if added is not None:
        parts = parts.unionByName(term_stats(added))
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_words").alias("n_words")).where("df > 0")


def upsert_stats(stats: DataFrame, index: DataFrame, new_rows: DataFrame, order: str = "seq") -> DataFrame:
    """Statistics that fit ``upsert_index(index, new_rows, order)``.

    Reads the rows of the index that the change takes away: those of its sources and of its ids.
    """
    new = latest_per_id(new_rows, order)
    gone = index.join(new_rows.select("source").distinct(), "source", "left_semi").select("id", "text").unionByName(
        index.join(new_rows.select("source").distinct(), "source", "left_anti")
        .join(new.select("id"), "id", "left_semi").select("id", "text"))
    return change_stats(stats, gone, new)


def delete_stats(stats: DataFrame, index: DataFrame, sources: DataFrame) -> DataFrame:
    """Statistics that fit ``delete_sources(index, sources)``."""
    return change_stats(stats, index.join(sources.select("source").distinct(), "source", "left_semi"))


def _terms_by_stats(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """As ``query_terms``, from kept statistics."""
    terms = queries.select("req_id", F.explode(F.array_distinct(words("query"))).alias("term"))
    n_docs = stats.where("term is null").agg(F.max("df").alias("n_docs"))
    idf = F.log(1 + (n_docs.scalar() - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    return (terms.join(stats.where("term is not null"), "term").select("req_id", "term", idf).groupBy("req_id")
            .agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms")))


def query_terms(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``req_id, terms``: each question's distinct words with their inverse document frequency.

    Document frequencies are counted for words that occur in some question, with a partial count
    before the shuffle, so a word found in every chunk moves one row per task.
    """
    terms = queries.select("req_id", F.explode(F.array_distinct(words("query"))).alias("term"))
    vocabulary = terms.select("term").distinct()
    n_docs = chunks.agg(F.count("*").alias("n_docs"))
    df = (
        chunks.select(F.explode_outer(F.array_distinct(words("text"))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("df"))
        .join(vocabulary, "term", "left_semi"))
    idf = df.select("term", F.log(1 + (n_docs.scalar() - F.col("df") + 0.5) / (F.col("df") + 0.5))
                    .alias("idf"))
    return terms.join(idf, "term").groupBy("req_id").agg(
        F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms"))


def bm25(bag: Column, terms: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    """Score of one (question, chunk) pair from the chunk's words; words it lacks add nothing."""
    length = F.size(bag)

    def score(shared):
        def add(acc, x):
            tf = F.size(F.filter(shared, lambda w: w == x["term"])).cast("double")
            return acc + x["idf"] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))

        return F.aggregate(F.coalesce(terms, F.array().cast("array<struct<term:string,idf:double>>")),
                           F.lit(0.0), add)

    # only the chunk's words that the question has are counted term by term
    return let(F.transform(terms, lambda x: x["term"]), lambda names: let(
        F.filter(bag, lambda w: F.array_contains(names, w)), score))


def rerank_score(candidates: DataFrame, queries: DataFrame, chunks: DataFrame | None,
                 stats: DataFrame | None = None) -> DataFrame:
    """Add ``rerank_score`` to ``req_id, id, rank, distance, text, ...``: BM25 with corpus statistics.

    With ``stats`` (see ``term_stats``) the corpus is not read, and ``chunks`` may be None.
    """
    if stats is None:
        terms, mean = query_terms(queries, chunks), corpus_stats(chunks).select("avg_len")
    else:
        terms = _terms_by_stats(queries, stats)
        mean = stats.where("term is null").agg((F.max("n_words") / F.max("df")).alias("avg_len"))
    scored = candidates.join(terms, "req_id", "left").withColumn(
        "avg_len", mean.scalar()).withColumn("bag", words("text"))
    return scored.withColumn("rerank_score", F.round(F.coalesce(
        bm25(F.col("bag"), F.col("terms"), F.col("avg_len")), F.lit(0.0)), _ROUND)).drop("terms", "avg_len", "bag")


def rerank_topn(scored: DataFrame, top_n: int = TOP_N, min_score: float = MIN_SCORE) -> DataFrame:
    """Keep scores from ``min_score``, best first, ties in retrieval order, first ``top_n``."""
    order = Window.partitionBy("req_id").orderBy(F.col("rerank_score").desc(), F.col("rank"))
    # Best scores come first, so the threshold may act after the ranking: the rank of what stays
    # is the same, and the score is not computed once more for a filter below the window.
    return scored.withColumn("pos", F.row_number().over(order)).filter(
        (F.col("pos") <= top_n) & (F.col("rerank_score") >= min_score))


def context_chunks(ranked: DataFrame) -> DataFrame:
    """``req_id, context``: the kept chunks in order; at most ``top_n`` per question."""
    return ranked.groupBy("req_id").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "id", "filename", "page", "text", "rerank_score"))).alias("context"))


def context_text(context) -> Column:
    c = F.col(context) if isinstance(context, str) else context
    return F.array_join(F.transform(c, lambda x: F.concat(
        F.lit("Source: "), F.coalesce(x["filename"], F.lit(NO_FILENAME)),
        F.lit(" (Page "), F.coalesce(x["page"].cast("string"), F.lit(NO_PAGE)), F.lit(")\n"),
        x["text"])), "\n\n")


def build_prompt(context, query) -> Column:
    q = F.col(query) if isinstance(query, str) else query
    return F.concat(F.lit(INSTRUCTION + "\n\nContext:\n"), context_text(context),
                    F.lit("\n\nQuestion: "), q, F.lit("\nAnswer:"))


def answer_sources(context) -> Column:
    """File names of the context chunks in order, repeats kept."""
    c = F.col(context) if isinstance(context, str) else context
    return F.transform(c, lambda x: F.coalesce(x["filename"], F.lit(NO_FILENAME)))


def with_context(queries: DataFrame, context: DataFrame) -> DataFrame:
    """Every question with its context, empty where nothing was found."""
    kind = context.schema["context"].dataType.simpleString()
    return queries.join(context, "req_id", "left").withColumn(
        "context", F.coalesce("context", F.array().cast(kind)))


def answer_or_fallback(answer, context) -> Column:
    """The fixed fallback answer where the context is empty."""
    a = F.col(answer) if isinstance(answer, str) else answer
    c = F.col(context) if isinstance(context, str) else context
    return F.when(F.size(c) == 0, F.lit(NO_HIT_ANSWER)).otherwise(a)
