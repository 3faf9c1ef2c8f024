"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from askloom.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def shuffle_key(id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Column:
    """The order documents are served in: a digest of seed, id and text. Equal rows are equal."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                             F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))


def source_targets(sized: DataFrame, max_epochs: int = 3) -> DataFrame:
    """source, source_size, target (double): one row per source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes.
    A target stops at ``max_epochs`` times its source's size and the excess is shared again by
    weight: with sources in order of cap per weight, those whose share of what the earlier ones
    leave is over their cap form a prefix, and the others share the rest. The windows here are
    over one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    s = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("w", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
         .withColumn("cap", F.col("source_size") * max_epochs))
    before = every.orderBy(F.col("cap").cast("double") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    s = (s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
         .withColumn("over", F.col("left").cast("double") * F.col("w") > F.col("cap").cast("double") * F.col("w_left")))
    rest = s.withColumn("rest", F.min(F.when(~F.col("over"), F.struct(-F.col("w_left"), "left", "w_left"))).over(every))
    target = F.when(F.col("over"), F.col("cap").cast("double")).otherwise(
        (F.col("rest.left") * F.col("w")).cast("double") / F.col("rest.w_left").cast("double"))
    return rest.select("source", "source_size", target.alias("target"))


def mix(sized: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Copies of each document that a mix of all sources at their targets takes.

    ``sized``: doc_id, source, size (long, not null), key (order of service). Every copy of a
    document (its source may be read ``max_epochs`` times) gets its virtual finish time, the
    words of its source up to and with it over the source's target. All copies in order of finish
    time are cut where their words reach the sum of all sizes; copies that finish at the very
    time of the cut stay or go together. Returns doc_id, source, key, size, source_size, target, copies.

    Sums of a source are taken in two steps, within and between 4096 ranges of the key, and the
    cut is searched through two levels of 4096 ranges of time, so no task gets a whole source or
    a whole mix. An empty table gives an empty result; with all sizes 0 nothing is over the cut.
    """
    targets = source_targets(sized, max_epochs)
    docs = sized.withColumn("part", F.substring("key", 1, 3))
    inner = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    parts = docs.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.select("source", "part", F.coalesce(F.sum("part_size").over(
        Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    parts = (parts.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source"))
             .select("p.*", "t.source_size", "t.target"))
    docs = docs.withColumn("within", F.sum("size").over(inner))
    placed = stored(docs.alias("d").join(parts.alias("p"), F.expr("d.source <=> p.source and d.part = p.part")).select(
        "doc_id", "d.source", "key", "size", "source_size", "target", (F.col("before") + F.col("within")).alias("upto")), "mix")
    times = F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: F.when(
        F.col("target") > 0, (F.col("upto") + e * F.col("source_size")).cast("double") / F.col("target")).otherwise(F.lit(0.0)))
    placed = placed.withColumn("times", times)
    spot = F.floor((1 - 1 / (1 + F.col("t"))) * (1 << 24)).cast("long")
    copies = placed.select("size", F.explode("times").alias("t")).withColumn("spot", spot)
    copies = copies.withColumn("hi", F.shiftright("spot", 12))
    total = sized.agg(F.sum("size")).first()[0] or 0

    def crossing(ranges: DataFrame, name: str, done: int):
        """The first range in which the running sum passes the total, and the sum before it."""
        w = Window.partitionBy(F.lit(0)).orderBy(name)
        r = ranges.groupBy(name).agg(F.sum("size").alias("n")).withColumn("run", F.sum("n").over(w) + done)
        return r.where(F.col("run") > total).orderBy(name).select(name, (F.col("run") - F.col("n")).alias("done")).first()

    cut = None  # everything fits
    if found := crossing(copies, "hi", 0):
        spot_, done = crossing(copies.where(F.col("hi") == found[0]), "spot", found[1])
        last = crossing(copies.where(F.col("spot") == spot_), "t", done)
        cut = last[0]
    taken = F.size("times") if cut is None else F.size(F.filter("times", lambda t: t < F.lit(cut)))
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", taken.cast("long").alias("copies"))


def mix_documents(docs: DataFrame, max_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for each row of ``docs``.

    Needs doc_id, text, source; other columns are ignored. A null text has size 0; null ids and
    repeated rows are documents like any other; a null source is a source of its own.
    """
    sized = stored(docs.select("doc_id", "source", n_words("text").alias("size"), shuffle_key().alias("key")), "sizes")
    return mix(sized, max_epochs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::BIGINT AS rest,
              (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS w_rest FROM s1
       WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, rest::DOUBLE * w > cap::DOUBLE * w_rest AS over_cap FROM s2),
f AS (SELECT arg_max(rest, w_rest) AS rest, max(w_rest) AS w_rest FROM s3 WHERE NOT over_cap),
t AS (SELECT source, source_size, CASE WHEN over_cap THEN cap::DOUBLE ELSE (f.rest * w)::DOUBLE / f.w_rest::DOUBLE END AS target
      FROM s3, f),
p AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
             ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, row_number() OVER () AS n
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT p.*, CASE WHEN target > 0 THEN (upto + e * source_size)::DOUBLE / target ELSE 0 END AS v
      FROM p, (SELECT unnest([0, 1, 2]) AS e)),
r AS (SELECT v, sum(sum(size)) OVER (ORDER BY v) AS run FROM c GROUP BY v),
k AS (SELECT coalesce((SELECT min(v) FROM r WHERE run > (SELECT sum(size) FROM d)), 'infinity'::DOUBLE) AS cut)
SELECT doc_id, any_value(size)::BIGINT AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       (sum(size) FILTER (v < cut))::BIGINT AS taken0, coalesce(taken0, 0) AS taken
FROM c, k GROUP BY n, doc_id
"""
ORACLE = f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE})"
