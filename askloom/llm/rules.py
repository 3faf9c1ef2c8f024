"""Quality rules: statistics of each text in Spark expressions, and a decision list learned on them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Statistics the learner may put thresholds on. Shares, so that they mean the same in any length.
FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the statistics of the whole text; a null text counts as an empty one.

    Words are runs of [^\\x20\\x09-\\x0D]. n_repeat_words counts words in three-word windows that
    occur twice or more in the text, the first occurrence included: windows are compared by a
    64-bit hash, and only a text in which some hash repeats is sorted. Other columns are dropped.
    """
    d = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("ws", F.expr(r"regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+', 0)"))
    d = d.withColumn("ls", F.expr(r"filter(split(t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.withColumn("hs", F.expr(
        "if(size(ws) < 3, cast(array() as array<bigint>), "
        "transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2])))"))
    d = d.select(
        "doc_id", "hs", F.size("ws").cast("long").alias("n_words"),
        F.expr("aggregate(ws, 0L, (n, w) -> n + length(w))").alias("word_chars"),
        F.expr("length(t) - length(regexp_replace(t, '[#*$%&|<>]', ''))").cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size("ls").cast("long").alias("n_lines"),
        F.expr("length(t) - length(regexp_replace(t, '[A-Z]', ''))").cast("long").alias("n_upper"),
        F.expr("length(t) - length(replace(t, '!', ''))").cast("long").alias("n_marks"))
    d = d.withColumn("again", F.size(F.array_distinct("hs")) < F.size("hs"))
    d = d.withColumn("at", F.expr(
        "case when again then array_sort(transform(hs, (h, i) -> struct(h, i))) end"))
    d = d.withColumn("at", F.expr(
        "case when again then array_sort(transform(filter(at, (x, i) -> "
        "(i > 0 and at[i - 1].h = x.h) or (i + 1 < size(at) and at[i + 1].h = x.h)), x -> x.i)) end"))
    covered = F.expr(
        "case when again then aggregate(at, struct(0L as n, 0 as upto), "
        "(s, i) -> struct(s.n + i + 3 - greatest(s.upto, i) as n, i + 3 as upto), s -> s.n) else 0L end")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"),
                    "n_lines", "n_upper", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    """The learner's statistics from the counts, in the order of FEATURES."""
    def share(a, b):
        return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))

    return [share("word_chars", "n_words").alias("word_length"), share("n_symbols", "word_chars").alias("symbol_share"),
            share("n_dup_lines", "n_lines").alias("dup_line_share"),
            share("n_repeat_words", "n_words").alias("repeat_share"),
            share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "n_words").alias("mark_share")]


@dataclass(frozen=True)
class Test:
    feature: str
    over: bool
    bound: float


@dataclass(frozen=True)
class Rule:
    """Reject where all tests hold."""
    tests: tuple[Test, ...]


def _holds(rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for t in rule:
        col = x[:, FEATURES.index(t.feature)]
        hit &= col > t.bound if t.over else col <= t.bound
    return hit


def _worth(rule, x, bad) -> float:
    hit = _holds(rule, x)
    n = int(hit.sum())
    return (2 * int((hit & bad).sum()) - n) / n if n else -1.0


def learn_rules(x: np.ndarray, bad: np.ndarray, *, least_precision: float = 0.9, least_cover: int = 5,
                max_tests: int = 3, max_rules: int = 12) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds, prune it on the rest, set aside what it covers.

    x: rows of FEATURES; bad: rows that the list should reject. A rule is kept while at least
    ``least_precision`` of what it covers in the rest is bad. Deterministic. No rows or no bad
    rows give an empty list, which rejects nothing.
    """
    rules: list[Rule] = []
    fold = np.arange(len(x)) % 3 == 2
    gx, gb, px, pb = x[~fold], bad[~fold], x[fold], bad[fold]
    while len(rules) < max_rules and gb.sum() >= least_cover:
        rule: list[Test] = []
        inside = np.ones(len(gx), bool)
        while len(rule) < max_tests and (inside & ~gb).any():
            best, p0, n0 = None, int((inside & gb).sum()), int(inside.sum())
            for k, name in enumerate(FEATURES):
                col = gx[inside, k]
                for bound in np.unique(np.quantile(col[gb[inside]], np.linspace(0, 1, 41))):
                    for over in (True, False):
                        edge = float(np.nextafter(bound, -np.inf)) if over else float(bound)
                        hit = col > edge if over else col <= edge
                        p, n = int((hit & gb[inside]).sum()), int(hit.sum())
                        if p < least_cover:
                            continue
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, Test(name, over, edge))
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
            inside = _holds(rule, gx)
        while len(rule) > 1 and _worth(rule[:-1], px, pb) >= _worth(rule, px, pb):
            rule.pop()
        hit = _holds(rule, px)
        if not rule or not hit.any() or (hit & pb).sum() < least_precision * hit.sum():
            break
        rules.append(Rule(tuple(rule)))
        keep = ~_holds(rule, gx)
        gx, gb = gx[keep], gb[keep]
        keep = ~hit
        px, pb = px[keep], pb[keep]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects, else the row is kept."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for t in rule.tests:
            cond = cond & (F.col(t.feature) > t.bound if t.over else F.col(t.feature) <= t.bound)
        out = F.when(cond, False) if out is None else out.when(cond, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, **options) -> list[Rule]:
    """Learn from at most ``max_rows`` labelled documents, those with the least id hashes.

    labels: doc_id, quality (1 keep, 0 reject); null labels are left out, of repeated ids the
    least label counts. Only statistics reach the driver, at most ``max_rows`` rows of them.
    """
    chosen = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")  # max_rows ids
    stats = with_statistics(picked).select("doc_id", *features())
    rows = stats.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(max_rows).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return learn_rules(x, np.array([r["quality"] == 0 for r in rows], bool), **options)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every document."""
    s = with_statistics(docs)
    f = s.select("*", *[c.alias(f"f_{n}") for n, c in zip(FEATURES, features())])
    renamed = [Rule(tuple(Test(f"f_{t.feature}", t.over, t.bound) for t in r.tests)) for r in rules]
    return f.withColumn("base_failed", base_failed()).select(
        *s.columns, "base_failed", (~F.col("base_failed") & verdict(renamed)).alias("kept"))
