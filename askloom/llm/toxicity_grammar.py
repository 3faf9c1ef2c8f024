"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, slight, threat, target, negation, report, other). Five small transducers,
composed into one machine, rewrite a clause's classes into marks: an insult or slight alone or at a target,
a threat at a target, and each of these under a negation or in reported speech. The arcs carry the
weights: a word's own, what a target adds, what negation and report take away. A clause weighs the sum of
the arcs it takes, and a text's score is a logistic function of the sum over its clauses. Which words are
insults or slights, and the weights, are learned from labelled texts; the seed words below need no labels.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askloom.llm.common import crc_of_id, pieces, span_hashes, stored, text_bytes, word_spans

OTHER, INSULT, SLIGHT, THREAT, TARGET, NEGATION, REPORT = range(7)
#: Seed words of the classes; fixed values.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown",
    THREAT: "kill hurt destroy beat shoot stab burn",
    TARGET: "you your yours yourself u ye tu vous toi te du dich dir ihr ihn usted ustedes",
    NEGATION: "not no never isn't aren't don't without nicht kein keine nie ne pas jamais nunca",
    REPORT: "said says say wrote writes quoted quotes reported claims claimed called sagte schrieb disait dijo",
}
#: What the machine can match, and the weight of each path before any label is seen.
PRIOR = {
    "insult": 3.5, "insult_at": 6.0, "insult_negated": 0.5, "insult_reported": 0.5,
    "slight": 1.5, "slight_at": 2.5, "slight_negated": 0.2, "slight_reported": 0.2,
    "threat_at": 5.0, "threat_negated": 0.3, "threat_reported": 0.3,
}
MARKS = tuple(PRIOR)
MARGIN = 0.5  # a target adds so much at least, negation and report take away so much at least; a threat weighs no less than an insult
REACH = 4  # words over which a negation or a target counts

_LETTER = np.ones(256, bool)  # not part of a word
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".!?;:\n\"()")] = True


@dataclass
class Transducer:
    """Deterministic: arcs[state, symbol] = (next state, symbol out, weight)."""
    arcs: dict = field(default_factory=dict)
    start: object = 0

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: the other machine reads what this one writes; weights add."""
        out, first = Transducer({}, (self.start, other.start)), (self.start, other.start)
        todo, seen = deque([first]), {first}
        symbols = {s for _, s in self.arcs}
        while todo:
            a, b = todo.popleft()
            for s in symbols:
                if (a, s) not in self.arcs:
                    continue
                a2, mid, w1 = self.arcs[a, s]
                b2, end, w2 = other.arcs[b, mid]
                out.arcs[(a, b), s] = ((a2, b2), end, w1 + w2)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return out

    def run(self, symbols: Iterable) -> list:
        state, out = self.start, []
        for s in symbols:
            state, mark, weight = self.arcs[state, s]
            out.append((mark, weight))
        return out


def _words_machine(classes: dict[int, str], weight: dict[str, float], symbols: set) -> Transducer:
    """Names the words of some classes, each with its own weight."""
    return Transducer({(0, s): (0, classes.get(s, s), weight.get(classes.get(s), 0.0)) for s in symbols})


def _target_machine(weight: dict[str, float], symbols: set) -> Transducer:
    """Aims what follows a target within REACH words; a target that comes up to REACH words after an
    unaimed word aims that one. State: words left since a target, the unaimed word, words left since it."""
    t = Transducer(start=(0, None, 0))
    gain = {k: weight[k + "_at"] - weight.get(k, 0.0) for k in ("insult", "slight", "threat")}
    waiting = [(None, 0)] + [(k, n) for k in gain for n in range(1, REACH + 1)]
    for a in range(REACH + 1):
        for kind, n in waiting:
            for s in symbols:
                later = (kind, n - 1) if n > 1 else (None, 0)
                if s == TARGET:
                    arc = ((REACH, None, 0), "late_" + kind if kind else s, gain[kind] if kind else 0.0)
                elif s in gain and a:
                    arc = ((a - 1, None, 0), s + "_at", gain[s])
                elif s in gain:
                    arc = ((0, s, REACH), s, 0.0)
                else:
                    arc = ((max(0, a - 1), *later), s, 0.0)
                t.arcs[(a, kind, n), s] = arc
    return t


def _undoing_machine(trigger: int, suffix: str, reach: int | None, weight: dict[str, float], symbols: set) -> Transducer:
    """Rewrites matches within ``reach`` words after the trigger (anywhere after it if None).

    A match then weighs what its mark with ``suffix`` does, aimed or not. A target that follows a
    rewritten match adds nothing. State: words left, and whether the last match was rewritten.
    """
    t, far = Transducer(start=(0, False)), 1 if reach is None else reach
    for left in range(far + 1):
        for undone in (False, True):
            after = left if reach is None else max(0, left - 1)
            for s in symbols:
                kind = s.removeprefix("late_").split("_")[0] if isinstance(s, str) else None
                if s == trigger:
                    arc = ((far, undone), s, 0.0)
                elif kind is None:
                    arc = ((after, undone), s, 0.0)
                elif s.startswith("late_"):
                    off = undone or (reach is None and left > 0)
                    gain = weight[kind + "_at"] - weight.get(kind, 0.0)
                    if not off:
                        arc = ((after, undone), s, 0.0)
                    elif kind == "threat":  # the word itself did not count yet
                        arc = ((after, True), kind + suffix, weight[kind + suffix] - gain)
                    else:
                        arc = ((after, True), OTHER, -gain)
                elif not left:
                    arc = ((after, False), s, 0.0)
                elif s == "threat":
                    arc = ((after, True), s, 0.0)
                else:
                    arc = ((after, True), kind + suffix, weight[kind + suffix] - weight[s])
                t.arcs[(left, undone), s] = arc
    return t


def grammar(weight: dict[str, float]) -> Transducer:
    """Insults, threats, targets, negations and reports, composed. The arcs of a path add up to the
    weight of the marks it writes; a threat without a target is no match and weighs nothing."""
    words = {OTHER, INSULT, SLIGHT, THREAT, TARGET, NEGATION, REPORT}
    insult = _words_machine({INSULT: "insult", SLIGHT: "slight"}, weight, words)
    words = words - {INSULT, SLIGHT} | {"insult", "slight"}
    threat = _words_machine({THREAT: "threat"}, weight, words)
    words = words - {THREAT} | {"threat"}
    target = _target_machine(weight, words)
    words |= {k + "_at" for k in ("insult", "slight", "threat")} | {"late_" + k for k in ("insult", "slight", "threat")}
    negation = _undoing_machine(NEGATION, "_negated", REACH, weight, words)
    words |= {k + "_negated" for k in ("insult", "slight", "threat")}
    report = _undoing_machine(REPORT, "_reported", None, weight, words)
    return insult.then(threat).then(target).then(negation).then(report)


@dataclass(frozen=True)
class Grammar:
    words: dict[int, int]  # hash of a folded word: its class
    weights: dict[str, float]  # of the paths, by mark; grammar() puts them on the arcs
    bias: float


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 capitals, byte for byte."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] |= 0x20
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] |= 0x20
    return out


def _hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])


def lexicon(insults: Iterable[str] = (), slights: Iterable[str] = ()) -> dict[int, int]:
    """Class of each known word by its hash; a seed word keeps its class."""
    words = {_hash(w): SLIGHT for w in slights} | {_hash(w): INSULT for w in insults}
    return words | {_hash(w): k for k, line in SEEDS.items() for w in line.split()}


def _lookup(hashes: np.ndarray, table: dict[int, int]) -> np.ndarray:
    keys = np.array(sorted(table), np.uint64)
    if not len(keys) or not len(hashes):
        return np.zeros(len(hashes), np.int8)
    kinds = np.array([table[int(k)] for k in keys], np.int8)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, kinds[at], OTHER).astype(np.int8)


_MACHINES: dict[tuple, Transducer] = {}
_AT = {m: k for k, m in enumerate(MARKS)}


def marks(column: pa.Array, words: dict[int, int], weight: dict[str, float] = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Marks of each kind in every text, and the sum of its clauses' paths.

    Only clauses with an insult, a slight or a threat run the machine.
    """
    key = tuple(weight[m] for m in MARKS)
    if key not in _MACHINES:
        _MACHINES[key] = grammar(weight)
    machine, total = _MACHINES[key], np.zeros(len(column))
    data, offsets = text_bytes(column)
    out = np.zeros((len(column), len(MARKS)))
    for first, part, offs in pieces(data, offsets):
        low = fold(part)
        starts, ends = word_spans(low, offs, _LETTER)
        kind = _lookup(span_hashes(low, starts, ends), words)
        hot = np.flatnonzero((kind == INSULT) | (kind == SLIGHT) | (kind == THREAT))
        if not len(hot):
            continue
        clause = np.concatenate([[0], np.cumsum(_STOP[low])])[starts]
        text = np.searchsorted(offs, starts, "right") - 1
        edge = np.flatnonzero((np.diff(clause) != 0) | (np.diff(text) != 0)) + 1
        edge = np.concatenate([[0], edge, [len(starts)]])
        for c in np.unique(np.searchsorted(edge, hot, "right") - 1):
            row = first + text[edge[c]]
            for mark, w in machine.run(kind[edge[c]:edge[c + 1]].tolist()):
                total[row] += w
                if mark in _AT:
                    out[row, _AT[mark]] += 1
                elif isinstance(mark, str) and mark.startswith("late_"):
                    out[row, _AT[mark[5:] + "_at"]] += 1
                    if mark[5:] in _AT:
                        out[row, _AT[mark[5:]]] -= 1
    return out, total


def _ordered(w: np.ndarray) -> np.ndarray:
    """Weights of at least 0 by which a target adds, and negation and report take away, MARGIN at least."""
    w = np.maximum(w, 0)
    for kind in ("insult", "slight"):
        alone = w[_AT[kind]] = max(w[_AT[kind]], MARGIN)
        w[_AT[kind + "_at"]] = max(w[_AT[kind + "_at"]], alone + MARGIN)
    w[_AT["threat_at"]] = max(w[_AT["threat_at"]], w[_AT["insult_at"]])  # few texts have one
    for kind, above in (("insult", "insult"), ("slight", "slight"), ("threat", "threat_at")):
        for undone in ("_negated", "_reported"):
            w[_AT[kind + undone]] = min(w[_AT[kind + undone]], w[_AT[above]] - MARGIN)
    return w


def fit_weights(x: np.ndarray, y: np.ndarray, steps: int = 4000, rate: float = 0.2, hold: float = 0.0005,
                most: int = 64) -> tuple[dict[str, float], float]:
    """Logistic weights of the marks by gradient descent, held near the prior where data say little.

    More than ``most`` marks of a kind in a text count as so many here.
    """
    prior = np.array([PRIOR[m] for m in MARKS])
    w, b, x = prior.copy(), -3.0, np.minimum(x, most)
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
        w = _ordered(w - rate * (x.T @ (p - y) / max(1, y.sum()) + hold * (w - prior)))
        b -= rate * ((p - y).mean() + 0.1 * hold * (b + 3.0))
    return dict(zip(MARKS, w.tolist())), float(b)


def _distinct_words(only: frozenset[str] | None = None):
    """The distinct folded words of each text, of 3 to 100 bytes, with the text's label."""
    def run(batches):
        for batch in batches:
            found, toxic = [], []
            for i, y in enumerate(batch.column(1).to_pylist()):
                data, offsets = text_bytes(batch.column(0).slice(i, 1))
                words = set()
                for _, part, offs in pieces(data, offsets):
                    low = fold(part)
                    raw = low.tobytes()
                    words |= {raw[a:b] for a, b in zip(*word_spans(low, offs, _LETTER)) if 3 <= b - a <= 100}
                words = {w.decode("utf-8", "replace") for w in words}
                found += words if only is None else words & only
                toxic += [y] * (len(found) - len(toxic))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(toxic, pa.int32())], ["word", "y"])
    return run


def fit_grammar(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, held_out: bool = True, *,
                least: int = 3, sure: float = 0.88, likely: float = 0.5, max_words: int = 5000) -> Grammar:
    """Learn words and weights from at most ``max_rows`` labelled texts, those with the least id hashes.

    labels: doc_id, toxic. Rows whose crc32 of the id is 1 modulo 3 are never used (unless
    ``held_out`` is false). Of rows with one id the least text is used, so no more than ``max_rows``
    rows, of a number for each mark, reach the driver. A word that ``least`` or more toxic texts have is an insult when a
    share of at least ``sure`` of the texts that have it (and one more) are toxic, a slight from
    ``likely`` on. Null ids and labels are left out; of a repeated id the greatest label counts.
    The driver gets at most 4 * ``max_words`` words, those of most toxic texts.
    """
    pool = labels.where("doc_id is not null and toxic in (0, 1)")
    if held_out:
        pool = pool.where(crc_of_id() % 3 != 1)
    chosen = (pool.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows ids
                    .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"), "sample")
    usual = frozenset(r["word"] for r in (
        sample.where("y = 1").mapInArrow(_distinct_words(), "word string, y int").groupBy("word")
        .agg(F.sum("y").alias("hits")).where(F.col("hits") >= least).orderBy(F.desc("hits"), "word")
        .limit(4 * max_words).collect()))
    found = (sample.mapInArrow(_distinct_words(usual), "word string, y int").groupBy("word")
             .agg(F.sum("y").alias("hits"), (F.count(F.lit(1)) + 1).alias("n"))
             .where(F.col("hits") >= likely * F.col("n")).orderBy(F.desc("hits"), "word").limit(max_words).collect())
    words = lexicon([r["word"] for r in found if r["hits"] >= sure * r["n"]],
                    [r["word"] for r in found if r["hits"] < sure * r["n"]])

    def count(batches):
        for b in batches:
            m, _ = marks(b.column(0), words)
            yield pa.RecordBatch.from_arrays([pa.array(m[:, k]) for k in range(len(MARKS))] + [b.column(1)], [*MARKS, "y"])

    rows = sample.mapInArrow(count, ", ".join(f"{m} double" for m in MARKS) + ", y int").toPandas()
    return Grammar(words, *fit_weights(rows[list(MARKS)].to_numpy(float), rows["y"].to_numpy(float)))


def score_toxicity(docs: DataFrame, model: Grammar) -> DataFrame:
    """doc_id, score (0 to 1) and the marks of every whole text; a null text is an empty one.

    A text without marks, the empty one too, gets the bias alone. Ids may be null or repeat, and
    every row is scored; an empty table gives none. Other columns are dropped.
    """
    def score(batches):
        for b in batches:
            m, total = marks(b.column(1), model.words, model.weights)
            s = 1 / (1 + np.exp(-np.clip(total + model.bias, -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s)] + [pa.array(m[:, k]) for k in range(len(MARKS))], ["doc_id", "score", *MARKS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, score double, " + ", ".join(f"{m} double" for m in MARKS))
