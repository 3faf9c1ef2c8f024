"""Phrase collocations by Toivonen's mining: a sample proposes, a full pass decides, failures expand.

A sample of the rows is mined with a lowered threshold. One pass over all rows then counts exactly
the proposed phrases and their negative border, that is every phrase whose proper parts are all
proposed but which is not itself (of those, the ones that occur at all). Border phrases that turn out
frequent are failures of the sample: further passes count the phrases that become possible with
them, until no pass finds a new frequent phrase.

Which phrases are known to be frequent is sent to the tasks as a bit map of bounded size. A false hit
counts a phrase that need not be counted, and its exact count shows that; nothing is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from askloom.llm.common import BASE, mix, pieces, span_hashes, stored, text_bytes, word_spans

LONGEST = 4
#: Bytes that end a piece, and those that end a word.
CUT = np.zeros(256, bool)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = CUT.copy()
GAP[[0x20, 0x09]] = True

SAMPLE = 8           # one row of so many proposes
LOWERED = 0.5        # of the threshold expected in the sample
BITS_EACH = 16       # of the map, two set for each phrase
MOST_BITS = 1 << 27  # 16 MB; beyond, more false hits
_CHUNK = 1 << 15
_HELD = 1 << 18      # words that a task counts together
_PART = 1 << 20      # bytes of text that it takes at a time
_ROW = 1 << 15       # bytes of counts in a row sent, about,
_BATCH = 1 << 22     # and in the rows that leave a task at once
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)

WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
_SCHEMA = ", ".join(f"{w} long" for w in WORDS) + ", lang string, word string, a long"

#: Counts of equal length and language: language (words only), words by place, texts (words only), counts.
Counts = tuple[str | None, list[np.ndarray], list[bytes] | None, np.ndarray]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


def _spots(h: np.ndarray, size: int, turn: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a map of ``size`` bytes (a power of two) for each phrase."""
    x = mix(h ^ turn)
    low = np.uint64(size * 8 - 1)
    return (x & low).astype(np.int64), (x >> np.uint64(64 - (size * 8 - 1).bit_length())).astype(np.int64)


class Marks:
    """A set of phrases as bits: never a false miss. Beginnings of phrases are marked apart."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray, begins: bool = False) -> np.ndarray:
        first, second = _spots(h, len(self.bits), _SECOND if begins else np.uint64(0))
        out = self._set(first)
        at = np.flatnonzero(out)
        out[at] = self._set(second[at])
        return out

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """One number for each phrase; words are given by place."""
    h = words[0]
    for w in words[1:]:
        h = mix(h * BASE + w)
    return h


def _marks(frequent: DataFrame):
    """Bit map of a table of phrases, broadcast; its size follows their number up to MOST_BITS."""
    spark = frequent.sparkSession
    n = frequent.count()
    size = min(MOST_BITS, max(_CHUNK, 1 << (max(1, n) * BITS_EACH - 1).bit_length())) // 8

    def spots(batches):
        for batch in batches:
            w = [batch.column(c).to_numpy().view(np.uint64) for c in WORDS]
            k = sum((c != 0).astype(int) for c in w)
            for length in range(1, LONGEST + 1):
                for turn, at in ((np.uint64(0), k == length), (_SECOND, k > length)):
                    for spot in _spots(phrase_hash([c[at] for c in w[:length]]), size, turn):
                        yield pa.RecordBatch.from_arrays([pa.array(spot // _CHUNK), pa.array(spot % _CHUNK)], ["chunk", "spot"])

    def fill(batches):
        bits, last = None, None
        for batch in batches:
            chunk, spot = batch.column("chunk").to_numpy(), batch.column("spot").to_numpy()
            for lo in [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1)]:
                hi = int(np.searchsorted(chunk, chunk[lo], "right"))
                if chunk[lo] != last:
                    if bits is not None:
                        yield made(last, bits)
                    bits, last = np.zeros(_CHUNK, np.uint8), chunk[lo]
                bits[spot[lo:hi]] = 1
        if bits is not None:
            yield made(last, bits)

    def made(chunk, bits):
        return pa.RecordBatch.from_arrays(
            [pa.array([int(chunk)]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["chunk", "bits"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (frequent.select(*WORDS).mapInArrow(spots, "chunk long, spot long").distinct()
            .repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(fill, "chunk long, bits binary").collect())
    bits = np.zeros(size, np.uint8)
    for r in rows:
        bits[r["chunk"] * _CHUNK // 8:(r["chunk"] + 1) * _CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits)


class _Counter:
    """Counts of the phrases in a task, given words in order; emptied every _HELD words."""

    def __init__(self, known: Marks | None, new: Marks | None, longest: int, words: bool):
        self.known, self.new, self.longest, self.words = known, new, longest, words
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.names: list[tuple] = []
        self.size = 0

    def add(self, w: np.ndarray, first: np.ndarray, carried: int) -> None:
        """Words and which of them begin a piece. The first ``carried`` were here before: only phrases
        that end after them are counted."""
        self.held.append((w, first, carried))
        self.size += len(w) - carried

    def phrases(self) -> Iterator[Counts]:
        if not self.held:
            return
        w = np.concatenate([h[0] for h in self.held])
        first = np.concatenate([h[1] for h in self.held])
        old = np.concatenate([np.arange(len(h[0])) < h[2] for h in self.held])
        for h, at in zip(self.held, np.cumsum([0, *(len(h[0]) for h in self.held)])):
            if len(h[0]):
                first[at] = True  # what is added is apart from what was added before
        self.held, self.size = [], 0
        for at, k in self._expanded(w, first) if self.new is not None else self._border(w, first):
            at = at[~old[at + k - 1]]
            yield summed(None, [w[at + j] for j in range(k)], None, np.ones(len(at), np.int64))

    def _border(self, w, first):
        """Places of the phrases whose parts are all known, by length."""
        h, start = w, np.arange(len(w))
        for k in range(2, self.longest + 1):
            here = np.zeros(len(w) + 1, bool)
            here[start[self.known.has(h)]] = True
            start = _going(np.flatnonzero(here[:-1] & here[1:]), first, k)
            h = phrase_hash([w[start + j] for j in range(k)])
            yield start, k

    def _expanded(self, w, first):
        """Places of the phrases of known parts of which one is new, by length."""
        h, start = w, np.arange(len(w))
        for k in range(2, self.longest + 1):
            new = start[self.new.has(h)]
            at = _going(np.union1d(new, new[new > 0] - 1), first, k)
            for lo in (0, 1):
                at = at[self.known.has(phrase_hash([w[at + lo + j] for j in range(k - 1)]))]
            yield at, k
            start = _going(start[self.new.has(h, begins=True)], first, k)
            h = phrase_hash([w[start + j] for j in range(k)])


def _going(at: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Those of the places where k words of one piece begin; k - 1 words are known to do so, or follow
    a place where they do."""
    at = at[at + k <= len(first)]
    for j in range(1, k):
        at = at[~first[at + j]]
    return at


def summed(lang: str | None, cols: list[np.ndarray], names: list[bytes] | None, n: np.ndarray) -> Counts:
    """Each phrase once, in the order of its hash, with the sum of its counts."""
    h = phrase_hash(cols)
    order = np.argsort(h, kind="stable")
    h = h[order]
    sorted_ = [c[order] for c in cols]
    change = np.ones(len(h), bool)
    change[1:] = False
    for c in sorted_:
        change[1:] |= c[1:] != c[:-1]
    if (change[1:] & (h[1:] == h[:-1])).any():  # different phrases of one hash may stand mixed
        order = np.lexsort([*cols, phrase_hash(cols)])
        sorted_ = [c[order] for c in cols]
        change[1:] = False
        for c in sorted_:
            change[1:] |= c[1:] != c[:-1]
    lo = np.flatnonzero(change)
    total = np.add.reduceat(n[order], lo) if len(lo) else n[:0]
    return lang, [c[lo] for c in sorted_], names and [names[i] for i in order[lo].tolist()], total


def _pack(counts: Iterable[Counts], ids: int) -> Iterator[tuple[int, bytes]]:
    """Counts cut into ranges of the hash: (range, bytes), one or more rows of about _ROW bytes for each."""
    shift = np.uint64(64 - ids.bit_length() + 1)
    out: dict[int, list[bytes]] = {}
    for lang, cols, names, n in counts:
        cuts = np.searchsorted((phrase_hash(cols) >> shift).astype(np.int64), np.arange(ids + 1))
        tag = b"" if lang is None else lang.encode()
        step = max(1, _ROW // (8 * len(cols) + 8))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            held = out.setdefault(i, [])
            for lo in range(int(cuts[i]), int(cuts[i + 1]), step):
                hi = min(lo + step, int(cuts[i + 1]))
                size = n[lo:hi]
                size = size.astype(np.uint8 if size.max() < 256 else np.int64)
                text = b"\n".join(names[lo:hi]) if names else b""
                head = np.array([len(cols), hi - lo, size.itemsize, -1 if lang is None else len(tag), len(text)], np.int64)
                held.append(b"".join([head.tobytes(), *(c[lo:hi].tobytes() for c in cols), size.tobytes(), tag, text]))
                if sum(map(len, held)) >= _ROW:
                    yield i, b"".join(held)
                    held.clear()
    for i, parts in out.items():
        if parts:
            yield i, b"".join(parts)


def _batches(rows: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows (range, bytes) as batches of about _BATCH bytes."""
    id_, data, size = [], [], 0
    for i, b in rows:
        id_.append(i)
        data.append(b)
        size += len(b)
        if size >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(id_, pa.int32()), pa.array(data, pa.binary())], ["id", "counts"])
            id_, data, size = [], [], 0
    if id_:
        yield pa.RecordBatch.from_arrays([pa.array(id_, pa.int32()), pa.array(data, pa.binary())], ["id", "counts"])


def _unpack(data: bytes) -> Iterator[Counts]:
    at = 0
    while at < len(data):
        k, n, wide, tag, text = np.frombuffer(data, np.int64, 5, at).tolist()
        at += 40
        cols = [np.frombuffer(data, np.uint64, n, at + 8 * n * j) for j in range(k)]
        at += 8 * n * k
        size = np.frombuffer(data, np.uint8 if wide == 1 else np.int64, n, at).astype(np.int64)
        at += wide * n
        lang = None if tag < 0 else data[at:at + tag].decode()
        at += max(tag, 0)
        yield lang, cols, None if tag < 0 else data[at:at + text].split(b"\n"), size
        at += text


def _words(data, offsets, langs):
    """Per part of the texts: hashes (by language) of its words, which begin a piece, words of the part
    before that are still needed, and the words' places in the (lowered) bytes."""
    seed = {lang: np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")) for lang in set(langs)}
    seeds = np.array([seed[lang] for lang in langs], np.uint64)
    last, carry, broken = -1, np.zeros(0, np.uint64), True
    for text, part, offs in pieces(data, offsets, _PART, GAP):
        part = lowered(part)
        starts, ends = word_spans(part, offs, GAP)
        owner = text + np.searchsorted(offs, starts, "right") - 1
        w = mix(span_hashes(part, starts, ends) ^ seeds[owner])
        w[w == 0] = 1  # 0 stands for no word
        cuts = np.concatenate([[0], np.cumsum(CUT[part])])
        first = np.ones(len(w), bool)
        if len(w):
            first[1:] = (cuts[starts[1:]] != cuts[ends[:-1]]) | (owner[1:] != owner[:-1])
            going = text == last and not broken and cuts[starts[0]] == 0
            first[0] = not going
        begun = carry if text == last and not broken else carry[:0]
        yield w, first, begun, starts, ends, part, owner
        if len(w):
            piece = np.flatnonzero(first)
            carry = np.concatenate([begun if not len(piece) else begun[:0], w[piece[-1] if len(piece) else 0:]])[-(LONGEST - 1):]
            broken = bool(cuts[-1] != cuts[ends[-1]])
        else:
            carry, broken = begun, broken or bool(cuts[-1]) or text != last
        last = text + len(offs) - 2


def _names(w, starts, ends, part, owner, langs) -> Iterator[Counts]:
    """Words with their text and count, by language."""
    _, at, n = np.unique(w, return_index=True, return_counts=True)
    raw = part.tobytes()
    mine = np.array(langs)[owner[at]]
    for lang in set(mine.tolist()):
        here = np.flatnonzero(mine == lang)
        names = [raw[a:b] for a, b in zip(starts[at[here]].tolist(), ends[at[here]].tolist())]
        yield summed(lang, [w[at[here]]], names, n[here])


def _joined(counts: list[Counts]) -> Counts:
    names = None if counts[0][2] is None else [x for c in counts for x in c[2]]
    return summed(counts[0][0], [np.concatenate(c) for c in zip(*(c[1] for c in counts))], names, np.concatenate([c[3] for c in counts]))


def counted(texts: DataFrame, floor: int, known=None, new=None, longest: int = LONGEST, words: bool = True) -> DataFrame:
    """w1 .. w4, lang, word, a: exact counts, of ``floor`` or more, over rows (lang, text).

    Counts the words (with ``words``; only these have lang and word, and rows with w1 = 0 add up to the
    number of words of a language), and the phrases of 2 .. ``longest`` words whose parts of one
    word less are all in ``known`` and, with ``new``, not all outside that.

    A task counts _HELD words at a time and sends the counts, cut into ranges of the phrase's hash, as
    rows of bytes; ranges meet in tasks that add up one range after the other. Rows and batches are
    small, so that neither side of the Python boundary holds more than a few MB of them.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = 1 << (4 * parts - 1).bit_length()

    def run(batches):
        count = _Counter(known and Marks(known.value), new and Marks(new.value), longest, words)
        names: dict[str, list[Counts]] = {}
        size = 0

        def rows():
            yield from _batches(_pack(chain(count.phrases(), map(_joined, names.values())), ids))
            names.clear()

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for w, first, begun, *where in _words(data, offsets, langs):
                if not len(w):
                    continue
                if longest > 1:
                    count.add(np.concatenate([begun, w]), np.concatenate([np.arange(len(begun)) == 0, first]), len(begun))
                if words:
                    for c in _names(w, *where, langs):
                        names.setdefault(c[0], []).append(c)
                size += len(w)
                if size >= _HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    def add(batches):
        held: dict[tuple, list[Counts]] = {}
        last = None
        total: dict[str, int] = {}

        def frequent():
            for counts in held.values():
                lang, cols, names, n = _joined(counts)
                if names is not None:
                    total[lang] = total.get(lang, 0) + int(n.sum())
                at = np.flatnonzero(n >= floor)
                for lo in range(0, len(at), 1 << 16):
                    some = at[lo:lo + (1 << 16)]
                    zero = [pa.array(np.zeros(len(some), np.int64))] * (LONGEST - len(cols))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c[some].view(np.int64)) for c in cols), *zero, pa.array([lang] * len(some), pa.string()),
                         pa.array([names[i].decode() for i in some.tolist()] if names else [None] * len(some), pa.string()),
                         pa.array(n[some])], [*WORDS, "lang", "word", "a"])
            held.clear()

        for batch in batches:
            for i, data in zip(batch.column("id").to_pylist(), batch.column("counts")):
                if i != last:
                    yield from frequent()
                    last = i
                for c in _unpack(data.as_py()):
                    held.setdefault((c[0], len(c[1])), []).append(c)
        yield from frequent()
        if total:
            zero = pa.array(np.zeros(len(total), np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[zero] * LONGEST, pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()),
                 pa.array(list(total.values()), pa.int64())], [*WORDS, "lang", "word", "a"])

    sent = texts.select("lang", "text").mapInArrow(run, "id int, counts binary")
    return sent.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(add, _SCHEMA)


def frequent_phrases(docs: DataFrame, floor: int = 30, longest: int = LONGEST) -> DataFrame:
    """w1 .. w4, lang, word, a: every phrase of up to ``longest`` words that occurs ``floor`` times or
    more in texts of one language, with its exact count (columns as of ``counted``)."""
    spread = [c for c in ("doc_id", "text") if c in docs.columns]
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
                        (F.pmod(F.xxhash64(*spread), F.lit(SAMPLE)) == 0).alias("proposes"))
    sample = stored(texts.where("proposes").select("lang", "text"), "sample")
    low = max(2, round(floor / SAMPLE * LOWERED))
    is_word = F.col("w2") == 0

    # the sample, level by level
    proposed = stored(counted(sample, low, longest=1).where("w1 <> 0").drop("lang", "word"), "proposed")
    marks, level = _marks(proposed), proposed
    for k in range(2, longest + 1):
        last = marks if k == 2 else _marks(level)
        level = stored(counted(sample, low, marks, last, k, words=False).drop("lang", "word").where(F.col(f"w{k}") != 0), "proposed")
        proposed = proposed.unionByName(level)
        marks = _marks(proposed)

    # all rows: words, proposals and their border
    found = stored(counted(texts, floor, marks, longest=longest), "phrases")
    fresh = found.where("w1 <> 0").join(proposed.select(*WORDS), WORDS, "left_anti")
    fresh = stored(fresh.select(*WORDS), "failures")
    while longest > 1 and fresh.take(1):
        known = _marks(found.where("w1 <> 0"))
        more = stored(counted(texts, floor, known, _marks(fresh), longest, words=False)
                      .join(found.where(~is_word).select(*WORDS), WORDS, "left_anti").select(found.columns), "phrases")
        found, fresh = found.unionByName(more), more.select(*WORDS)
    return found


def _inner(k: int, lo: int, n: int) -> str:
    """SQL for n words of a phrase from the lo-th on, as w1 .. w4."""
    return ", ".join(f"w{lo + j} as w{j}" if j <= n else f"0L as w{j}" for j in range(1, LONGEST + 1))


def _struct(lo: int, n: int, *more: str) -> str:
    fields = [f"'p{j}', " + (f"w{lo + j}" if j <= n else "0L") for j in range(1, LONGEST + 1)]
    return f"named_struct({', '.join([*fields, *more])})"


def _by_length(make) -> str:
    """An array of structs for a phrase of any length, by SQL text for each length."""
    cases = " ".join(f"when w{k + 1} = 0 then {make(k)}" for k in range(2, LONGEST))
    return f"explode(case {cases} else {make(LONGEST)} end)"


def collocations(docs: DataFrame, top: int = 2000, floor: int = 30) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of every language.

    Needs lang and text (doc_id, if there, spreads the sample); other columns are ignored. A-Z are
    lowered, texts are cut at [.,;:!?\\x0A-\\x0D] into pieces and these into words [^\\x20\\x09]+. Null
    texts are empty, a null lang is ``und``; repeated rows count as often as they occur; an empty
    table, or one without a phrase of ``floor`` occurrences, gives an empty result. Phrases have 2 to
    4 words. Cut after its first k words a phrase of a occurrences scores
    floor(2000000 * a / (l + r)) with l and r the occurrences of its parts; the least score counts,
    of equal ones that of the least k. A phrase inside a longer one that occurs at least 0.8 times as
    often is left out. Phrases of a language are ranked by score, then a, both descending, then by
    the bytes of the phrase. Arithmetic is exact (decimals).

    Words are told apart by 64-bit hashes that include the language: about 0.03 words are expected to
    share one at 10^9 different words.
    """
    found = frequent_phrases(docs, floor)
    phrases = found.where("w2 <> 0").select(*WORDS, "a")
    some = found.where("w1 <> 0").select(*[F.col(w).alias(w.replace("w", "p")) for w in WORDS], F.col("a").alias("f"), "lang")
    parts = [f"p{j}" for j in range(1, LONGEST + 1)]

    cuts = phrases.selectExpr(*WORDS, "a", _by_length(lambda k: "array(" + ", ".join(
        _struct(lo, n, "'cut'", str(c), "'side'", str(side))
        for c in range(1, k) for side, lo, n in ((0, 0, c), (1, c, k - c))) + ")") + " as part").select(*WORDS, "a", "part.*")
    sides = cuts.join(some, parts).groupBy(*WORDS, "a", "cut").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"),
        F.max("lang").alias("lang"))
    big = "cast({} as decimal(20, 0))".format
    score = f"(cast(2000000 as decimal(8, 0)) * {big('a')}) div ({big('l')} + {big('r')})"
    scored = sides.withColumn("score", F.expr(score)).groupBy(*WORDS, "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("s"), F.max("lang").alias("lang"))

    inner = phrases.where("w3 <> 0").selectExpr("a as longer", _by_length(lambda k: "array(" + ", ".join(
        _struct(lo, n) for n in range(2, k) for lo in range(k - n + 1)) + ")" if k > 2 else f"array({_struct(0, 2)})") + " as part")
    inner = inner.select(*[F.col(f"part.p{j}").alias(f"w{j}") for j in range(1, LONGEST + 1)], "longer").groupBy(*WORDS).agg(
        F.max("longer").alias("longer"))
    left = scored.join(inner, WORDS, "left").where(
        f"longer is null or 100 * {big('longer')} < 80 * {big('a')}")
    left = left.select(*WORDS, "lang", "a", "s.l", "s.r", "s.score")

    # the best of a language: first of each part of it, so that no task gets a whole language
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*WORDS), F.lit(salts))
    best = [F.desc("score"), F.desc("a")]
    left = left.withColumn("salt", salt)
    left = left.withColumn("at", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("at") <= top)
    left = stored(left.drop("at"), "best")
    words = found.where("w1 <> 0 and w2 = 0").select(F.col("w1").alias("h"), "word")
    names = left.select(*WORDS, F.posexplode(F.array(*WORDS)).alias("at", "h")).where("h <> 0").join(words, "h")
    names = names.groupBy(*WORDS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    left = left.join(names, WORDS)
    order = [*best, F.col("phrase")]
    for group in (["lang", "salt"], ["lang"]):
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= top)
    n = found.where("w1 = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    return left.join(n, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS p
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY ALL HAVING k = 1 OR count(*) >= 30),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1),
cuts AS (SELECT lang, k, p, a, unnest(range(1, k)) AS c FROM cand),
scored AS (
  SELECT x.lang, x.k, x.p, x.a, min(row(((2000000::HUGEINT * x.a) // (l.a::HUGEINT + r.a))::BIGINT, x.c, l.a, r.a)) AS s
  FROM cuts AS x JOIN f AS l ON l.lang = x.lang AND l.p = x.p[1:x.c] JOIN f AS r ON r.lang = x.lang AND r.p = x.p[x.c + 1:x.k]
  GROUP BY ALL),
inside AS (
  SELECT lang, p[i:i + m - 1] AS p, max(a) AS longer FROM (
    SELECT lang, p, k, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand WHERE k > 2))
  GROUP BY ALL),
rest AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.s[1] AS score, s.s[3] AS l, s.s[4] AS r
  FROM scored AS s LEFT JOIN inside AS i ON i.lang = s.lang AND i.p = s.p
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM rest JOIN n USING (lang) QUALIFY rank <= 2000
"""
