"""Document fingerprints from Lempel-Ziv phrases: minimum hashes of the set of phrases of a text.

A text's UTF-8 bytes are parsed into phrases, each the shortest string not yet in the dictionary
(LZ78). The set of phrases is what a compressor would learn from the text. Their hashes fall into
SLOTS ranges; the least hash of every range makes the fingerprint (an empty range borrows from the
next one), and the share of equal slots estimates the Jaccard similarity of two sets. Every BLOCK
bytes a new dictionary is begun, so memory is bounded.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askloom.llm.common import BASE, mix, span_hashes

SLOTS = 128
BLOCK = 2 << 20
_SLOT = np.uint64(57)  # the first 7 bits of a hash name its slot
_NONE = np.uint64((1 << 64) - 1)

#: The bytes of a block, and its phrases as (node << 8 | byte) in the order they were made. Node 0 is
#: the empty phrase, node i the i-th phrase.
Block = tuple[bytes, np.ndarray]


def parse(children: dict[int, int], node: int, data: bytes) -> int:
    """LZ78 on from ``node``; new phrases are added to ``children``. Gives the node of the phrase under way."""
    find, fresh = children.setdefault, (len(children) + 1) << 8
    for byte in data:
        child = find(node | byte, fresh)
        if child == fresh:
            node = 0
            fresh += 256
        else:
            node = child
    return node


class Parsed:
    """Blocks of a text, and how to go on from where it ends."""

    def __init__(self, done: Sequence[Block] = (), open_: bytes = b"", children: dict[int, int] | None = None, node: int = 0):
        self.done, self.open, self.children, self.node = list(done), open_, children if children is not None else {}, node

    def copy(self) -> Parsed:
        return Parsed(self.done, self.open, dict(self.children), self.node)

    def feed(self, text: str) -> Parsed:
        data = text.encode("utf-8", "surrogatepass")
        while True:
            part, data = data[:BLOCK - len(self.open)], data[BLOCK - len(self.open):]
            self.node = parse(self.children, self.node, part)
            self.open += part
            if not data:
                return self
            self.done.append(self._closed())
            self.open, self.children, self.node = b"", {}, 0

    def _closed(self) -> Block:
        return self.open, np.fromiter(self.children.keys(), np.int64, len(self.children))

    def blocks(self) -> list[Block]:
        return [*self.done, self._closed()]


def phrase_hashes(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases of all blocks, and the block of each."""
    count = np.array([len(keys) for _, keys in blocks])
    first = np.cumsum(count + 1) - count - 1  # a root for each block
    up = np.arange(int(count.sum()) + len(blocks))
    own = np.ones(len(up), bool)
    own[first] = False
    up[own] = (np.concatenate([k for _, k in blocks]) >> 8) + np.repeat(first, count)
    length = own.astype(np.int64)
    while True:  # lengths of paths, twice as far every time
        more = length[up]
        if not more.any():
            break
        length, up = length + more, up[up]
    data = np.frombuffer(b"".join(b for b, _ in blocks), np.uint8)
    begin = np.cumsum([0, *(len(b) for b, _ in blocks)])[:-1]
    ends = np.cumsum(length)
    ends = (ends - np.repeat(ends[first] - begin, count + 1))[own]
    return span_hashes(data, ends - length[own], ends), np.repeat(np.arange(len(blocks)), count)


def fingerprint_texts(texts: list[list[Block]]) -> list[str]:
    """Fingerprints of texts given by their blocks: four hex digits a slot; empty without phrases."""
    least = np.full((len(texts), SLOTS), _NONE)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(owner):
        h, block = phrase_hashes([b for t in texts for b in t])
        np.minimum.at(least.ravel(), owner[block] * SLOTS + (h >> _SLOT).astype(np.int64), h)
    none = least == _NONE
    out = [""] * len(texts)
    some = np.flatnonzero(~none.all(axis=1))
    # an empty slot takes the next full one's value, told apart by the way to it
    twice = np.where(np.concatenate([none, none], axis=1), 2 * SLOTS, np.arange(2 * SLOTS))
    at = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :SLOTS]
    way = np.where(at < 2 * SLOTS, at - np.arange(SLOTS), 0).astype(np.uint64)
    value = mix(np.take_along_axis(least, at % SLOTS, axis=1) + way * BASE) >> np.uint64(48)
    for i in some.tolist():
        out[i] = value[i].astype(">u2").tobytes().hex()
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal slots; two empty texts are alike, an empty one is unlike any other."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(t), ">u2") for t in (a, b))
    return float((x == y).mean())


class Document:
    """A text parsed as a whole, and up to the code point where an edit begins."""

    name: str | None = None

    def __init__(self, text: str):
        self.text, self.kept = text, len(text) - len(text) // 4
        self.head = Parsed().feed(text[:self.kept])
        self.whole = self.head.copy().feed(text[self.kept:])

    def edited(self, after: str) -> tuple[str, Parsed]:
        """Text and parse with the first characters of ``after`` in place of the last quarter."""
        end = after[:len(self.text) - self.kept]
        return self.text[:self.kept] + end, self.head.copy().feed(end)


def name_all(documents: list[Document], more: list[Parsed]) -> list[str]:
    """Names the documents; fingerprints of the other parses."""
    new = list({id(d): d for d in documents if d.name is None}.values())
    names = fingerprint_texts([d.whole.blocks() for d in new] + [p.blocks() for p in more])
    for d, name in zip(new, names):
        d.name = name
    return names[len(new):]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row. Needs doc_id and text; a null text is an empty one.

    An empty text's fingerprint is empty. Equal texts have equal fingerprints. Null and repeated ids
    are rows like any other, other columns are ignored, an empty table gives an empty result. Memory
    is a text and a dictionary of BLOCK bytes.
    """
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(fingerprint_texts([Parsed().feed(t).blocks() for t in texts]), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _bounds(keyed: DataFrame, parts: int) -> list[tuple]:
    """First keys of ``parts`` ranges of about as many rows, ascending, no key twice."""
    lows = keyed.repartitionByRange(parts, "late", "doc_id", "key").groupBy(F.spark_partition_id()).agg(
        F.min(F.struct("late", "doc_id", "key")).alias("low"))
    return sorted({tuple(r["low"]) for r in lows.collect()})


def in_id_order(docs: DataFrame) -> DataFrame:
    """part, last, late, doc_id, key, text, n: all rows in ranges of ids, each with its successor's row.

    ``part`` is a range of (doc_id, text hash); the first row of the next range is there once more,
    marked ``last`` (the very first row comes after the very last), so every row but a marked one has its
    successor in its part. n counts equal rows that were one row of a batch before the shuffle. Only a
    key for each range passes through the driver.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _texts(docs).select(F.col("doc_id").isNull().cast("int").alias("late"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
                                F.xxhash64("text").alias("key"), "text")
    bounds = _bounds(keyed.select("late", "doc_id", "key"), parts)
    first = {b: (i or len(bounds)) - 1 for i, b in enumerate(bounds)}

    def run(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("late", "doc_id", "key"))))
            seen: dict[tuple, int] = {}
            count = [0] * len(keys)
            for i, key in enumerate(keys):
                count[seen.setdefault(key, i)] += 1
            own = list(seen.items())
            ahead = [(key, i) for key, i in own if key in first]
            take = pa.array([i for _, i in own + ahead], pa.int64())
            part = [bisect.bisect_right(bounds, key) - 1 for key, _ in own] + [first[key] for key, _ in ahead]
            cut = batch.take(take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([0] * len(own) + [1] * len(ahead), pa.int32()), *cut.columns,
                 pa.array([count[i] for _, i in own + ahead], pa.int64())],
                ["part", "last", "late", "doc_id", "key", "text", "n"])

    spread = keyed.mapInArrow(run, "part int, last int, late int, doc_id long, key long, text string, n long")
    return spread.repartition(parts // 4, "part").sortWithinPartitions("part", "last", "late", "doc_id", "key")


COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness, for every row.

    The edit replaces the last floor(n_chars / 4) code points by the first as many (or all) of the
    next document, by ascending doc_id; the last one is followed by the first. Rows of one doc_id are
    ordered by a hash of the text, rows without an id come last; a row equal to another in both is
    followed by it. A lone row follows itself. Other columns are ignored; a null text is an empty one; an
    empty table gives an empty result.
    """
    def run(batches):
        part = key = now = None
        n = held = 0
        pairs: list[tuple] = []  # id, document, successor, how often

        def rows():
            edits = [d.edited(after.text) for _, d, after, _ in pairs]
            names = name_all([d for p in pairs for d in p[1:3]], [e for _, e in edits])
            for (i, d, after, times), (text, _), name in zip(pairs, edits, names):
                row = (i, len(d.text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), d.name, name,
                       likeness(d.name, name), likeness(d.name, after.name))
                for lo in range(0, times, 4096):
                    yield from [row] * min(4096, times - lo)

        def flush():
            some = rows()
            while part := list(islice(some, 4096)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*part), kinds)], [c.split()[0] for c in COLUMNS.split(", ")])

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "last", "late", "doc_id", "key", "n")]
            texts = batch.column("text")
            for i, (p, last, *this, count) in enumerate(zip(*(c.to_pylist() for c in columns))):
                if p != part:
                    part, key, now = p, None, None
                if now is not None and not last and this == key:
                    n += count
                    continue
                if last and now is None:
                    continue  # the row after this range's last is known
                new = Document(texts[i].as_py())
                if now is not None:
                    doc_id = None if key[0] else key[1]
                    if n > 1:
                        pairs.append((doc_id, now, now, n - 1))
                    pairs.append((doc_id, now, new, 1))
                    held += len(now.text)
                    if len(pairs) >= 64 or held >= 1 << 20:
                        yield from flush()
                        pairs, held = [], 0
                key, now, n = (None, None, 0) if last else (this, new, count)
        if pairs:
            yield from flush()

    return in_id_order(docs).mapInArrow(run, COLUMNS)
