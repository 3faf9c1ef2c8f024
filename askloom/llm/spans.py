"""Repeated byte spans: column-wise construction over all texts, aligned at content-chosen anchors.

Two equal windows of WINDOW bytes have the same anchor at the same place: the least, by hash, of
the GRAM-byte strings in them. So only texts around anchors whose string occurs more than once
can hold repeats, and equal windows stand in the same column when such pieces are aligned at
their anchors. A group of pieces round one string is a collection for the column-wise
construction: columns are read from the right, each round puts one byte before every piece's
current suffix, a stable counting of that byte gives the next order of suffixes (the round's
column of the transform), and the common prefixes of neighbours follow from those of the round
before. A window is repeated where a neighbour shares WINDOW bytes or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askloom.llm.common import BASE, as_signed, mix, powers, stored, text_bytes
from askloom.llm.tiles import over_tiles

WINDOW = 200
GRAM = 64
REACH = WINDOW - GRAM        # bytes a window may begin before its anchor
COLUMNS = REACH + WINDOW     # of aligned pieces
LARGEST = 1 << 15            # pieces that a task sorts together; larger groups are split by window
_PART = 1 << 21
_POS = np.uint64((1 << 22) - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "node", F.xxhash64("text"))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of one text: place, first and last window, hash of the string there.

    Of equal strings in a window the leftmost is its anchor. Long texts are read in parts that
    overlap by a window, so memory does not follow the text's length.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    found = []
    for at in range(0, n, _PART):
        part = data[at:at + _PART + WINDOW - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(len(part)), out=sums[1:])
        m = len(part) - GRAM + 1
        hashes = mix((sums[GRAM:] - sums[:-GRAM]) * _inverse(m))
        order = (hashes & ~_POS) | np.arange(m, dtype=np.uint64)
        width = REACH + 1
        full = -(-m // width) * width
        pad = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
        pad[:m] = order
        blocks = pad.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - width + 1
        place = (np.minimum(behind[:windows], ahead[width - 1:width - 1 + windows]) & _POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [windows]]) - 1
        found.append((place[first] + at, first + at, last + at, hashes[place[first]]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _inverse(n: int) -> np.ndarray:
    from askloom.llm.common import BASE_INV

    return powers(n, BASE_INV)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """key (hash of the anchor's string), node, spot: place * 2**16 + (place - first) * 2**8 + place - last."""
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            node = batch.column("node").to_numpy()
            keys, nodes, spots = [], [], []
            for i in range(batch.num_rows):
                place, first, last, h = anchors(data[offs[i]:offs[i + 1]])
                keys.append(as_signed(h))
                nodes.append(np.full(len(h), node[i]))
                spots.append(place << 16 | (place - first) << 8 | (place - last))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(spots))],
                ["key", "node", "spot"])

    return _keyed(docs).select("node", "text").mapInArrow(run, "key long, node long, spot long")


def _pieces(texts: DataFrame) -> DataFrame:
    """node, spot, key, piece: the bytes that an anchor's windows cover."""
    def run(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            at = batch.column("at")
            if isinstance(at, pa.ChunkedArray):
                at = at.combine_chunks()
            flat = at.flatten()
            count = np.diff(at.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), count)
            key, spot = flat.field(0), flat.field(1).to_numpy()
            place = spot >> 16
            begin = offs[row] + place - (spot >> 8 & 255)
            end = offs[row] + place - (spot & 255) + WINDOW
            raw = data.tobytes()
            out = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            node = batch.column("node").to_numpy()[row]
            for s in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[s:s + 4096]), pa.array(spot[s:s + 4096]), key.slice(s, 4096),
                     pa.array(out[s:s + 4096], pa.binary())], ["node", "spot", "key", "piece"])

    return texts.select("node", "text", "at").mapInArrow(run, "node long, spot long, key long, piece binary")


def repeated_columns(rows: np.ndarray, first: np.ndarray, last: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows are repeated: a bit for each row and each of the REACH + 1 columns they begin at.

    rows: aligned pieces, (n, COLUMNS) bytes; row i is filled from column first[i] to before end[i]
    and has windows at columns first[i] .. last[i]; group: ascending group of each row. One round per column.
    """
    n = len(rows)
    out = np.zeros((n, REACH + 1), bool)
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)  # common[k]: bytes shared by suffixes k - 1 and k of the order
    base = group.astype(np.int64) * 512
    columns = np.ascontiguousarray(rows.T)
    for c in range(COLUMNS - 1, -1, -1):
        symbol = columns[c][order].astype(np.int64)
        past = (end[order] <= c) | (first[order] > c)  # no byte here: equal to nothing
        code = base[order] + np.where(past, 256, symbol)
        turn = np.argsort(code, kind="stable")
        code = code[turn]
        same = np.flatnonzero((code[1:] == code[:-1]) & ~past[turn[1:]]) + 1
        new = np.zeros(n + 1, np.int32)
        if len(same):
            pairs = np.empty(2 * len(same), np.int64)
            pairs[::2], pairs[1::2] = turn[same - 1] + 1, turn[same] + 1
            new[same] = np.minimum.reduceat(np.append(common, 0), pairs)[::2] + 1
        order, common = order[turn], new
        if c <= REACH:
            hit = (common[:-1] >= WINDOW) | (common[1:] >= WINDOW)
            at = order[hit]
            out[at[(first[at] <= c) & (c <= last[at])], c] = True
    return out


def _sort_pieces(rows: pa.Table, bounds: np.ndarray):
    data, offs = text_bytes(rows.column("piece"))
    spot = rows.column("spot").to_numpy()
    n = rows.num_rows
    before, after = spot >> 8 & 255, spot & 255
    first, last = REACH - before, REACH - after
    size = np.diff(offs)
    grid = np.zeros((n, COLUMNS), np.uint8)
    row = np.repeat(np.arange(n), size)
    grid[row, np.arange(len(data)) - np.repeat(offs[:-1], size) + np.repeat(first, size)] = data
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = repeated_columns(grid, first, last, first + size, group)
    bits = np.packbits(found, axis=1)
    yield pa.RecordBatch.from_arrays(
        [rows.column("sid").combine_chunks(), pa.array([b.tobytes() for b in bits], pa.binary())], ["sid", "windows"])


def _split_windows(large: DataFrame) -> DataFrame:
    """sid, windows for groups too large for a task: every window by itself, counted by its hash.

    The count is taken before the shuffle too, so a window of very many pieces is a row per task.
    """
    def run(batches):
        for batch in batches:
            sid, spot, key = (batch.column(c).to_numpy() for c in ("sid", "spot", "key"))
            data, offs = text_bytes(batch.column("piece"))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
            count = np.diff(offs) - WINDOW + 1
            row = np.repeat(np.arange(len(sid)), count)
            at = np.repeat(offs[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            h = mix((sums[at + WINDOW] - sums[at]) * _inverse(max(1, len(data)))[at])
            column = REACH - (spot >> 8 & 255)[row] + at - offs[:-1][row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid[row]), pa.array(as_signed(mix(h + key[row].view(np.uint64) * BASE))), pa.array(column)], ["sid", "h", "col"])

    w = large.select("sid", "spot", "key", "piece").mapInArrow(run, "sid long, h long, col long")
    w = stored(w, "windows")
    twice = w.groupBy("h", "col").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    hit = w.join(twice, ["h", "col"]).groupBy("sid").agg(F.sort_array(F.collect_set("col")).alias("cols"))
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(REACH // 8)), lambda b: F.aggregate(
        F.sequence(F.lit(0), F.lit(7)), F.lit(0),
        lambda s, k: s * 2 + F.array_contains("cols", (b * 8 + k).cast("long")).cast("int")))
    return hit.select("sid", F.unhex(F.array_join(F.transform(bytes_, lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("windows"))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies, spans, texts): what of which text occurs elsewhere.

    copies: node, copies (rows of that text); spans: node, spans (sorted array of struct begin, past
    of repeated byte runs, which may overlap) for texts with any, from matches with other texts or within;
    texts: node, text of those that might have any. node is a 64-bit hash of the text; a text that
    has copies is repeated as a whole and need not be in spans.
    """
    keyed = _keyed(docs)
    copies = keyed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    copies = stored(copies, "copies")
    found = _anchor_rows(docs)
    one = F.xxhash64("node", "spot")
    shared = (found.groupBy("key").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("key"))
    near = stored(found.join(stored(shared, "shared"), "key").distinct(), "anchors")
    at = near.groupBy("node").agg(F.collect_list(F.struct("key", "spot")).alias("at")).join(copies, "node")
    # one row of each text; rows that repeat both id and text give equal pieces, which are one below
    texts = stored(keyed.alias("d").join(at.alias("a"), F.expr("d.node = a.node and d.doc_id <=> a.least"))
                   .select("d.node", "text", "at"), "texts")
    low = F.col("spot").bitwiseAND(F.lit(65535))
    cut = _pieces(texts).withColumn("sid", F.xxhash64("key", low, "piece"))
    cut = stored(cut, "pieces")
    places = stored(cut.select("sid", "node", "spot").distinct(), "places")
    distinct = cut.groupBy("sid").agg(F.first("key").alias("key"), F.first(low).alias("spot"), F.first("piece").alias("piece"))
    sizes = cut.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("key")
    groups = stored(distinct.join(sizes, "key"), "groups")
    counts = groups.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    groups = groups.join(counts, "key")
    masks = over_tiles(groups.where(F.col("size") <= LARGEST).select("key", "sid", "spot", "piece"), ["key"], _sort_pieces,
                       "sid long, windows binary", order=("sid",))
    large = stored(groups.where(F.col("size") > LARGEST), "large")
    if large.take(1):
        masks = masks.unionByName(_split_windows(large))
    twice = places.groupBy("sid").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # one row for each piece that has a repeat; a piece at very many places is split in this join
    marks = stored(masks.join(twice, "sid", "full"), "marks")
    marked = places.join(marks, "sid")

    def ranges(batches):
        for batch in batches:
            spot = batch.column("spot").to_numpy()
            place, first, last = spot >> 16, REACH - (spot >> 8 & 255), REACH - (spot & 255)
            whole = batch.column("m").is_valid().to_numpy(zero_copy_only=False)
            node, bits = batch.column("node").to_numpy(), batch.column("windows")
            cols = np.arange(REACH + 1)
            flags = np.zeros((len(spot), REACH + 1), bool)
            have = np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False))
            if len(have):
                raw = np.frombuffer(b"".join(bits.take(pa.array(have)).to_pylist()), np.uint8).reshape(len(have), -1)
                flags[have] = np.unpackbits(raw, axis=1)[:, :REACH + 1].astype(bool)
            flags |= whole[:, None]
            flags &= (cols >= first[:, None]) & (cols <= last[:, None])
            step = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            i, a = np.nonzero(step == 1)
            _, b = np.nonzero(step == -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[i]), pa.array(place[i] - REACH + a), pa.array(place[i] - REACH + b - 1 + WINDOW)],
                ["node", "begin", "past"])

    runs = marked.select("node", "spot", "m", "windows").mapInArrow(ranges, "node long, begin long, past long")
    spans = runs.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("begin", "past"))).alias("spans"))
    return copies, spans, texts.select("node", "text")


def _kept(texts: DataFrame, spans: DataFrame, as_text: bool) -> DataFrame:
    """node, n_removed, n_spans, kept (bytes, or text without torn characters) of texts with repeated windows."""
    kind = pa.string() if as_text else pa.binary()

    def run(batches):
        for batch in batches:
            texts_ = batch.column("text").cast(pa.binary())
            out = []
            for i in range(batch.num_rows):
                raw, runs = texts_[i].as_py(), batch.column("spans")[i].values
                begin, past = runs.field(0).to_numpy(), np.maximum.accumulate(runs.field(1).to_numpy())
                new = np.flatnonzero(np.concatenate([[True], begin[1:] > past[:-1]]))
                a, b = begin[new], past[np.concatenate([new[1:] - 1, [len(past) - 1]])]
                edges = zip(np.concatenate([[0], b]).tolist(), np.concatenate([a, [len(raw)]]).tolist())
                left = b"".join(raw[x:y] for x, y in edges)
                out.append((int((b - a).sum()), len(a), left.decode("utf-8", "ignore") if as_text else left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                 pa.array([x[2] for x in out], kind)], ["node", "n_removed", "n_spans", "kept"])

    return texts.dropDuplicates(["node"]).join(spans, "node").select("node", "text", "spans").mapInArrow(
        run, f"node long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def without_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """node, n_removed, n_spans, kept: one row for each text that loses something.

    ``kept`` is bytes, or with ``as_text`` a string from which characters torn by a cut are left out.

    Needs doc_id and text; a null text is an empty one. Every byte covered by a WINDOW-byte string
    that also starts elsewhere, in the same or another row, is removed; strings are judged on the
    input. A text that occurs in several rows and has WINDOW bytes or more is lost whole. node is
    a 64-bit hash of the text (``_keyed``).
    """
    copies, spans, texts = repeated_spans(docs)
    whole = _keyed(docs).select("node", F.octet_length("text").cast("long").alias("n"))
    whole = (whole.where(F.col("n") >= WINDOW).groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n_removed"))
             .where("m > 1").select("node", "n_removed", F.lit(1).cast("long").alias("n_spans"), F.lit("" if as_text else b"").alias("kept")))
    some = _kept(texts.join(copies.where("copies = 1").select("node"), "node"), spans, as_text)
    return some.unionByName(whole)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; other columns are ignored."""
    lost = stored(without_repeats(docs).withColumn("sha", F.sha2("kept", 256)).drop("kept"), "lost")
    every = _keyed(docs).select("doc_id", "node", F.octet_length("text").cast("long").alias("n_bytes"),
                                F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    return every.join(lost, "node", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
