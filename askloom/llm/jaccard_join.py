"""Jaccard self-join of word n-gram sets by chosen paths.

A document's set is sketched by SKETCH minima of hashed n-grams; (position, minimum) pairs are the
tokens. A run starts with all documents in one bucket and splits every bucket on tokens chosen by
a hash of (bucket, token), 1 / (threshold * SKETCH) of them, so a pair at the threshold is
expected to stay together once. Buckets of up to SMALL documents, and those still larger after
DEPTH splits (in tiles), are compared by brute force on sketches; RUNS repeats reach the target
recall. Before, large groups of near copies are found by the first splits of FIRST runs. Pairs that the sketches leave possible form groups, and all pairs of a group are then
compared exactly on their whole sets.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askloom.llm.common import (
    BASE, as_signed, mix, pieces, run_hashes, span_hashes, stored, text_bytes, word_spans)
from askloom.llm.components import connected_components, forest
from askloom.llm.tiles import over_tiles, with_tiles

SKETCH = 64
SMALL = 256
DEPTH = 4
FIRST = 4        # runs whose first large buckets form groups
BLOCK = 1024     # rows of a tile's side in the exact comparison,
BLOCK_MB = 16    # or so many MB of their n-grams
TILE = ["path", "lo", "hi", "side", "node", "grp", "sketch"]
SLACK = 4.0  # standard deviations that a sketch's estimate may fall short of the threshold
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def runs_for(threshold: float, recall: float) -> int:
    """Repeats after which a pair at the threshold has met, even in a bucket of full depth."""
    alive = 1.0
    for _ in range(DEPTH):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log1p(-alive))


def least_matches(threshold: float) -> int:
    return math.ceil(SKETCH * threshold - SLACK * math.sqrt(SKETCH * threshold * (1 - threshold)))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(1, 1 << 63, SKETCH, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, SKETCH, np.uint64)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and each text's bounds."""
    data, offsets = text_bytes(column)
    words, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, part, offs in pieces(data, offsets):
        starts, ends = word_spans(part, offs)
        words.append(span_hashes(part, starts, ends))
        texts.append(first + np.searchsorted(offs, starts, "right") - 1)
    texts = np.concatenate(texts)
    return np.concatenate(words), np.searchsorted(texts, np.arange(len(column) + 1))


def text_key(text: str):
    """64-bit hash of a text, null where it has no word."""
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, node (``text_key``) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("node"), "text")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, node, sketch (SKETCH 32-bit minima as bytes; null without words) and grams (their number) of every text."""
    def run(batches):
        mult, add = _multipliers()
        for batch in batches:
            words, bounds = _words(batch.column("text"))
            grams, gb = run_hashes(words, bounds, width)
            full = np.flatnonzero(np.diff(gb))
            sig = np.zeros((len(full), SKETCH), np.uint32)
            step = max(1, (1 << 21) // max(1, int(np.diff(gb).max(initial=1))))
            for lo in range(0, len(full), step):  # a bounded number of n-grams at a time
                rows = full[lo:lo + step]
                g, cut = grams[gb[rows[0]]:gb[rows[-1] + 1]], gb[rows] - gb[rows[0]]
                for k in range(SKETCH):
                    sig[lo:lo + len(rows), k] = np.minimum.reduceat((g * mult[k] + add[k]) >> np.uint64(32), cut)
            out = [None] * batch.num_rows
            for i, r in zip(full.tolist(), sig):
                out[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(out, pa.binary()), pa.array(np.diff(gb))],
                ["doc_id", "node", "sketch", "grams"])

    return _keyed(docs).mapInArrow(run, "doc_id long, node long, sketch binary, grams long")


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    return data.view(np.uint32).reshape(-1, SKETCH) if len(data) else np.zeros((0, SKETCH), np.uint32)


def _split(rows: DataFrame, threshold: float, starts: list[int] | None = None) -> DataFrame:
    """(path, node, grp) one level down; ``starts`` are the paths of the runs' first buckets."""
    chosen = np.uint64(int((1 << 64) / (threshold * SKETCH)))

    def run(batches):
        where = np.arange(SKETCH, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            node, grp = batch.column("node").to_numpy(), batch.column("grp").to_numpy()
            token = _matrix(batch.column("sketch")).astype(np.uint64) | where
            above = [np.full(len(node), s, np.uint64) for s in starts] if starts else [
                batch.column("path").to_numpy().view(np.uint64)]
            paths, at = [], []
            for path in above:
                h = mix(token * BASE + mix(path * _SECOND)[:, None])
                i, j = np.nonzero(mix(h + np.uint64(1)) < chosen)
                paths.append(h[i, j])
                at.append(i)
            at = np.concatenate(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_signed(np.concatenate(paths))), pa.array(node[at]), pa.array(grp[at])], ["path", "node", "grp"])

    return rows.mapInArrow(run, "path long, node long, grp long")


def _compare_sketches(least: int):
    """u, v: links between groups so far, one less than there are groups in a tile at most."""
    def fn(rows: pa.Table, bounds: np.ndarray):
        grp, sig = rows.column("grp").to_numpy(), _matrix(rows.column("sketch"))
        side, lo, hi = (rows.column(c).to_numpy() for c in ("side", "lo", "hi"))
        size = np.diff(bounds)
        two = bounds[:-1][(size == 2)]
        two = two[grp[two] != grp[two + 1]]
        ok = (sig[two] == sig[two + 1]).sum(axis=1) >= least
        u, v = [grp[two[ok] + 1]], [grp[two[ok]]]
        for k in np.flatnonzero(size > 2):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if (grp[a:b] == grp[a]).all():
                continue
            names, part = np.unique(grp[a:b], return_inverse=True)
            cut = b - a if lo[a] == hi[a] else int((side[a:b] == lo[a]).sum())
            left, shift = sig[a:a + cut], 0 if lo[a] == hi[a] else cut
            right = sig[a + shift:b]
            ii, jj = [], []
            step = max(1, (1 << 22) // max(1, len(right) * SKETCH))
            for s in range(0, cut, step):
                same = (left[s:s + step, None, :] == right[None, :, :]).sum(axis=2, dtype=np.uint8)
                i, j = np.nonzero(same >= least)
                i, j = part[i + s], part[j + shift]
                ii.append(i[i != j])
                jj.append(j[i != j])
            if ii:
                root = forest(len(names), np.concatenate(ii), np.concatenate(jj))
                at = np.flatnonzero(root != np.arange(len(names)))
                u.append(names[at])
                v.append(names[root[at]])
        u, v = np.concatenate(u), np.concatenate(v)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
    return fn


def possible_links(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """node, root: groups that hold every two classes (node, sketch) which the sketches leave possible.

    Groups are formed from the first large buckets of some runs (``_first_links``). All runs then
    look only into buckets of more than one group and only make links between groups, since
    comparing within a group adds nothing: a large group of near copies is compared once, not in
    every run and level. Until the end groups may be parts of what hangs together; that costs
    comparisons, not links.
    """
    starts = [int(mix(np.array([1000 + r], np.uint64))[0]) for r in range(runs_for(threshold, recall))]
    first = _first_links(classes, threshold, starts[:FIRST])
    groups = stored(_part_groups(first), "groups")
    rest = _pass(_with_groups(classes, groups), threshold, starts)
    return connected_components(rest.unionByName(first))


def _first_links(classes: DataFrame, threshold: float, starts: list[int]) -> DataFrame:
    """u, v: some of the links in buckets of over SMALL rows after one split of these runs, by ``first_tiles``."""
    level = stored(_split(classes.withColumn("grp", F.col("node")), threshold, starts), "paths")
    large = level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SMALL)
    rows = level.join(large, "path").join(classes.select("node", "sketch"), "node")
    return _links(first_tiles(rows), threshold)


def _part_groups(links: DataFrame) -> DataFrame:
    """node, grp: a node of the same component, the least one where two rounds find it."""
    return connected_components(links, rounds=2).withColumnRenamed("root", "grp")


def _links(tiles: DataFrame, threshold: float) -> DataFrame:
    return stored(over_tiles(tiles.select(TILE), ["path", "lo", "hi"], _compare_sketches(least_matches(threshold)), "u long, v long"), "links")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (node) with the group they are in by now."""
    return rows.join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node"))


def first_tiles(rows: DataFrame) -> DataFrame:
    """Blocks of SMALL rows of large buckets, each with itself and with the first: about three rows for one."""
    n = F.ceil(F.col("size") / SMALL).cast("long")
    d = rows.withColumn("side", F.pmod(F.xxhash64("node", F.lit(17)), n))
    zero = F.lit(0).cast("long")
    d = d.withColumn("other", F.explode(F.when(F.col("side") == 0, F.sequence(zero, n - 1)).otherwise(F.array(zero, F.col("side")))))
    return d.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))


def rest_tiles(rows: DataFrame) -> DataFrame:
    """Tiles of large buckets (path, node, grp) that hold every two rows of different groups.

    Groups of over half a block get blocks of their own, which need not meet each other; the other
    rows of a bucket are cut into blocks that meet all. So the rows grow with those outside the
    bucket's large groups, not with the square of a group.
    """
    groups = rows.groupBy("path", "grp").agg(F.count(F.lit(1)).alias("n"))
    owner = F.when(F.col("n") > SMALL // 2, F.col("grp"))
    parts = groups.groupBy("path", owner.alias("owner")).agg(F.sum("n").alias("n"))
    block = F.xxhash64(F.coalesce("owner", F.lit(0).cast("long")), F.col("owner").isNull(), F.col("at"))
    blocks = parts.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / SMALL).cast("long") - 1)))
    blocks = blocks.select("path", F.col("owner").alias("theirs"), block.alias("other"))
    large = groups.where(F.col("n") > SMALL // 2).select("path", "grp", F.col("n").alias("many"))
    pool = parts.where("owner is null").select("path", F.col("n").alias("few"))
    d = rows.join(large, ["path", "grp"], "left").join(pool, "path", "left")
    d = d.withColumn("owner", F.when(F.col("many").isNotNull(), F.col("grp")))
    cut = F.ceil(F.coalesce("many", "few") / SMALL).cast("long")
    d = d.withColumn("at", F.pmod(F.xxhash64("node", F.lit(17)), cut)).withColumn("side", block)
    d = d.join(blocks, "path").where("owner is null or theirs is null or owner <> theirs")
    return d.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))


def _pass(classes: DataFrame, threshold: float, starts: list[int]) -> DataFrame:
    """u, v: links between the groups of classes (node, grp, sketch) that these runs find, and of every
    class with its group.

    A bucket of a few large groups and few other rows is compared at once: that is less than to split it.
    """
    classes = stored(classes.select("node", "grp", "sketch"), "classes")
    level = stored(_split(classes, threshold, starts), "paths")
    few, whole, found, depth = [], [], [], 1
    while True:
        sizes = level.groupBy("path").agg(
            F.count(F.lit(1)).alias("size"), F.min("grp").alias("a"), F.max("grp").alias("b")).where("a <> b").drop("a", "b")
        large = F.col("size") > SMALL
        rows = stored(level.drop("grp").join(sizes, "path").join(classes, "node"), "buckets")
        few.append(with_tiles(rows.where(~large), ["path"], "size", "node", SMALL))
        more = rows.where(large)
        empty = not more.take(1)
        last = empty or depth == DEPTH
        if not last:
            near = stored(_nearly_whole(more), "buckets")
            whole.append(more.join(near, "path", "left_semi"))
            more = more.join(near, "path", "left_anti")
        if last:  # the tiles of all levels at once: paths differ between levels
            tiles = [t.select(TILE) for t in few]
            if whole:
                tiles.append(rest_tiles(reduce(DataFrame.unionByName, whole)).select(TILE))
            found.append(_links(reduce(DataFrame.unionByName, tiles), threshold))
            if empty:
                break
            wide = _pools(more).where(F.col("few") > SMALL).withColumn("size", F.col("few"))
            if wide.take(1):
                found.append(_links(first_tiles(wide), threshold))
                groups = stored(_part_groups(_with_members(reduce(DataFrame.unionByName, found), classes)), "groups")
                more = stored(_mixed(_with_groups(more.drop("grp"), groups)), "buckets")
            found.append(_links(rest_tiles(more), threshold))
            break
        level = stored(_split(more, threshold), "paths")
        depth += 1
    return _with_members(reduce(DataFrame.unionByName, found), classes)


def _nearly_whole(rows: DataFrame) -> DataFrame:
    """path of the buckets with up to SMALL rows outside their large groups, and up to four of those."""
    sizes = rows.groupBy("path", "grp").agg(F.count(F.lit(1)).alias("n"))
    is_large = F.col("n") > SMALL // 2
    return sizes.groupBy("path").agg(
        F.sum(F.when(is_large, 0).otherwise(F.col("n"))).alias("few"), F.count(F.when(is_large, 1)).alias("many")).where(
        (F.col("few") <= SMALL) & (F.col("many") <= 4)).select("path")


def _with_members(links: DataFrame, classes: DataFrame) -> DataFrame:
    return links.unionByName(classes.where("node <> grp").select(F.col("node").alias("u"), F.col("grp").alias("v")))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one group."""
    mixed = rows.groupBy("path").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).where("a <> b").select("path")
    return rows.join(mixed, "path", "left_semi")


def _pools(rows: DataFrame) -> DataFrame:
    """Rows outside the large groups of their bucket, and few: how many those are."""
    sizes = rows.groupBy("path", "grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= SMALL // 2)
    pool = sizes.groupBy("path").agg(F.sum("n").alias("few"))
    return rows.join(sizes.select("path", "grp"), ["path", "grp"], "left_semi").join(pool, "path")


def _sets(rows: DataFrame, width: int, kept: str) -> DataFrame:
    """n-gram sets (sorted distinct 64-bit hashes, as bytes) in place of the text."""
    names = kept.split()

    def run(batches):
        for batch in batches:
            words, bounds = _words(batch.column("text"))
            grams, gb = run_hashes(words, bounds, width)
            sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(gb[:-1].tolist(), gb[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(sets, pa.binary())], [*names, "grams"])

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", grams binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted distinct hashes, by a matrix product of
    membership over the hashes that occur on both sides, some thousand columns at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    ra = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rb = np.repeat(np.arange(len(right)), [len(x) for x in right])
    names = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float64)
    if not len(names):
        return out
    ca, cb = np.minimum(np.searchsorted(names, a), len(names) - 1), np.minimum(np.searchsorted(names, b), len(names) - 1)
    ka, kb = names[ca] == a, names[cb] == b
    ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
    step = max(256, (8 << 20) // (len(left) + len(right)))
    for s in range(0, len(names), step):
        w = min(step, len(names) - s)
        ia, ib = (ca >= s) & (ca < s + w), (cb >= s) & (cb < s + w)
        ma, mb = np.zeros((len(left), w), np.float32), np.zeros((len(right), w), np.float32)
        ma[ra[ia], ca[ia] - s] = 1
        mb[rb[ib], cb[ib] - s] = 1
        out += ma @ mb.T
    return out


def _compare_sets(threshold: float):
    def fn(rows: pa.Table, bounds: np.ndarray):
        node, n, group = (rows.column(c).to_numpy() for c in ("node", "n", "grp"))
        side, lo, hi = (rows.column(c).to_numpy() for c in ("side", "lo", "hi"))
        data, offs = text_bytes(rows.column("grams"))
        grams = data.view(np.uint64)
        offs = offs // 8
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a < 2:
                continue
            if (node[a:b - 1] == node[a + 1:b]).any():  # a row given twice is one document's text
                once = np.flatnonzero(np.concatenate([[True], node[a + 1:b] != node[a:b - 1]])) + a
                yield from fn(rows.take(pa.array(once)), np.array([0, len(once)]))
                continue
            cut = b - a if lo[a] == hi[a] else int((side[a:b] == lo[a]).sum())
            shift = 0 if lo[a] == hi[a] else cut
            sets = [grams[offs[k]:offs[k + 1]] for k in range(a, b)]
            size = np.diff(offs[a:b + 1]).astype(float)
            both = intersections(sets[:cut], sets[shift:])
            # J >= threshold, in whole numbers: both * 1000 >= (all) * threshold * 1000
            i, j = np.nonzero(both * 1000 >= np.round(threshold * 1000) * (size[:cut, None] + size[None, shift:] - both))
            j = j + shift
            if not shift:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            part, m = node[a:b], n[a:b]
            links = np.bincount(i, m[j], b - a) + np.bincount(j, m[i], b - a)
            root = part[forest(b - a, i, j)]
            for block, lo_, hi_ in ((lo[a], 0, cut), (hi[a], cut, b - a)):
                at = np.flatnonzero(links[lo_:hi_]) + lo_
                if len(at):
                    out.append((group[a], block, np.stack([part[at], links[at].astype(np.int64), root[at]]).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))],
                                             ["grp", "block", "found"])
    return fn


def _added(found: DataFrame) -> DataFrame:
    """node, links, root: what the tiles of one block found, as one row for each node, and how their
    components hang together. Rows follow the nodes, not the nodes times the blocks they met."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def one(held: list[bytes]):
        node, links, root = np.concatenate([np.frombuffer(f, np.int64).reshape(3, -1) for f in held], axis=1)
        names, at = np.unique(np.concatenate([node, root]), return_inverse=True)
        least = names[forest(len(names), at[:len(node)], at[len(node):])]
        total = np.zeros(len(names), np.int64)
        np.add.at(total, at[:len(node)], links)
        keep = (total > 0) | (least != names)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (names, total, least)], ["node", "links", "root"])

    def run(batches):
        last, held = None, []
        for batch in batches:
            for g, k, f in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "found"))):
                if (g, k) != last and held:
                    yield one(held)
                    held = []
                last = g, k
                held.append(f)
        if held:
            yield one(held)

    return found.repartition(parts, "grp", "block").sortWithinPartitions("grp", "block").mapInArrow(
        run, "node long, links long, root long")


def similar_documents(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999,
                      by_text: bool = False) -> DataFrame:
    """doc_id, n_links, class_id, kept for every row.

    With ``by_text`` instead one row for each different text with a word: node (``text_key``),
    and kept for one text of each class, that of the least id, nulls last, then of the least node.

    Needs doc_id and text; other columns are ignored. Sets are of ``width`` words (runs of
    [^\\x20\\x09-\\x0D]); a text of fewer words has one n-gram of all its words, and a null or
    empty text has none and links with nothing. Equal texts become one class before the join (by
    a 64-bit hash), so copies are never paired; they count in n_links. class_id is the least doc_id reachable by links; null ids count as partners but name
    no class. Rows that repeat a doc_id are documents of their own; kept is true where doc_id is
    the class_id.
    """
    made = stored(sketches(docs, width), "sketches")
    classes = stored(made.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"),
        F.first("grams").alias("grams")), "classes")
    groups = stored(possible_links(classes, threshold, recall).withColumnRenamed("root", "grp"), "groups")
    # blocks of a group follow its rows and the bytes of their n-grams
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("grams") / (BLOCK_MB << 17)))
    members = groups.join(classes.select("node", "n", "least", "grams"), "node")
    sizes = members.groupBy("grp").agg(blocks.cast("long").alias("size"))
    # one text of each class that is in a group
    wanted = members.drop("grams").join(sizes, "grp")
    texts = _keyed(docs).alias("d").join(wanted.alias("w"), F.expr("d.node = w.node and d.doc_id <=> w.least")).select(
        "grp", "w.node", "size", "n", "text").dropDuplicates(["node"])  # rows may repeat both id and text
    sets = _sets(texts, width, "grp node size n")
    tiles = with_tiles(sets, ["grp"], "size", "node", 1).select("grp", "lo", "hi", "side", "node", "n", "grams")
    found = stored(_added(over_tiles(tiles, ["grp", "lo", "hi"], _compare_sets(threshold), "grp long, block long, found binary")), "links")
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    done = (classes.select("node", "n", "least").join(links, "node", "left").join(roots, "node", "left")
            .withColumn("root", F.coalesce("root", "node")))
    if by_text:
        first = done.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("first"))
        return done.join(first, "root").select("node", (F.col("node") == F.col("first.node")).alias("kept"))
    names = done.groupBy("root").agg(F.min("least").alias("class_id"))
    done = done.join(names, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "class_id")
    out = made.select("doc_id", "node").join(done, "node", "left").select(
        "doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))
