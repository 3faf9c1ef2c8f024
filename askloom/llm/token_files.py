"""Token ids as Arrow files of fixed-size lists: equal-length sequences and their masks.

A data set is a folder of shards, each a pair of Arrow IPC files: ``*.ids.arrow`` has record
batches of ``ids`` (fixed-size list of SEQUENCE unsigned integers) and ``mask`` (fixed-size list of
booleans; false is padding at a shard's end), ``*.docs.arrow`` has doc_id, at, n_tokens for each
document. Batches are uncompressed, so a memory-mapped file gives any sequence as a view.
Documents of a shard follow each other without gaps; shards follow in ascending doc_id order.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from askloom.llm.common import stored, text_bytes  # noqa: F401
from askloom.session import scratch_path

SEQUENCE = 1024
ROWS = 256  # sequences in a record batch
MEMO = 500_000  # pieces a worker remembers

#: White space as the pre-tokenizer sees it. It never joins other characters to white space on
#: their right, so a text may be cut wherever white space follows something else.
_GAP = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_GAP}]*[^{_GAP}]+|[{_GAP}]+")
#: In Latin texts letters and digits are known, so the pre-tokenizer's own cuts can be made here.
_BEYOND = re.compile(r"[^\x00-\u024f]")
_LETTER, _DIGIT = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_GAP}{_LETTER}{_DIGIT}]+"
                    f"|[{_GAP}]+(?![^{_GAP}])|[{_GAP}]+")


class Encoder:
    """Encodes texts piece by piece with the tokenizers library; a piece seen before is remembered."""

    def __init__(self, path: str, width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = width
        steps = json.loads(self.tok.to_str())["pre_tokenizer"] or {}
        self.byte_level = steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space")
        self.whole = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if any(w in text for w in self.whole):  # such a token may span white space
            return self._ids([text])[0]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        parts = (_LATIN if self.byte_level and not _BEYOND.search(text) else _PIECE).findall(text)
        try:
            return b"".join(map(memo.__getitem__, parts))
        except KeyError:
            new = [p for p in dict.fromkeys(parts) if p not in memo]
            memo.update(zip(new, self._ids(new)))
            return b"".join(map(memo.__getitem__, parts))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, width: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(folder if re.match(r"\w+:", folder) else f"file://{folder}")
    return fs, base.rstrip("/")


def width_for(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _write_shard(folder: str, part: int, docs: Iterator[tuple[int | None, bytes]], width: str):
    """Write one shard; its name is new with every attempt, so a repeated task harms nothing."""
    fs, base = _open(folder)
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    kind = pa.from_numpy_dtype(np.dtype(width))
    schema = pa.schema([("ids", pa.list_(kind, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])
    index = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64())])
    step, size = SEQUENCE * ROWS, np.dtype(width).itemsize
    waiting, rows, total = bytearray(), [], 0
    with fs.open_output_stream(f"{base}/{name}.ids.arrow") as f, fs.open_output_stream(f"{base}/{name}.docs.arrow") as g, \
            pa.ipc.new_file(f, schema) as ids, pa.ipc.new_file(g, index) as where:

        def batch(raw: bytes):
            flat = np.frombuffer(raw, width)
            full = -(-len(flat) // SEQUENCE) * SEQUENCE
            mask = np.arange(full) < len(flat)
            flat = np.concatenate([flat, np.zeros(full - len(flat), width)])
            ids.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(flat, kind), SEQUENCE),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQUENCE)], schema=schema))

        def note():
            if rows:
                where.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=index))
                rows.clear()

        for doc_id, raw in docs:
            rows.append((doc_id, total, len(raw) // size))
            total += len(raw) // size
            waiting += raw
            while len(waiting) >= step * size:
                batch(bytes(waiting[:step * size]))
                del waiting[:step * size]
            if len(rows) >= 10_000:
                note()
        if waiting:
            batch(bytes(waiting))
        note()
    return name, total


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; gives the manifest.

    Columns used: doc_id, text. A null text is an empty one (one id, ``end_id``); null ids come
    first; rows of one id stand beside each other, shorter texts first, then in text order. Ids fit two bytes where
    the vocabulary has at most 65,536 entries, else four. ``folder`` must be reachable from all
    workers. The manifest (part, name, total) is a written table, so each shard counts once
    however often its task was tried. An empty table gives an empty manifest.
    """
    from tokenizers import Tokenizer

    width = width_for(Tokenizer.from_file(tokenizer).get_vocab_size())
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    end = np.array([end_id], width).tobytes()
    part = F.spark_partition_id()
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    dealt = (docs.select("doc_id", text.alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first())
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.length("text"), "text").select(part.alias("part"), "doc_id", "text"))

    def write(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        code = encoder(tokenizer, width)

        def rows():
            for b in _chain(first, batches):
                ids, texts = b.column(1).to_pylist(), b.column(2)
                for i, d in enumerate(ids):
                    yield d, code.encode(texts[i].as_py()) + end

        no = first.column(0)[0].as_py()
        name, total = _write_shard(folder, no, rows(), width)
        yield pa.RecordBatch.from_pylist([{"part": no, "name": name, "total": total}])

    return stored(dealt.mapInArrow(write, "part long, name string, total long"), "manifest")


def _chain(first, rest):
    yield first
    yield from rest


class TokenShard:
    """Random access to a shard; sequences and masks are views of the mapped file where it is local."""

    def __init__(self, folder: str, name: str):
        fs, base = _open(folder)
        path = f"{base}/{name}"
        local = isinstance(fs, pafs.LocalFileSystem)
        self._ids = pa.ipc.open_file(pa.memory_map(f"{path}.ids.arrow") if local else fs.open_input_file(f"{path}.ids.arrow"))
        self._docs = pa.ipc.open_file(pa.memory_map(f"{path}.docs.arrow") if local else fs.open_input_file(f"{path}.docs.arrow"))

    def _batch(self, k: int) -> pa.RecordBatch:
        return self._ids.get_batch(k)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence i: its ids, and its mask."""
        row = self._batch(i // ROWS)
        return row.column(0)[i % ROWS].values.to_numpy(zero_copy_only=True), row.column(1)[i % ROWS].values

    def span(self, at: int, n: int) -> Iterator[np.ndarray]:
        """Ids at .. at + n, a view for each batch they lie in."""
        step = SEQUENCE * ROWS
        while n > 0:
            flat = self._batch(at // step).column(0).flatten().to_numpy(zero_copy_only=True)
            part = flat[at % step:at % step + n]
            yield part
            at, n = at + len(part), n - len(part)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for k in range(self._docs.num_record_batches):
            b = self._docs.get_batch(k)
            yield from zip(*(c.to_pylist() for c in b.columns))


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    ``start`` counts the ids of all documents before it. A shard is read batch by batch by one
    task; the window runs over one row per shard.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("before", F.coalesce(F.sum("total").over(w), F.lit(0)).cast("long"))
    starts = starts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                shard, out = TokenShard(folder, row["name"]), []
                for doc_id, at, n in shard.documents():
                    crc = 0
                    for ids in shard.span(at, n):
                        crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"), crc)
                    out.append((doc_id, row["before"] + at, n, crc))
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    return starts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_digests(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write all documents, read the files back, and give what they hold for each document."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    return read_token_files(spark, write_token_files(docs, tokenizer, folder), folder)
