"""BPE encoding with a priority queue of merge ranks over a linked symbol list, and decoding."""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_GAP = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[^{_GAP}]+")
#: Latin texts take a short way: their characters are composed, and lower case one by one.
_BEYOND = re.compile(r"[^\x00-\u012f\u0131-\u024f]")
_LETTER, _DIGIT = r"a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
MEMO = 500_000  # pieces a worker remembers


def merge_word(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges to one word's symbols, lowest rank first, leftmost first within a rank.

    Symbols form a doubly linked list over positions. The queue holds (rank, position, pair); an
    entry is stale, and skipped, when its position no longer starts that pair.
    """
    n = len(symbols)
    ids = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        found = merges.get((ids[i], ids[i + 1]))
        if found:
            queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, new = heapq.heappop(queue)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue
        ids[i], ids[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if found := merges.get((new, ids[k])):
                heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
        h = before[i]
        if h >= 0 and (found := merges.get((ids[h], new))):
            heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
    return [x for x in ids if x >= 0]


class Bpe:
    """A BPE vocabulary file's model. Normalizing and cutting into words is the file's own pipeline.

    Texts are cut at white space first, Latin texts into words at once by the file's own pattern;
    the parts do not affect each other, so what a part becomes is remembered. Added tokens are matched in the raw text, the leftmost first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, tok = spec["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("unk_token") or model.get(
                "continuing_subword_prefix") or model.get("dropout") or spec.get("decoder"):
            raise ValueError("only plain BPE vocabularies without decoder are supported")
        self.normalize = tok.normalizer.normalize_str if tok.normalizer else str
        self.cut = tok.pre_tokenizer.pre_tokenize_str
        self.vocab = model["vocab"]
        self.tail = model.get("end_of_word_suffix") or ""
        self.strings = {i: s for s, i in self.vocab.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.memo: dict[str, bytes] = {}
        self.latin = None
        if [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
            pattern = (steps[0].get("pattern") or {}).get("Regex", "")
            if steps[0].get("invert") and steps[0].get("behavior") == "Removed" and re.fullmatch(
                    r"(?:'\w+\|)*\[\\p\{L\}\]\+\|\[\\p\{N\}\]\|\[\^\\s\\p\{L\}\\p\{N\}\]\+", pattern):
                heads = pattern[:pattern.index("[")]
                self.latin = re.compile(f"{heads}[{_LETTER}]+|[{_DIGIT}]|[^{_GAP}{_LETTER}{_DIGIT}]+")

    def _piece(self, piece: str) -> bytes:
        out: list[int] = []
        for word, _ in self.cut(self.normalize(piece)):
            known = [*word[:-1], word[-1] + self.tail]
            out += merge_word([self.vocab[c] for c in known if c in self.vocab], self.merges)
        return np.array(out, np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if self.split is not None and any(a in text for a in self.added):
            return b"".join(np.int32(self.added[t]).tobytes() if t in self.added else self._plain(t)
                            for t in self.split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if self.latin is not None and not _BEYOND.search(text):
            parts = self.latin.findall(text.lower())
        else:
            parts = _PIECE.findall(text)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            return b"".join(map(memo.__getitem__, parts))
        except KeyError:
            for p in parts:
                if p not in memo:
                    memo[p] = self._piece(p)
            return b"".join(map(memo.__getitem__, parts))

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings of the ids, with the blank between them that a file without decoder asks for."""
        get = self.strings
        return " ".join([get[i] for i in ids])


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One model for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) of every whole text; rows stay in their tasks.

    A null or empty text has no ids and decodes to the empty text. Ids may be null or repeat;
    other columns are dropped.
    """
    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            texts = batch.column(1)
            raw = [bpe.encode(texts[i].as_py() or "") for i in range(batch.num_rows)]
            ends = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
            ids = np.frombuffer(b"".join(raw), np.int32)
            plain = [bpe.decode(np.frombuffer(r, np.int32).tolist()) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(plain, pa.string())],
                ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of ids (decimal, one blank between) and decoded text, and ``more`` columns."""
    return coded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
