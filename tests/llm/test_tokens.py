"""Token files and BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from askloom.llm import bpe, token_files

POOL = ["a", "B", "É", "e", " ", "  ", "\n", "\x1c", "\x85", "​", "　", "'s", "'", "1", "２", "!", "<|endoftext|>",
        "<|startoftext|>", "日本", "́", "\r\n", "it's", "\x00", "😀", "Σ", "İ", "ß", "the", "ing", "Hello", "ﬁ", "²", "ª"]


def _random_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(POOL, k=rnd.randint(0, 14))) for _ in range(n)]


def test_bpe_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    want, got = Tokenizer.from_file(path), bpe.Bpe(path)
    for text in _random_texts(5000):
        ids = want.encode(text, add_special_tokens=False).ids
        mine = np.frombuffer(got.encode(text), np.int32).tolist()
        assert mine == ids, text
        assert got.decode(mine) == want.decode(ids, skip_special_tokens=False)


def test_merging_is_by_rank_then_place():
    merges = {(1, 1): (1, 2), (2, 1): (0, 3)}
    assert bpe.merge_word([1, 1, 1], merges) == [3]
    assert bpe.merge_word([1] * 4, merges) == [3, 1]
    assert bpe.merge_word([], merges) == [] and bpe.merge_word([7], merges) == [7]


def test_bpe_of_odd_rows(frame, odd_rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                 for r in bpe.digests(bpe.encode_decode(frame(odd_rows), path)).collect())
    want = []
    for d, t, _ in odd_rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((str(d), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_decode(frame([]), path).count() == 0


def test_pieces_encode_as_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    want, got = Tokenizer.from_file(path), token_files.Encoder(path, "<u4")
    for text in _random_texts(5000, 2):
        assert np.frombuffer(got.encode(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("shards", [1, 5])
def test_token_files_round_trip(spark, frame, odd_rows, tmp_path, shards):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/t{shards}"
    manifest = token_files.write_token_files(frame(odd_rows), path, folder, shards=shards)
    got = token_files.read_token_files(spark, manifest, folder).orderBy("start").collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""), r[1] or ""))
    at = 0
    for r, (d, t, _) in zip(got, order, strict=True):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert tuple(r) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    name = manifest.orderBy("part").first()["name"]
    shard = token_files.TokenShard(folder, name)
    ids, mask = shard.sequence(0)
    assert len(ids) == token_files.SEQUENCE and not ids.flags.owndata and pa.types.is_boolean(mask.type)
    assert token_files.write_token_files(frame([]), path, folder + "e").count() == 0
