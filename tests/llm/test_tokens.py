import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnframe.llm import byte_bpe, token_counts
from tarnframe.llm.byte_pairs import merger_of_ranks, read_ranks
from tarnframe.llm.token_counts import count_tokens, prove_whole_tokens

SIGNS = "\t\n\r   \x85\xa0\x1c 　​'stré́中😀²½Ⅷ٠019A!.﻿\x00"


def noise(n):
    rng = random.Random(4)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(n)]


def encoding():
    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library(frame, awkward):
    texts = awkward + [(100 + i, x) for i, x in enumerate(noise(300))] + [(500, "a<|endoftext|>b <|endoftext|>"), (501, "don't we'll 's"), (502, "the" * 2000)]
    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(frame(texts)).collect())
    expected = []
    for i, x in texts:
        n = len(reference.encode(x or "", add_special_tokens=False).ids)
        expected.append((str(i), len((x or "").encode()), n, n > 1024))
    assert found == sorted(expected)
    assert count_tokens(frame([])).collect() == []


def test_whole_tokens_are_proven():
    proven = prove_whole_tokens(P.path("byte_bpe_50k.json"))
    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = random.Random(1).sample(sorted(proven.whole), 500)
    assert all(len(reference.encode(x, add_special_tokens=False).ids) == 1 for x in some)
    assert "<|endoftext|>" not in proven.whole


def test_encoding_equals_the_library_and_decodes(frame, awkward):
    texts = awkward + [(100 + i, x) for i, x in enumerate(noise(300))]
    reference = encoding()
    expected = sorted((str(i), tuple(reference.encode_ordinary(x or "")), (x or "").encode()) for i, x in texts)
    # tiny blocks: many meet in the word partitions, and long texts are blocks by themselves
    encoded = byte_bpe.encode(frame(texts).repartition(3), text_per_block=2000, decoded=True)
    rows = encoded.collect()
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in rows) == expected
    assert all(r.n_tokens == len(r.ids) // 4 for r in rows)
    again = byte_bpe.decode(encoded.select("doc_id", "ids")).collect()
    assert sorted(hashlib.sha256(r.decoded).hexdigest() for r in again) == sorted(hashlib.sha256(t).hexdigest() for _, _, t in expected)
    assert byte_bpe.encode(frame([])).collect() == []


def test_blocks_of_late_tasks_have_numbers():
    ids, texts = pa.array([1, 2]), pa.array(["a b c", None])
    for task in (1 << 19, 1 << 31):
        rows = byte_bpe._pack_block(ids, texts, byte_bpe.splitter(P.PATTERN), 4, task, 5000)
        batch = byte_bpe._as_batch(rows)
        assert set(batch.column("task").to_pylist()) == {task} and len(set(batch.column("block").to_pylist())) == 1
        assert set(batch.column("part").to_pylist()) <= set(range(4))


def test_merging_many_equals_one_by_one():
    rng = random.Random(2)
    pieces = [bytes(rng.randrange(256) for _ in range(rng.randrange(90))) for _ in range(300)] + [b"", b"a" * 64, b"a" * 65, b"tion" * 9, b""]
    for merger in (merger_of_ranks(read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))), prove_whole_tokens(P.path("byte_bpe_50k.json")).merger):
        flat, counts = merger.many(pieces)
        one = [merger.ids(x) for x in pieces]
        assert flat.tolist() == [i for found in one for i in found] and counts.tolist() == list(map(len, one))
    assert merger.many([])[1].tolist() == []


def test_memos_start_anew(frame, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 500)
    monkeypatch.setattr(token_counts, "MEMO_RUNS", 3)
    texts = [(i, x) for i, x in enumerate(noise(60))] + [(90, "中文" * 40_000 + " 中文")]
    reference = encoding()
    rows = byte_bpe.encode(frame(texts), text_per_block=300).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: reference.encode_ordinary(x) for i, x in texts}
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counted = {r.doc_id: r.n_tokens for r in count_tokens(frame(texts)).collect()}
    assert counted == {i: len(library.encode(x, add_special_tokens=False).ids) for i, x in texts}


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        prove_whole_tokens(P.path("word_bpe_49k.json"))


def test_decode_beside_a_column_of_its_name(frame):
    encoded = byte_bpe.encode(frame([(1, "ab")])).withColumn("Decoded", F.lit(1))
    assert byte_bpe.decode(encoded).columns == ["doc_id", "n_tokens", "decoded_", "Decoded"]


def test_number_planes_round_trip():
    rng = np.random.default_rng(0)
    for top in (100, 5000, 80_000, 2_000_000, 9_000_000):
        numbers = rng.integers(0, top, 4000)
        assert (byte_bpe.numbers_of_planes(*byte_bpe.number_planes(numbers)) == numbers).all()


def test_long_pieces_by_heap():
    merger, reference = merger_of_ranks(read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))), encoding()
    for word in ("ab" * 500, "thequickbrownfox" * 30, "é" * 333):
        assert merger.ids(word.encode()) == reference.encode_ordinary(word)
