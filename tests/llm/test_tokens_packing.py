import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from watchpost.llm import packing, token_files
from watchpost.llm.encode import TextEncoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library_on_odd_texts(path):
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "don't", "'s", "12", "\u00e9", "e\u0301", "\u00a0", "\x1c",
             "!!", "<|endoftext|>", "\u0130", "\u03a3", "\u4e2d", "Word.", "x,y", "\u3000", "\U0001f600", "<|EndOfText|>", "<|startoftext|>", "<|"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(400)]
    enc = TextEncoder(path)
    for text, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, enc.dtype).tolist() == ids_of(path, text), repr(text)


def test_shards_read_back_every_document(spark, docs, rows, tmp_path):
    path = str(tmp_path / "shards")
    token_files.write_shards(docs, BYTE, path, shard_ids=500)
    got = [tuple(r) for r in token_files.read_documents(spark, path).collect()]
    expected = {}
    for k, t in rows:
        expected.setdefault(k, []).append(ids_of(BYTE, t))
    assert len(got) == len(rows)
    for k, start, n, c in got:
        assert (n, c) in [(len(i), crc(i)) for i in expected[k]]
    # starts follow ascending ids without gaps, null ids first
    at = 0
    for k, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda k: (k is not None, k))


def test_keys_are_found_and_strangers_are_not(spark, docs, tmp_path):
    path = str(tmp_path / "keyed")
    token_files.write_shards(docs, BYTE, path, shard_ids=500)
    got = token_files.read_documents(spark, path, keys=[46, 7, 999, -1]).collect()
    assert sorted(r["doc_id"] for r in got) == [7, 46, 46]


def test_no_documents_no_shards(spark, no_docs, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_shards(no_docs, BYTE, path)
    assert token_files.read_documents(spark, path).count() == 0


def test_perfect_hash_is_one_to_one():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000))
    index = token_files.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert token_files.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def check_packing(got, capacity):
    got = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at, sequence = 0, None
    for r in got:
        at = at if r["sequence_id"] == sequence else 0
        sequence = r["sequence_id"]
        assert r["offset"] == at
        at += r["length"]
        assert at <= capacity
    return len({r["sequence_id"] for r in got})


def test_packing_places_every_piece_once(docs, rows):
    got = packing.pack(docs, WORD, capacity=64).collect()
    expected = []
    for k, t in rows:
        ids = ids_of(WORD, t)
        expected += [
            (k, p, s, len(ids[s : s + 64]), crc(ids[s : s + 64]))
            for p, s in enumerate(range(0, len(ids), 64))
        ]
    pieces = [tuple(r)[:5] for r in got]
    assert sorted(pieces, key=key) == sorted(expected, key=key)
    used = check_packing(got, 64)
    counts = np.bincount([r["length"] for r in got], minlength=65)
    assert used <= 1 + sum(n for _, n in packing.best_fit(counts, 64))


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, WORD).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(129, np.int64)
    lengths = rng.integers(1, 129, 40)
    counts[lengths] = rng.integers(1, 500, 40)
    plan = packing.plan_patterns(counts, 128)
    used = np.zeros(129, np.int64)
    for pattern, repeats in plan:
        assert sum(pattern) <= 128
        for n in pattern:
            used[n] += repeats
    assert (used == counts).all()
    n = sum(r for _, r in plan)
    assert n <= 1.02 * sum(r for _, r in packing.best_fit(counts, 128)) + 1
