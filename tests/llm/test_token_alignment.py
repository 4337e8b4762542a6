import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from watchpost.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, segment string, pair bigint, ids string"


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers over whole texts, and what each id spells."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def spell_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
        xs = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        ys = [spell_b(i) for i in y]
        if not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            return [], []
        return list(zip(x, xs)), list(zip(y, ys))

    return encode


def spans(tokens):
    ends = np.cumsum([len(s) for _, s in tokens]).tolist()
    return [(i, e - len(s), e) for (i, s), e in zip(tokens, ends)]


def brute(plain, rows):
    held, out = defaultdict(set), []
    for n, (k, t) in enumerate(rows):
        a, b = map(spans, plain(t))
        links = [(x, y) for x, s, e in a for y, u, v in b if max(s, u) < min(e, v)]
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, f in own if low <= s and f <= e) for own in (a, b)))
            low = e
        for pair in links:
            held[pair].add(n)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append([k, len(a), len(b), len(groups), digest, links])
    count = {p: len(d) for p, d in held.items()}
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return count, sorted(
        repr((k, na, nb, ng, len(li), sum(count[p] == most[p[0]] for p in li), sum(count[p] for p in li), d))
        for k, na, nb, ng, d, li in out
    )


def odd_rows():
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "don't", "'s", "12", "été", "é", " ", "\x1c", "unbelievable",
             "!!", "<|endoftext|>", "<s>", "<0x41>", "İ", "中文", "Word.", "x,y", "　", "\U0001f600", "▁"[:0]]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for k in range(250)]
    words = ["alpha", "beta", "gamma.", "delta\nline", "epsilon", "hyphen-ated"]
    rows += [(300 + k, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for k in range(60)]
    rows += [
        (400, None), (401, ""), (402, " "), (403, "\n"), (None, "no id"), (None, None), (404, "same"), (404, "same"),
        (405, "write ▁ here"), (406, " ".join(rng.choices(words, k=3000))), (407, "q" * 3000), (408, "ends "),
        (409, "  two  spaces  "), (410, "a\n b \n\n  c"), (411, "\x00\x01"),
    ]
    return rows


@pytest.fixture(params=["usual", "small"])
def sizes(request, monkeypatch):
    if request.param == "small":
        monkeypatch.setattr(ta, "SLICE", 50)
        monkeypatch.setattr(ta, "BATCH_LINKS", 300)
        monkeypatch.setattr(ta, "SEGMENT_POSTINGS", 1500)
        monkeypatch.setattr(ta, "PARTS", 40)


def test_equals_brute_force(spark, plain, sizes):
    rows = odd_rows()
    docs = spark.createDataFrame([(k, t, "s", 1, "i") for k, t in rows], SCHEMA).repartition(3)
    count, want = brute(plain, rows)
    index = ta.index_links(docs, A, B)
    pairs = ta.count_pairs(index)
    assert {(r["a"], r["b"]): r["docs"] for r in pairs.collect()} == count
    got = ta.score_documents(index, pairs).collect()
    assert sorted(
        repr(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")))
        for r in got
    ) == want


def test_segments_in_one_process_with_small_sizes(plain, sizes):
    """The monkeypatched sizes do not reach workers; here the same code runs in this process."""
    rows = odd_rows()
    count, _ = brute(plain, rows)
    own, found, links = ta.Aligner(A, B), Counter(), 0
    segment = ta.Segment(own)
    done = []
    for low in range(0, len(rows), 16):
        part = rows[low : low + 16]
        if len(own.numbers) > ta.PARTS:
            segment.close_batch()
        for (k, _), numbers in zip(part, own.find([t for _, t in part])):
            segment.add(k, numbers)
            if segment.full():
                done.append(segment.record("x", __import__("pyarrow").int64()))
                segment = ta.Segment(own)
    done.append(segment.record("x", __import__("pyarrow").int64()))
    assert (len(done) > 1) == (ta.SEGMENT_POSTINGS == 1500)
    for r in done:
        for p, n in zip(r["pair"][0].as_py(), r["docs"][0].as_py()):
            found[p >> ta.PAIR_BITS, p & ((1 << ta.PAIR_BITS) - 1)] += n
        links += sum(r["links"][0].as_py())
    assert found == count


def test_bitmaps_merge_and_come_back():
    rng = np.random.default_rng(5)
    wanted, parts = Counter(), []
    for low in (0, 300, 600):
        codes = rng.zipf(1.4, 4000) % 500
        docs = rng.integers(low, low + 300, 4000)
        wanted.update(zip(codes.tolist(), docs.tolist()))
        parts.append(ta.PairBitmaps.count(*ta.count_links(codes, docs), low + 300))
    index = ta.PairBitmaps.merged(parts, 900)
    index = ta.PairBitmaps.unpacked(index.pairs, index.packed())
    links = Counter()
    for (p, _), n in wanted.items():
        links[p] += n
    assert dict(zip(index.pairs.tolist(), index.links().tolist())) == links
    value = rng.integers(1, 1000, len(index.pairs))
    sums = index.scores(np.stack([np.ones_like(value), value], 1))
    by_pair = dict(zip(index.pairs.tolist(), value.tolist()))
    for d in range(900):
        assert sums[d].tolist() == [
            sum(n for (p, e), n in wanted.items() if e == d),
            sum(n * by_pair[p] for (p, e), n in wanted.items() if e == d),
        ]


def test_no_documents(spark):
    assert ta.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []
