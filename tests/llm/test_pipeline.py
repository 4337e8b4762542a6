"""The pipeline on a small table, each stage held against a brute-force version of its rule."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from watchpost.llm import near_dedup, toxicity
from watchpost.llm.common import stored, table
from watchpost.llm.shingles import bands_for, missed

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SMALL, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def alike(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 85 * (len(a) + len(b) - both)


def test_stages_keep_the_columns_of_documents(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_toxic_documents_go(spark, stages):
    model = toxicity.fit(stages[0], table(spark, SMALL, "labels"))
    scores = toxicity.score_toxicity(stages[0], model).collect()
    assert set(texts(stages[1])) == {r["doc_id"] for r in scores if r["predicted"] == 0}


def short_units(text):
    """Runs of adjacent lines under 20 tokens that come to 20 together: (lines, places)."""
    masked = [re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", "<*>", x).strip(" ") for x in (text or "").split("\n")]
    size = [max(len(m.split(" ")), len(m) // 12) for m in masked]
    for i in range(len(masked)):
        j, total = i, 0
        while j < len(masked) and total < 20 and size[j] < 20:
            total += size[j]
            j += 1
        if total >= 20:
            yield tuple(masked[i:j]), range(i, j)


def test_recurring_lines_are_left_in_one_document(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(before) == set(after)
    lines = {}
    for doc, text in before.items():
        for line in set((text or "").split("\n")):
            lines.setdefault(line, set()).add(doc)
    kept = {}
    for doc, text in after.items():
        for line in set((text or "").split("\n")):
            kept.setdefault(line, set()).add(doc)
        # what is left are lines of the document, in order
        left = iter((before[doc] or "").split("\n"))
        assert not text or all(line in left for line in text.split("\n"))
    for line, docs in lines.items():
        if len(docs) > 1 and len(line.split(" ")) >= 20:
            assert len(kept.get(line, set())) <= 1
    holders = {}
    for doc, text in before.items():
        for unit, _ in short_units(text):
            holders.setdefault(unit, set()).add(doc)
    for doc, text in before.items():
        shared = {i for unit, places in short_units(text) if len(holders[unit]) > 1 for i in places}
        for i, line in enumerate((text or "").split("\n")):
            if len(line.split(" ")) < 3 and len(line) < 36 and i not in shared and after[doc]:
                assert doc in kept[line], (doc, line)
    # a unit stands whole in one document at most, the one with the smallest id of those that had it
    for doc, text in after.items():
        for unit, _ in short_units(text):
            if len(holders.get(unit, ())) > 1 and unit in {u for u, _ in short_units(before[doc])}:
                assert doc == min(holders[unit]), (doc, unit)


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    sets = {d: shingles(t) for d, t in before.items()}
    docs, group = sorted(before), {d: d for d in before}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    for k, a in enumerate(docs):
        for b in docs[:k]:
            if alike(sets[a], sets[b]):
                group[max(top(a), top(b))] = min(top(a), top(b))
    assert set(after) == {d for d in docs if top(d) == d}


def changed(words, swaps):
    out = list(words)
    for k in range(swaps):
        out[20 + 40 * k] = f"other{k}"
    return " ".join(out)


def test_near_copies_are_linked_from_80_per_cent_on(spark):
    words = [f"w{k}" for k in range(404)]
    # five shingles of 400 for each word changed
    texts_in = {1: " ".join(words), 2: changed(words, 8), 3: " ".join(words[:300]), 4: "alone here"}
    share = len(shingles(texts_in[1]) & shingles(texts_in[2])) / len(
        shingles(texts_in[1]) | shingles(texts_in[2])
    )
    assert 0.80 <= share < 0.85
    docs = spark.createDataFrame(list(texts_in.items()), "doc_id bigint, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert set(texts(got)) == {1, 3, 4}
    # the query's own rule stays at 85
    at_85 = near_dedup.near_duplicates(docs).filter("kept").collect()
    assert {r["doc_id"] for r in at_85} == {1, 2, 3, 4}


def test_one_of_each_group_at_80_per_cent_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    sets = {d: shingles(t) for d, t in before.items()}
    docs, group = sorted(before), {d: d for d in before}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    for k, a in enumerate(docs):
        for b in docs[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                group[max(top(a), top(b))] = min(top(a), top(b))
    assert set(after) == {d for d in docs if top(d) == d}


def test_bands_follow_the_threshold():
    assert bands_for(85) == 48 and bands_for(80) == 64
    assert missed(80, bands_for(80)) < 1e-7 < missed(80, 48)
    assert near_dedup.sketch_margin(85) == near_dedup.SKETCH_MARGIN < near_dedup.sketch_margin(80)


def test_documents_with_benchmark_passages_go(spark, stages):
    before, after = texts(stages[3]), texts(stages[4])
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in table(spark, SMALL, "benchmark").collect():
        w = word.findall((r["text"] or "").translate(LOWER))
        windows |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 10, 0) + 1 if w else 0)}
    sizes = {len(w) for w in windows}
    clean = set()
    for doc, text in before.items():
        w = word.findall((text or "").translate(LOWER))
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            clean.add(doc)
    assert set(after) == clean


def test_all_that_is_left_is_packed(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = set()
    for doc, text in texts(stages[4]).items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[start : start + 2048], "<u4")
            expected.add((doc, piece, start, len(own), zlib.crc32(own.tobytes())))
    got = stages[5].collect()
    assert {tuple(r)[:5] for r in got} == expected and len(got) == len(expected)
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048


def test_every_operator_is_registered_once():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_dedup", "decontamination", "packing",
    ]
