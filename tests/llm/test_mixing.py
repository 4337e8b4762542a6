import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from watchpost.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, `number` string, `start` string, `size` string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(k, t, "en", s, "x", "y", "z") for k, t, s in rows], SCHEMA).repartition(parts)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(260):
        source = ["b", "a", None, "\U0001f600", "￮", "a"][k % 6]
        rows.append((k, " ".join(f"w{k}x{j}" for j in range(int(rng.integers(1, 90)))), source))
    rows += [
        (300, None, "a"), (301, "", "b"), (302, " \t\n ", "empty"), (None, "null id here", "a"),
        (303, "  lead\nand trail 　 été ", "b"), (304, "same row", "c"), (304, "same row", "c"),
        (304, "same id", "c"), (305, " ".join(f"long{j}" for j in range(9000)), "b"),
    ]
    return rows


def expected_targets(rows):
    """Weights 3, 1, 2 by code point, null last; what is above twice the size dealt again."""
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target = {s: 1.5 * sum(size.values()) * weight[s] / sum(weight.values()) for s in names}
    while True:
        over = [s for s in names if target[s] > 2 * size[s] + 1e-9]
        if not over:
            return size, target
        excess = sum(target[s] - 2 * size[s] for s in over)
        for s in over:
            target[s] = 2 * size[s]
        free = [s for s in names if target[s] < 2 * size[s] - 1e-9]
        for s in free:
            target[s] += excess * weight[s] / sum(weight[f] for f in free)


def test_documents_and_targets(spark):
    rows = corpus()
    size, target = expected_targets(rows)
    mix = mixing.Mix(frame(spark, rows), block=16, slots_per_shard=8)
    got = mix.report().collect()
    by_id = defaultdict(list)
    for k, t, s in rows:
        by_id[k].append((len(words(t)), s))
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        own = [(n, s) for n, s in by_id[r["doc_id"]] if n == r["size"] and size[s] == r["source_size"]]
        assert own, r
        assert r["target"] == pytest.approx(target[own[0][1]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[own[0][1]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 1, s


def test_reruns_agree_however_rows_are_dealt(spark):
    rows = corpus()
    a, b = (
        sorted(map(repr, mixing.Mix(frame(spark, rows, p), block=16, slots_per_shard=8).report().collect()))
        for p in (1, 5)
    )
    assert a == b


def test_the_mix_is_made_of_whole_blocks_of_the_documents(spark, tmp_path):
    rows = corpus()
    texts = defaultdict(list)
    for k, t, _ in rows:
        texts[k].append(words(t))
    mix = mixing.Mix(frame(spark, rows), block=16, slots_per_shard=8)
    mix.write(str(tmp_path / "mix"))
    blocks = spark.read.parquet(str(tmp_path / "mix")).collect()
    assert len({(b["shard"], b["slot"]) for b in blocks}) == len(blocks) == sum(mix.plan.draws)
    shards = Counter(b["shard"] for b in blocks)
    assert sorted(shards) == list(range(mix.plan.shards))
    assert all(n == 8 for s, n in shards.items() if s < mix.plan.shards - 1)
    short, count = Counter(), Counter()
    for b in blocks:
        held = words(b["text"])
        assert len(held) == b["words"] == sum(s["words"] for s in b["spans"])
        at = 0
        for span in b["spans"]:
            part = held[at : at + span["words"]]
            at += span["words"]
            assert any(
                t[i : i + len(part)] == part for t in texts[span["id"]] for i in range(len(t) - len(part) + 1)
            )
            count[span["id"]] += len(part)
        short[b["source"]] += b["words"] < 16
    # the short block of a source, twice at most, and its cut last draw
    assert max(short.values()) <= 3
    report = Counter()
    for r in mix.report().collect():
        report[r["doc_id"]] += r["taken"]
    assert +report == +count


def test_pieces_put_together_are_the_text(spark):
    rows = corpus()
    mix = mixing.Mix(frame(spark, rows), block=16)
    pieces = defaultdict(dict)
    for p in mix.pieces.collect():
        pieces[p["id"], p["number"], p["start"]][p["block"], p["first"]] = p["piece"]
    whole = Counter("".join(v for _, v in sorted(d.items())) for d in pieces.values())
    assert whole == Counter(t for _, t, _ in rows if words(t))


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, " ", None)]])
def test_nothing_to_mix(spark, rows):
    mix = mixing.Mix(frame(spark, rows))
    assert mix.blocks().collect() == []
    assert [(r["size"], r["taken"], r["target"]) for r in mix.report().collect()] == [(0, 0, 0.0)] * len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutations_are_one_to_one(n):
    order = mixing.Permutation(n, 99)
    there = order(np.arange(n))
    assert sorted(there.tolist()) == list(range(n))
    assert order.undo(there).tolist() == list(range(n))


def test_shards_draw_all_slots_and_about_evenly():
    plan = mixing.Plan([40_000, 8_000, 800], [60_000.0, 4_000.0, 1_600.0], 3, 8, 64)
    drawing = mixing.Drawing(plan)
    found = [drawing.shard(k) for k in range(plan.shards)]
    earlier = np.zeros(3, np.int64)
    for counts, before in found:
        assert before.tolist() == earlier.tolist()
        earlier += counts
    assert earlier.tolist() == plan.draws
    # any shard alone gives the same
    assert mixing.Drawing(plan).shard(70)[0].tolist() == found[70][0].tolist()
    # the spread of a multinomial draw, not an even deal
    share = plan.draws[0] / sum(plan.draws)
    spread = np.std([c[0] for c, _ in found[:-1]])
    assert 0.6 < spread / np.sqrt(64 * share * (1 - share)) < 1.4


def test_large_urns_keep_their_bounds():
    counts = np.array([3 * 10**9, 5, 10**9])
    got = mixing.split_counts(counts, 2 * 10**9, (1, 2, 3))
    assert got.sum() == 2 * 10**9 and (got >= 0).all() and (got <= counts).all()
    assert abs(got[0] - 1.5 * 10**9) < 10**6
