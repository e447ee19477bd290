import itertools
import random

import numpy as np
import pytest

from chainloom.llm import near_copies


def brute(texts, threshold):
    sets = {k: {t[i : i + 3] for i in range(len(t) - 2)} for k, t in texts.items() if t}
    return sorted((a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12)


def edited(rng, text):
    words = text.split(" ")
    for _ in range(rng.randrange(0, 4)):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(0, 2)] = [rng.choice("alpha beta gamma delta omega sigma".split()) for _ in range(rng.randrange(0, 2))]
    rng.random() < 0.3 and rng.shuffle(words)
    return " ".join(words)


@pytest.mark.parametrize("depth", [1, 11, 21])
def test_against_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(near_copies, "DEPTHS", (depth,))
    rng = random.Random(depth)
    roots = [" ".join(rng.choice("order panel invoice broker menu ticket server garden wallet".split()) + rng.choice("ABCDE") for _ in range(rng.randrange(3, 14))) for _ in range(12)]
    texts = dict(enumerate(edited(rng, rng.choice(roots)) for _ in range(90))) | {200: roots[0], 201: roots[0], 202: "ab", 203: "", 204: "abc", 205: "abc"}
    df = spark.createDataFrame([*texts.items(), (206, None), (200, roots[0])], "row_id long, joined string")
    for threshold in (0.7, 0.9):
        got = near_copies.similar_pairs(df, "row_id", "joined", threshold)
        assert sorted((r.id_a, r.id_b) for r in got.collect()) == brute(texts, threshold)


def test_groups_and_empty(spark):
    texts = {1: "abcdefghij", 2: "abcdefghij", 3: "abcdefghijk", 4: "zzzzyyyy", 5: "ab"}
    df = spark.createDataFrame(list(texts.items()), "row_id long, joined string")
    rows = {r.row_id: r for r in near_copies.similar_groups(df, "row_id", "joined").collect()}
    assert set(rows) == {1, 2, 3, 4} and rows[1].group_id == rows[3].group_id != rows[4].group_id
    assert rows[1].links == 1 and rows[4].links == 0
    assert near_copies.similar_pairs(df.limit(0), "row_id", "joined").count() == 0


def test_plan_prefers_higher_thresholds_for_more_records():
    rng = np.random.default_rng(1)
    sample = [np.unique(rng.integers(0, 400, 60).astype(np.uint64) * np.uint64(977)) for _ in range(150)]
    counts = np.zeros(near_copies.BUCKETS, np.int64)
    for s in sample:
        counts[(s % np.uint64(near_copies.BUCKETS)).astype(int)] += 1
    few, many = (near_copies.plan(counts, sample, n, 0.7) for n in (100, 10_000_000))
    assert few.depth() < many.depth() and (many.thresholds - 1).sum() == many.depth() - 1
    # Partitions of rare bits keep a lower threshold than those of frequent ones.
    assert len(set(many.thresholds.tolist())) > 1


def test_groups_stay_together_and_the_program_is_best():
    rng = np.random.default_rng(2)
    words = [np.unique(rng.integers(0, 1 << 40, 6).astype(np.uint64)) for _ in range(60)]
    sample = [np.unique(np.concatenate([words[i] for i in rng.choice(60, 8, replace=False)])) for _ in range(100)]
    counts = np.zeros(near_copies.BUCKETS, np.int64)
    for s in sample:
        np.add.at(counts, (s % np.uint64(near_copies.BUCKETS)).astype(int), 1)
    layout = near_copies.plan(counts, sample, 50_000, 0.7)
    kept = [len(set(layout.part[(w % np.uint64(near_copies.BUCKETS)).astype(int)])) for w in words]
    assert np.mean(np.array(kept) == 1) > 0.8
    cost = rng.random((4, 4))
    cost[:, 0] = np.inf
    for budget in range(9):
        every = [(cost[range(4), t].sum(), list(t)) for t in itertools.product((1, 2, 3), repeat=4) if sum(t) - 4 == budget]
        total, chosen = near_copies.allocate(cost, budget)
        assert chosen == min(every)[1] and abs(total - min(every)[0]) < 1e-9


def test_long_texts(spark):
    """Probes grow with the bits of a set; pairs are met whatever their sizes and however partitions are split."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    texts = {}
    for i, n in enumerate((40, 44, 60, 90, 160, 330, 600)):
        own = [word() for _ in range(n)]
        texts |= {10 * i: " ".join(own), 10 * i + 1: " ".join(own[: int(n * 0.85)]), 10 * i + 2: " ".join([word() if rng.random() < 0.1 else w for w in own]), 10 * i + 3: " ".join([*own, *(word() for _ in range(n // 3))])}
    df = spark.createDataFrame(list(texts.items()), "row_id long, joined string")
    got = near_copies.similar_pairs(df, "row_id", "joined", 0.7)
    want = brute(texts, 0.7)
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == want and len(want) > 15
    layout = near_copies.Layout(np.zeros(near_copies.BUCKETS, np.int64), 0.7)
    layout.thresholds[:] = 3
    many = [sum(len(h) for h, _ in layout.probes(np.unique(np.random.default_rng(1).integers(0, 1 << 62, n).astype(np.uint64)))) for n in (1_000, 10_000, 100_000)]
    assert many[1] < 20 * many[0] and many[2] < 20 * many[1]
