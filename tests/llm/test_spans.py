import random
import time

import numpy as np
import pytest

from chainloom.llm.spans import compact_windows, shared_share, shared_spans


def brute(texts, span):
    at = {}
    for k, t in texts.items():
        for i in range(len(t) - span + 1):
            at.setdefault(t[i : i + span], set()).add(k)
    out = []
    for k, t in texts.items():
        shared = [False] * len(t)
        for i in range(len(t) - span + 1):
            if len(at[t[i : i + span]]) > 1:
                shared[i : i + span] = [True] * span
        start = None
        for i, s in enumerate([*shared, False]):
            if s and start is None:
                start = i
            if not s and start is not None:
                out.append((k, start, i))
                start = None
    return sorted(out)


@pytest.mark.parametrize("large", [20_000, 0])
def test_against_brute_force(spark, large):
    rng = random.Random(large)
    word = lambda n: "".join(rng.choice("ab \n🙂é") for _ in range(n))
    parts = [word(rng.randrange(15, 60)) for _ in range(8)]
    texts = {i: "".join(rng.choice(parts) if rng.random() < 0.6 else word(rng.randrange(1, 30)) for _ in range(rng.randrange(0, 8))) for i in range(40)}
    texts |= {100: texts[1], 101: texts[1], 102: parts[0] * 3, 103: "a" * 90, 104: "a" * 70, 105: "b" * 80}
    df = spark.createDataFrame([*texts.items(), (106, None), (107, ""), (100, texts[1])], "doc_id long, text string")
    got = shared_spans(df, "doc_id", "text", span=20, gram=8, large=large)
    assert sorted(map(tuple, got.collect())) == brute(texts, 20)
    share = {r.doc_id: r for r in shared_share(df.dropDuplicates(["doc_id"]), "doc_id", "text", got).collect()}
    assert share[106].share == 0 and share[107].chars == 0 and share[101].shared_chars == sum(e - s for k, s, e in brute(texts, 20) if k == 101)


def test_once_in_one_record_is_not_shared(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 9), (1, "abcdefghij" * 9), (2, "x")], "doc_id long, text string")
    assert shared_spans(df, "doc_id", "text", 20, 8).count() == 0
    assert shared_spans(df.limit(0), "doc_id", "text", 20, 8).count() == 0


def test_compact_windows_cover_each_window_once():
    h = np.array([random.Random(1).randrange(20) for _ in range(200)], dtype=np.uint64)
    first, last, least = compact_windows(h, 7)
    for i in range(194):
        assert [v for f, e, v in zip(first, last, least) if f <= i <= e] == [h[i : i + 7].min()]
    assert all(len(x) == 0 for x in compact_windows(h[:6], 7))


def test_runs_of_one_character_take_linear_time(spark):
    """A million equal tokens are one compact window, and sorted ones are no worse than random ones."""
    began = time.time()
    for h in (np.zeros(1_000_000, np.uint64), np.arange(1_000_000, dtype=np.uint64), np.arange(1_000_000, dtype=np.uint64)[::-1]):
        first, last, _ = compact_windows(h, 101)
        assert (last - first + 1).sum() == 1_000_000 - 100
    assert len(compact_windows(np.zeros(1_000_000, np.uint64), 101)[0]) == 1 and time.time() - began < 5
    df = spark.createDataFrame([(1, "a" * 1_000_000), (2, "b" * 500 + "a" * 300_000), (3, "ab" * 200_000)], "doc_id long, text string")
    assert sorted(map(tuple, shared_spans(df, "doc_id", "text").collect())) == [(1, 0, 1_000_000), (2, 500, 300_500)]
