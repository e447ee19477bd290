import random
import time

import pytest
from pyspark.sql import functions as F

from chainloom.llm import entities

COLUMNS = "key long, project string, file string, src string, snk string, sl int, kl int, id string"


def side(spark, rows):
    return entities.prepared(spark.createDataFrame(rows, COLUMNS), "key", *map(F.col, ("project", "file", "src", "snk", "sl", "kl")))


def test_rules(spark):
    a = side(spark, [(1, "p-x", "a/b/C.java", "userName", "sinkVar", 3, 9, "c"), (1, "p-x", "a/b/C.java", "userName", "sinkVar", 3, 9, "c"), (2, "p-x", "a/b/D.java", "markerPhone", "q", 0, None, None), (3, None, "a/b/C.java", "x", "y", 1, 1, None)])
    b = side(spark, [
        (101, "P_X.git", "C:\\w\\a\\b\\C.java", "this.user_name", "sinkvar", 3, 12, None), (102, "px", "a/z/C.java", "userName", "sinkVar", 3, 9, None),
        (103, "scan/p-x (main)", "b.D", "mrkrPhn", "q", None, 70, None), (104, "p-x", "b/C.java", "userName", "sinkVar", 3, 18, None), (105, "p-x", "C.java", "userName", "sinkVar", 3, 9, None),
    ])
    assert sorted((r.a_id, r.b_id) for r in entities.match_records(a, b).collect()) == [(1, 101), (2, 103)]
    assert entities.match_records(a.limit(0), b).count() == 0


def brute(supply, room, gain):
    """The best total by trying every unit of every left kind with every right kind or none."""
    units = [i for i, n in enumerate(supply) for _ in range(n)]

    def best(k, left):
        if k == len(units):
            return 0.0
        found = best(k + 1, left)
        for j, n in enumerate(left):
            if n and (units[k], j) in gain:
                found = max(found, gain[units[k], j] + best(k + 1, (*left[:j], n - 1, *left[j + 1 :])))
        return found

    return best(0, tuple(room))


def test_transport_is_best():
    rng = random.Random(4)
    for _ in range(150):
        supply, room = [rng.randrange(1, 3) for _ in range(rng.randrange(1, 4))], [rng.randrange(1, 3) for _ in range(rng.randrange(1, 4))]
        gain = {(i, j): rng.choice((0.2, 0.5, 0.5, 0.9, rng.random() + 0.01)) for i in range(len(supply)) for j in range(len(room)) if rng.random() < 0.7}
        flow = entities.transport(supply, room, [[(j, gain[i, j]) for j in range(len(room)) if (i, j) in gain] for i in range(len(supply))])
        assert all(sum(n for (x, _), n in flow.items() if x == i) <= supply[i] for i in range(len(supply)))
        assert all(sum(n for (_, y), n in flow.items() if y == j) <= room[j] for j in range(len(room)))
        assert abs(sum(gain[e] * n for e, n in flow.items()) - brute(supply, room, gain)) < 1e-9


def test_assignment_by_spark(spark):
    rng = random.Random(4)
    gain = {(a, 10 + b): round(rng.random(), 3) + 0.01 for a in range(5) for b in range(5) if rng.random() < 0.6} | {(50, 60): 0.5}
    df = spark.createDataFrame([(a, 1 + a % 2, b, 1, c) for (a, b), c in gain.items()], "a_id long, a_n long, b_id long, b_n long, confidence double")
    total = {}
    for large in (400, 1):
        got = entities.assign(df, large).where("n > 0").collect()
        for side, n in (("a_id", lambda x: 1 + x % 2), ("b_id", lambda x: 1)):
            assert all(sum(r.n for r in got if r[side] == x) <= n(x) for x in {r[side] for r in got})
        total[large] = sum(gain[r.a_id, r.b_id] * r.n for r in got)
    best = brute([1 + a % 2 for a in range(5)], [1] * 5, {(a, b - 10): c for (a, b), c in gain.items() if a < 50}) + 0.5
    assert abs(total[400] - best) < 1e-9 and best * 0.5 <= total[1] <= best + 1e-9


def test_many_ties_end(spark):
    """A group of copies is one kind; a thousand pairs of equal worth are solved at once."""
    place = ("p", "a/b/C.java")
    a = side(spark, [(i, *place, "alpha", "omega", 5, 9, None) for i in range(300)] + [(1000 + i, *place, "beta", "sigma", None, 100 + i % 5, None) for i in range(25)])
    b = side(spark, [(5000 + i, *place, "alpha", "omega", 5, 9, None) for i in range(200)] + [(9000 + i, *place, "beta", "sigma", None, 100 + i % 8, None) for i in range(40)])
    began = time.time()
    got = entities.match_records(a, b).collect()
    assert time.time() - began < 120
    assert len(got) == 225 and len({r.a_id for r in got}) == len({r.b_id for r in got}) == 225
    assert sum(r.a_id < 1000 for r in got) == 200 and all((r.a_id < 1000) == (r.b_id < 9000) for r in got)
    flow = entities.transport([1] * 1000, [1] * 40, [[(j, 0.7) for j in range(40)] for _ in range(1000)])
    assert sum(flow.values()) == 40


def test_ranks_are_global(spark):
    df = spark.createDataFrame([(i * 7919 % 501,) for i in range(501)], "v int")
    assert [(r.rank, r.v) for r in entities.ranked(df, F.col("v")).orderBy("rank").collect()] == [(i, i) for i in range(501)]


def test_size_of_a_component_changes_nothing(spark):
    """The best pair first would give 0.9 + 0.1; the greatest total is 1.6, in a component of any size."""
    rows = [(10 * g + a, 1, 10 * g + b, 1, c) for g in range(30) for a, b, c in ((0, 5, 0.9), (0, 6, 0.8), (1, 5, 0.8), (1, 6, 0.1))]
    rows += [(1000 + a, 1, 2000 + b, 1, 0.5 + (a * b % 7) / 20) for a in range(12) for b in range(12)]
    df = spark.createDataFrame(rows, "a_id long, a_n long, b_id long, b_n long, confidence double")
    whole, single, many = (sorted(map(tuple, entities.assign(df, large).where("n > 0").collect())) for large in (10**6, 1, 50))
    assert whole == single == many
    assert sum(c * n for a, _, c, n in whole if a < 1000) == pytest.approx(30 * 1.6)
