"""Running sums: against a plain loop, with hot groups, nulls, ties, repeated rows and empty tables."""

import random

from chainloom.operators.matching import running_cut
from chainloom.operators.ordering import running_sum


def plain(rows):
    sums, out = {}, []
    for g, k, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        sums[g] = sums.get(g, 0) + (n or 0)
        out.append((g, k, sums[g]))
    return out


def test_hot_group_agrees_with_a_loop(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5, 7])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(7)
    got = running_sum(df, "g", ["k"], "n", "upto").select("g", "k", "upto").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


def test_places_of_ties_are_consecutive(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 9)], "g string, k long")
    got = running_sum(df, "g", ["k"], None, "place").collect()
    assert sorted((r.g, r.place) for r in got) == [("x", 1), ("x", 2), ("x", 3), ("y", 1)]


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "g string, k long, n long, running long, `sum` long")
    assert running_sum(df, "g", ["k"], "n", "upto").collect() == []
    full = spark.createDataFrame([("g", 1, 2, 9)], "g string, k long, n long, `sum` long")
    assert [(r["sum"], r.upto) for r in running_sum(full, "g", ["k"], "n", "upto").collect()] == [(9, 2)]


def test_cut_keeps_the_budget(spark):
    df = spark.createDataFrame([("g", i, 10) for i in range(10)] + [("h", 0, 99)], "g string, k long, n long")
    got = running_cut(df, "g", ["k"], "n", 35).collect()
    assert sorted((r.g, r.k) for r in got) == [("g", 0), ("g", 1), ("g", 2)]
