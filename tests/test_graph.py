import os
import random

from chainloom.functions import lineage
from chainloom.operators import graph


def brute_hops(edges, starts, bound):
    out = {}
    for s in starts:
        seen, level = {s: 0}, {s}
        for depth in range(1, bound + 1):
            level = {b for a, b in edges if a in level} - set(seen)
            seen |= dict.fromkeys(level, depth)
        out |= {(s, n): d for n, d in seen.items()}
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    for bound in (1, 3):
        edges = {(rng.choice("abcdefghij"), rng.choice("abcdefghij")) for _ in range(18)}
        df = spark.createDataFrame([*edges, *list(edges)[:3], (None, "a"), ("a", None)], "src string, dst string")
        starts = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "node string")
        want = brute_hops(edges, "ab", bound)
        assert {(r.start, r.node): r.hops for r in graph.hops(df, starts, bound).collect()} == want
        ends = spark.createDataFrame([("c",), ("a",)], "node string")
        pairs = graph.reachable_pairs(df, starts, ends, bound)
        assert {(r.source, r.sink): r.hops for r in pairs.collect()} == {k: v for k, v in want.items() if k[1] in "ca"}
        paths = graph.shortest_paths(df, starts, ends, bound).collect()
        assert {(r.source, r.sink) for r in paths} == {k for k in want if k[1] in "ca"}
        for r in paths:
            assert len(r.path) - 1 == want[r.source, r.sink] and all(e in edges for e in zip(r.path, r.path[1:]))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {n: min(m for m in parent if find(m) == find(n)) for n in list(parent)}


def test_last_writer_and_empty(spark):
    df = spark.createDataFrame([("a", "b", 1, "x"), ("a", "b", 2, "y")], "src string, dst string, seq int, kind string")
    assert graph.simple_edges(df, "seq").collect() == [("a", "b", "y")]
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.components(none).count() == 0
    assert graph.hops(none, spark.createDataFrame([("a",)], "node string"), 3).collect() == [("a", "a", 0)]


def test_ranked_pairs(spark):
    df = spark.createDataFrame([("a", "x", 0.5, 0.5), ("b", "x", 0.5, 0.5), ("c", "x", 0.9, 0.1)], "source string, sink string, source_confidence double, sink_confidence double")
    assert [r.source for r in graph.ranked_pairs(df, 2).collect()] == ["c", "b"]


def test_walked_paths_are_the_shortest(spark):
    """Those of shortest_paths without lone sources; rows once written by a key are not moved again to be joined on it."""
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(70)] + [(None, "n01"), ("n02", "dead"), ("dead", "end")]
    edges, node = spark.createDataFrame(pairs, "src string, dst string"), lambda *x: spark.createDataFrame([(i,) for i in x], "node string")
    sources, sinks = node(*[f"n{i:02}" for i in range(12)], "n01", None), node(*[f"n{i:02}" for i in range(8, 25)])
    for bound in (2, 14):
        want = {tuple(map(str, r)) for r in graph.shortest_paths(edges, sources, sinks, bound).where("size(path) > 1").collect()}
        assert {tuple(map(str, r)) for r in graph.walked_paths(edges, sources, sinks, bound).collect()} == want
        pairs = graph.walked_paths(edges, sources, sinks, bound, paths=False).collect()
        assert {tuple(r) for r in pairs} == {x[:2] for x in want} and len(pairs) == len(want)
    assert graph.walked_paths(edges.limit(0), sources, sinks, 3).count() == 0


def test_rows_written_in_place_stay_there(spark):
    edges = spark.createDataFrame([(f"n{i % 7}", f"n{i}") for i in range(50)], "src string, dst string")
    lying = lineage.cut_in_place(edges.repartition(lineage.partitions(spark), "src").sortWithinPartitions("src"))
    plan = lying.withColumnRenamed("dst", "end").join(lying.hint("merge"), "src")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_cheapest_paths_write_each_once(spark):
    """Of 300 lines of 15 nodes each of the 4,500 pairs; it was all that were met so far in each round."""
    edges = [(f"line{i:03}_{j:02}", f"line{i:03}_{j + 1:02}", 1.0) for i in range(300) for j in range(14)]
    node = lambda j: spark.createDataFrame([(f"line{i:03}_{j:02}",) for i in range(300)], "node string")
    folder = spark.sparkContext.getCheckpointDir() or lineage.shared_folder(spark)
    written = lambda: sum(os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(folder.removeprefix("file:")) for f in files)
    before = written()
    assert {(r.cost, len(r.path)) for r in graph.cheapest_paths(spark.createDataFrame(edges, "src string, dst string, cost double"), node(0), node(14), 14).collect()} == {(14.0, 15)}
    assert written() - before < 700_000
