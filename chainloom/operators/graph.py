"""Graphs as edge tables (src, dst): bounded reachability, slices, shortest paths, components.

Every traversal is a loop of joins in which only the frontier moves; what was seen is removed by an anti-join, and the
lineage is cut each round. Rounds are bounded by the number of hops, for components by the logarithm of the nodes.

Defined results: null ends are no edge; loops and repeated edges change nothing; a source that is a sink reaches itself
in 0 hops; nodes without edges reach only themselves; an empty graph gives only that.
"""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.lineage import cut, cut_in_place, partitions, stored


def simple_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each (src, dst); with an order column the last writer's other columns win."""
    rows = edges.where("src is not null and dst is not null")
    rest = [c for c in edges.columns if c not in ("src", "dst", order)]
    if order is None or not rest:
        return rows.select("src", "dst").distinct()
    return rows.groupBy("src", "dst").agg(F.max(F.struct(order, *rest)).alias("x")).select("src", "dst", *[f"x.{c}" for c in rest])


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends are nodes (node): the induced subgraph."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def hops(edges: DataFrame, starts: DataFrame, bound: int) -> DataFrame:
    """(start, node, hops): the fewest hops from each start (node) to each node within the bound."""
    return _hops(cut(simple_edges(edges)), starts, bound)


def _hops(steps: DataFrame, starts: DataFrame, bound: int) -> DataFrame:
    frontier = starts.where("node is not null").select(F.col("node").alias("start"), "node").distinct().withColumn("hops", F.lit(0))
    seen = frontier = cut(frontier)
    for depth in range(1, bound + 1):
        met = frontier.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(met.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reachable(edges: DataFrame, starts: DataFrame, bound: int) -> DataFrame:
    """(node): all nodes that any start reaches within the bound."""
    return _reachable(cut(simple_edges(edges)), starts, bound)


def _reachable(steps: DataFrame, starts: DataFrame, bound: int) -> DataFrame:
    seen = frontier = cut(starts.where("node is not null").select("node").distinct())
    for _ in range(bound):
        met = frontier.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(met.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def levels(edges: DataFrame, starts: DataFrame, bound: int) -> DataFrame:
    """(node, hops): the fewest hops from any start to each node within the bound."""
    return _levels(cut(simple_edges(edges)), starts, bound)


def _levels(steps: DataFrame, starts: DataFrame, bound: int) -> DataFrame:
    frontier = starts.where("node is not null").select("node").distinct().withColumn("hops", F.lit(0))
    seen = frontier = cut(frontier)
    for depth in range(1, bound + 1):
        met = frontier.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(met.join(seen, "node", "left_anti").withColumn("hops", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def call_slice(edges: DataFrame, sources: DataFrame, sinks: DataFrame, bound: int) -> DataFrame:
    """(node, forth, back): nodes within the bound from a source and, backwards, from a sink, with both distances."""
    steps = cut(simple_edges(edges))
    forth = _levels(steps, sources, bound).withColumnRenamed("hops", "forth")
    return forth.join(_levels(turned(steps), sinks, bound).withColumnRenamed("hops", "back"), "node")


def cheapest_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, bound: int) -> DataFrame:
    """(source, sink, cost, path): for each source the path of at most bound hops and least cost to each sink that it
    reaches, of equal ones the one of fewest nodes, then the least by its nodes. edges have a positive cost; of parallel
    edges the cheapest counts. Each round relaxes from what the last one bettered, and one path is kept for each
    (source, node) and number of hops, as the best way of h + 1 hops leads over a best way of h hops.

    Edges lie by src and what was met by (start, node), so a round shuffles only its frontier, as in walked_paths. A way of
    more hops counts only if it costs less than all of fewer, so what the rounds before hold is never written again."""
    key, n = ["start", "node"], partitions(edges.sparkSession)
    steps = _ways(edges, sinks, F.min("cost").alias("step"))
    frontier = sources.where("node is not null").select("node").distinct().select(F.col("node").alias("start"), "node", F.lit(0.0).alias("cost"), F.array("node").alias("path"))
    levels = [cut_in_place(frontier.repartition(n, *key).sortWithinPartitions(*key))]
    for _ in range(bound):
        met = levels[-1].join(steps, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        met = met.select("start", F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.array_append("path", F.col("dst")).alias("path")).repartition(n, *key)
        met = met.groupBy(*key).agg(F.min(F.struct("cost", "path")).alias("x")).select(*key, "x.cost", "x.path")
        for level in levels:
            met = met.join(level.select(*key, F.col("cost").alias("known")), key, "left").where("known is null or cost < known").drop("known")
        levels.append(cut_in_place(met))
        if levels[-1].isEmpty():
            break
    ends = sinks.select("node").distinct()
    found = functools.reduce(DataFrame.unionByName, levels[1:]).join(ends, "node", "left_semi")
    found = found.groupBy(*key).agg(F.min(F.struct("cost", F.size("path").alias("n"), "path")).alias("x"))
    return found.select(F.col("start").alias("source"), F.col("node").alias("sink"), "x.cost", "x.path")


def connected(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, sink, reaches) of pairs (source, sink): whether any path, however long, leads there. A start walks on only as
    long as it has a sink that it hasn't met; null ends are reached by none."""
    steps = cut(simple_edges(edges))
    wanted = cut(pairs.select("source", "sink").distinct())
    left = wanted.where("source is not null and sink is not null")
    seen = frontier = cut(left.select(F.col("source").alias("start"), F.col("source").alias("node")).distinct())
    while not frontier.isEmpty():
        new = frontier.select(F.col("start").alias("source"), F.col("node").alias("sink"))
        left = cut(left.join(new, ["source", "sink"], "left_anti"))
        going = frontier.join(left.select(F.col("source").alias("start")).distinct(), "start", "left_semi")
        reached = going.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen, ["start", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    known = F.col("source").isNotNull() & F.col("sink").isNotNull()
    unmet = left.withColumn("reaches", F.lit(False))
    return wanted.join(unmet, ["source", "sink"], "left").select("source", "sink", (known & F.col("reaches").isNull()).alias("reaches"))


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def taint_slice(edges: DataFrame, sources: DataFrame, sinks: DataFrame, bound: int) -> DataFrame:
    """(node): nodes within the bound from a source and, backwards, from a sink."""
    steps = cut(simple_edges(edges))
    return _reachable(steps, sources, bound).join(_reachable(turned(steps), sinks, bound), "node", "left_semi")


def _on_paths(steps: DataFrame, sources: DataFrame, sinks: DataFrame, bound: int) -> DataFrame:
    """(node): all that a path of at most bound hops from a source to a sink can run through, of simple edges that are
    written already. The way back only walks what the way forth has met, as such a path does."""
    forth = cut(_reachable(steps, sources, bound))
    inner = cut(known_edges(steps, forth))
    return forth.join(_reachable(turned(inner), sinks, bound), "node", "left_semi")


def reachable_pairs(edges: DataFrame, sources: DataFrame, sinks: DataFrame, bound: int) -> DataFrame:
    """(source, sink, hops): each source with the sinks that it reaches within the bound.

    The graph is first reduced to the slice, outside of which no such path runs.
    """
    steps = cut(simple_edges(edges))
    inner = cut(known_edges(steps, cut(_on_paths(steps, sources, sinks, bound))))
    found = _hops(inner, sources, bound).join(sinks.select("node").distinct(), "node", "left_semi")
    return found.select(F.col("start").alias("source"), F.col("node").alias("sink"), "hops")


def shortest_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, bound: int) -> DataFrame:
    """(source, sink, path): for each source the shortest path of at most bound hops to each sink that it reaches, of
    equally short ones the least by its nodes. Only the slice is walked, and one path is kept for each (source, node),
    so no set of paths grows."""
    steps = cut(simple_edges(edges))
    steps = cut(known_edges(steps, cut(_on_paths(steps, sources, sinks, bound))))
    frontier = sources.where("node is not null").select("node").distinct().select(F.col("node").alias("start"), "node", F.array("node").alias("path"))
    seen = frontier = cut(frontier)
    for _ in range(bound):
        met = frontier.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        met = met.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = cut(met.groupBy("start", "node").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.join(sinks.select("node").distinct(), "node", "left_semi").select(F.col("start").alias("source"), F.col("node").alias("sink"), "path")


def _ways(edges: DataFrame, sinks: DataFrame, *rest: Column) -> DataFrame:
    """(src, dst, *rest): simple edges without those to nodes that are no sink and have no way out, written once, by src;
    rest are made from the rows of an edge."""
    rows = stored(edges.where("src is not null and dst is not null").select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")] * bool(rest)))
    going = rows.select(F.col("src").alias("dst")).unionByName(sinks.select(F.col("node").alias("dst"))).distinct()
    kept = rows.join(going, "dst", "left_semi").repartition(partitions(edges.sparkSession), "src")
    kept = kept.groupBy("src", "dst").agg(*rest) if rest else kept.select("src", "dst").distinct()
    return cut_in_place(kept.sortWithinPartitions("src"))


def walked_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, bound: int, paths: bool = True) -> DataFrame:
    """(source, sink, path) as of shortest_paths, or without paths only (source, sink), of graphs most of which leads to
    sinks, so that a slice would cost its rounds and drop little. Sources alone, without a step, are left out.

    Edges lie by src and what was met by (start, node), so a round shuffles only its frontier: to the edges, and to the
    levels before it."""
    key, n = ["start", "node"], partitions(edges.sparkSession)
    steps = _ways(edges, sinks)
    way = F.array_append("path", F.col("dst")).alias("path")
    frontier = sources.where("node is not null").select("node").distinct().select(F.col("node").alias("start"), "node", *[F.array("node").alias("path")] * paths)
    levels = [cut_in_place(frontier.repartition(n, *key).sortWithinPartitions(*key))]
    for _ in range(bound):
        met = levels[-1].join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), *[way] * paths).repartition(n, *key)
        met = met.groupBy(*key).agg(F.min("path").alias("path")) if paths else met.distinct()
        for level in levels:
            met = met.join(level.select(*key), key, "left_anti")
        levels.append(cut_in_place(met))
        if levels[-1].isEmpty():
            break
    ends = sinks.select("node").distinct()
    found = functools.reduce(DataFrame.unionByName, levels[1:]).join(ends, "node", "left_semi")
    return found.select(F.col("start").alias("source"), F.col("node").alias("sink"), *["path"] * paths)


def _large_star(stars: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node that it knows."""
    both = stars.unionByName(turned(stars))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"))
    return both.where(F.col("dst") > F.col("src")).join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))


def _small_star(stars: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of these; src is the larger end."""
    least = stars.groupBy("src").agg(F.min("dst").alias("least"))
    inner = stars.join(least, "src").where(F.col("dst") != F.col("least")).select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return inner.unionByName(least.select("src", F.col("least").alias("dst")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least member of each weakly connected component.

    Large-star and small-star steps in turn, which need a number of rounds that grows with the logarithm of the number
    of nodes, however long the paths are; ends when the edges, whose number never grows, stay the same.
    """
    rows = edges.where("src is not null and dst is not null").select("src", "dst")
    larger = rows.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    loops = larger.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    stars, before = cut(larger.where("src <> dst").distinct()), None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before:
            break
        stars, before = cut(_small_star(_large_star(stars).distinct()).distinct()), state
    members = stars.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(stars.select(F.col("dst").alias("node"), F.col("dst").alias("component")))
    return members.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def ranked_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k best pairs (source, sink, source_confidence, sink_confidence) by mean, source's and sink's confidence, of
    equals the larger identity; k of 0 keeps all. A top-k over the whole table, without a sort of all rows."""
    mean = ((F.col("source_confidence") + F.col("sink_confidence")) / 2).alias("confidence")
    order = [F.desc("confidence"), F.desc("source_confidence"), F.desc("sink_confidence"), F.desc("source"), F.desc("sink")]
    rows = pairs.select("*", mean)
    return rows.orderBy(*order).limit(k) if k else rows
