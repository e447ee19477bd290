"""Walks from sources to sinks over the variables of files, most of whose calls lead to files that lie close, and the
sanitizers on their way.

Files are divided by their order into regions. Each task holds one region with all files that calls lead to from it within
the bound, as arrays, and walks from the region's sources. So flows and endpoints are shuffled once, and neither pairs of
sources and nodes nor chains are written or joined on the way. Files that are copied to other regions too often to gain by
it, or too few to divide, are left to the joins of operators.graph.

Defined results are those of operators.chains; files without a name have no nodes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.lineage import cut, partitions, stored
from chainloom.operators import source_text

#: Files of a region at least, copies of each file at most, files that are looked at to divide them, sources that are
#: walked at once, and chains in a batch of results; these change the cost only.
FEW, COPIES, LOOKED, ROOM, BATCH = 64, 3, 10_000, 4096, 1 << 15
_EDGE, _SOURCE, _SINK, _SANITIZER = range(4)
_CHAIN = "source_file string, source_variable string, source_line int, sink_file string, sink_variable string, sink_line int, path array<string>, lines array<int>, rules array<string>, effects array<double>"


def _region(bounds: list, file: str | Column) -> Column:
    """How many bounds are not above a file, by halves."""
    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(file) < F.lit(bounds[mid]), among(low, mid)).otherwise(among(mid + 1, high))

    return among(0, len(bounds))


def _divided(files: DataFrame) -> tuple[list, int]:
    """Bounds of the regions of files, and the number of files."""
    names = files.where("file is not null").select("file")
    total = names.count()
    many = min(partitions(files.sparkSession), total // FEW)
    some = sorted(r.file for r in names.orderBy(F.xxhash64("file"), "file").limit(LOOKED).collect()) if many > 1 else []
    return sorted({some[len(some) * i // many] for i in range(1, many)}), total


def _copied(bridges: DataFrame, bounds: list, bound: int, most: int) -> DataFrame | None:
    """(file, region): files of other regions that calls lead to from a region within the bound; None if there are more
    than most."""
    home = lambda c: _region(bounds, c)
    calls = cut(bridges.select(F.col("file").alias("src"), F.col("owner").alias("dst")).distinct())
    frontier = calls.where(home("src") != home("dst")).select(F.col("dst").alias("file"), home("src").alias("region")).distinct()
    seen = frontier = cut(frontier)
    for _ in range(bound):
        if frontier.isEmpty():
            break
        if seen.count() > most:
            return None
        met = calls.join(F.broadcast(frontier), F.col("src") == F.col("file")).where(home("dst") != F.col("region"))
        met = met.select(F.col("dst").alias("file"), "region").distinct()
        frontier = cut(met.join(seen, ["file", "region"], "left_anti"))
        seen = seen.unionByName(frontier)
    return None if seen.count() > most else cut(seen)


def _rows(files: DataFrame, bridges: DataFrame) -> DataFrame:
    """(file, kind, a, b, c, n, x): edges between nodes (a, b), sources (a; line n), sinks (a; line n, kind b) and
    sanitizers (a; line n, name b, kinds c, effectiveness x)."""
    at = lambda f, v: F.concat_ws(":", F.col(f), F.col(v))
    none = {"b": F.lit(None).cast("string"), "c": F.lit(None).cast("string"), "n": F.lit(None).cast("int"), "x": F.lit(None).cast("double")}
    row = lambda df, kind, a, **k: df.select("file", F.lit(kind).alias("kind"), a.alias("a"), *[k.get(c, v).alias(c) for c, v in none.items()])
    met = source_text.call_ends(files)
    called = met.select("file", F.when(F.col("vuln_type").isNull(), _EDGE).otherwise(_SINK).alias("kind"), at("file", "from_var").alias("a"), F.coalesce("vuln_type", at("file", "to_var")).alias("b"), none["c"].alias("c"), F.col("line_number").alias("n"), none["x"].alias("x"))
    parts = [
        called, row(source_text.assignments(files), _EDGE, at("file", "from_var"), b=at("file", "to_var")),
        row(bridges, _EDGE, at("file", "argument"), b=at("owner", "parameter")),
        row(source_text.static_sources(files), _SOURCE, at("file", "variable"), n=F.col("line_number")),
        row(source_text.static_sanitizers(files), _SANITIZER, F.when(F.col("variable").isNotNull(), at("file", "variable")), n=F.col("line_number"), b=F.col("sanitizer"), c=F.col("protects"), x=F.col("effectiveness")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def held(files: DataFrame, nodes: int) -> DataFrame | None:
    """Rows (kind, home, a, b, c, n, x) of which each partition has a region of stored files (file, text) and all that its sources reach by
    paths of so many nodes; None if the files don't lie so that this pays."""
    bounds, total = _divided(files)
    if not bounds:
        return None
    files = files.where("file is not null")
    bridges = stored(source_text.call_bridges(files).select("file", "argument", "owner", "parameter"))
    copied = _copied(bridges, bounds, nodes - 1, COPIES * total)
    if copied is None:
        return None
    others = F.broadcast(copied.groupBy("file").agg(F.collect_list("region").alias("others")))
    all_ = F.concat(F.array(_region(bounds, "file")), F.coalesce("others", F.array().cast("array<int>")))
    rows = _rows(files, bridges).join(others, "file", "left").select("kind", "a", "b", "c", "n", "x", F.posexplode(all_).alias("at", "region"))
    rows = rows.where((F.col("at") == 0) | (F.col("kind") != _SOURCE)).withColumn("home", F.col("at") == 0)
    return rows.repartitionById(len(bounds) + 1, F.col("region")).select("kind", "home", "a", "b", "c", "n", "x")


class _Region:
    """Nodes numbered in the order of their names; the ways out of node i are nexts[first[i]:first[i + 1]], in order."""

    def __init__(self, batches: Iterator[pa.RecordBatch], bound: int):
        some = list(batches)
        rows = pa.Table.from_batches(some, some[0].schema if some else pa.schema([("kind", pa.int32()), ("home", pa.bool_()), ("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("n", pa.int32()), ("x", pa.float64())]))
        of = [rows.filter(pc.equal(rows["kind"], k)) for k in range(4)]
        del some, rows
        self.bound = bound
        home = [int(pc.sum(t["home"]).as_py() or 0) for t in of]
        parts = [of[_EDGE]["a"], of[_EDGE]["b"], of[_SOURCE]["a"], of[_SINK]["a"]]
        coded = pa.chunked_array([c for p in parts for c in p.chunks], pa.string()).combine_chunks()
        coded = (coded if isinstance(coded, pa.Array) else pa.concat_arrays(coded.chunks)).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.names, self.n = coded.dictionary.take(pa.array(order)), len(order)
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(self.n)
        ids = np.split(rank[coded.indices.to_numpy()], np.cumsum([len(p) for p in parts])[:-1])
        del coded
        near = of[_EDGE]["home"].to_numpy().astype(bool)
        key = ids[0] * self.n + ids[1]
        self.counts = {"sources": home[_SOURCE], "sinks": home[_SINK], "sanitizers": home[_SANITIZER], "edges": len(np.unique(key[near]))}
        src, dst = np.divmod(np.unique(key), max(self.n, 1))
        none = np.int32(2**31 - 1)
        self.source_line, self.sink_line, self.kind = np.full(self.n, none), np.full(self.n, none), np.full(self.n, -1, np.int32)
        np.minimum.at(self.source_line, ids[2], of[_SOURCE]["n"].to_numpy())
        self.sources = np.unique(ids[2])
        # Of the sinks of a node the first by line, then by kind, counts.
        kinds = sorted(pc.unique(of[_SINK]["b"]).to_pylist())
        kind = pc.index_in(of[_SINK]["b"], value_set=pa.array(kinds, pa.string())).to_numpy()
        line = of[_SINK]["n"].to_numpy()
        last = np.lexsort((kind, line, ids[3]))[::-1]
        self.sink_line[ids[3][last]], self.kind[ids[3][last]] = line[last], kind[last]
        # Nodes from which no sink is near are left out.
        self.back = np.full(self.n, bound + 1, np.int32)
        self.back[ids[3]] = 0
        for depth in range(1, bound + 1):
            met = src[self.back[dst] == depth - 1]
            self.back[met[self.back[met] > depth]] = depth
        kept = self.back[dst] < bound
        src, self.nexts = src[kept], dst[kept]
        self.first = np.searchsorted(src, np.arange(self.n + 1))
        self.sources = self.sources[self.back[self.sources] <= bound]
        self._name(of[_SANITIZER], kinds)

    def _name(self, found: pa.Table, kinds: list[str]) -> None:
        """Files and variables of nodes, and the sanitizers (line, rule) of each variable of a file."""
        halves = lambda x: (lambda f: (f.take(pa.array(np.arange(0, 2 * len(x), 2))), f.take(pa.array(np.arange(1, 2 * len(x), 2)))))(pc.split_pattern(x, ":", max_splits=1, reverse=True).flatten())
        files, variables = (x.dictionary_encode() for x in halves(self.names))
        self.files, self.variables = files.dictionary, variables.dictionary
        self.file, self.variable = files.indices.to_numpy().astype(np.int64), variables.indices.to_numpy().astype(np.int64)
        found = found.filter(pc.is_valid(found["a"])).combine_chunks()
        whole = lambda c: pa.concat_arrays(found[c].chunks) if found[c].num_chunks else pa.array([], found.schema.field(c).type)
        file, variable = halves(whole("a"))
        file, variable = (pc.fill_null(pc.index_in(x, value_set=v), -1).to_numpy().astype(np.int64) for x, v in ((file, self.files), (variable, self.variables)))
        rules = list(zip(*(whole(c).to_pylist() for c in ("b", "c", "x"))))
        self.rules = sorted(set(rules))
        at = {r: i for i, r in enumerate(self.rules)}
        # Rules of one name and effectiveness are one in results.
        same = {r: i for i, r in reversed([*enumerate((b, x) for b, _, x in self.rules)])}
        self.shown = np.array([same[b, x] for b, _, x in self.rules], np.int64)
        self.against = np.array([[k in c.split(",") for _, c, _ in self.rules] for k in kinds], bool).reshape(len(kinds), len(self.rules))
        self.effect = np.array([x for _, _, x in self.rules], float)
        rule, line = np.array([at[r] for r in rules], np.int64), whole("n").to_numpy()
        both = (file >= 0) & (variable >= 0)
        key = (file * max(len(self.variables), 1) + variable)[both]
        order = np.argsort(key, kind="stable")
        self.keys, self.begin, self.many = np.unique(key[order], return_index=True, return_counts=True)
        self.line, self.rule = line[both][order].astype(np.int64), rule[both][order]
        self.known = np.zeros(len(self.variables), bool)
        self.known[variable[both]] = True

    def walk(self) -> Iterator[np.ndarray]:
        """Paths, as rows of nodes, of the chains of some sources at a time: the shortest, of equally short ones the least.

        Nodes of a level lie in the order of their least paths, so the first way to a node is the least."""
        ways = np.diff(self.first)
        for i in range(0, len(self.sources), ROOM):
            node = self.sources[i : i + ROOM]
            of = np.arange(len(node))
            levels, seen = [(node, of)], of * self.n + node
            for depth in range(1, self.bound + 1):
                out = ways[node]
                before = np.repeat(np.arange(len(node)), out)
                to = self.nexts[(self.first[node] - np.cumsum(out) + out)[before] + np.arange(len(before))]
                near = np.flatnonzero(self.back[to] <= self.bound - depth)
                before, to = before[near], to[near]
                key, once = np.unique(of[before] * self.n + to, return_index=True)
                spot = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
                new = seen[spot] != key
                if not new.any():
                    break
                seen = np.sort(np.concatenate([seen, key[new]]), kind="stable")
                once = np.sort(once[new])
                before = before[once]
                of, node = of[before], to[once]
                levels.append((node, before))
                row = np.flatnonzero(self.back[node] == 0)
                for j in range(0, len(row), BATCH):
                    some = row[j : j + BATCH]
                    path = np.empty((len(some), depth + 1), np.int64)
                    for k in range(depth, -1, -1):
                        path[:, k], some = levels[k][0][some], levels[k][1][some]
                    yield path

    def on_way(self, path: np.ndarray, behind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chain, line, rule) of the sanitizers on the way of chains, in that order, each once: in the files of the ends,
        from the source's line and so many lines behind the sink's, on a variable of the chain, against its kind."""
        start, end = path[:, 0], path[:, -1]
        inside = self.file[start] == self.file[end]
        low, high = np.minimum(self.source_line[start], self.sink_line[end]), np.maximum(self.source_line[start], self.sink_line[end])
        chain, column = np.nonzero(self.known[self.variable[path]])
        variable = self.variable[path[chain, column]]
        got = []
        for first, file in ((True, self.file[start]), (False, self.file[end])):
            own = np.arange(len(chain)) if first else np.flatnonzero(~inside[chain])
            if not len(self.keys) or not len(own):
                continue
            key = file[chain[own]] * len(self.variables) + variable[own]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[spot] == key)
            spot, c = spot[hit], chain[own[hit]]
            many = self.many[spot]
            row = np.repeat(self.begin[spot] - np.cumsum(many) + many, many) + np.arange(many.sum())
            c = np.repeat(c, many)
            line, rule = self.line[row], self.rule[row]
            across = line >= self.source_line[start[c]] if first else line <= self.sink_line[end[c]] + behind
            fits = np.where(inside[c], (line >= low[c]) & (line <= high[c] + behind), across) & self.against[self.kind[end[c]], rule]
            got.append(np.stack([c[fits], line[fits], self.shown[rule[fits]]], 1))
        rows = np.unique(np.concatenate(got), axis=0) if got else np.empty((0, 3), np.int64)
        return rows[:, 0], rows[:, 1], rows[:, 2]


def chains(rows: DataFrame, nodes: int, behind: int, only_met: bool) -> DataFrame:
    """(source_file, ..., sink_line, path, lines, rules, effects) of the chains of held rows, with the sanitizers on their
    way; with only_met the chains that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region = _Region(batches, nodes - 1)
        for path in region.walk():
            chain, line, rule = region.on_way(path, behind)
            if only_met:
                met, chain = np.unique(chain, return_inverse=True)
                path = path[met]
            if not len(path):
                continue
            upto = pa.array(np.searchsorted(chain, np.arange(len(path) + 1)), pa.int32())
            lists = lambda x: pa.ListArray.from_arrays(upto, x)
            start, end = path[:, 0], path[:, -1]
            side = lambda at, lines: [region.files.take(pa.array(region.file[at])), region.variables.take(pa.array(region.variable[at])), pa.array(lines[at], pa.int32())]
            way = pa.ListArray.from_arrays(pa.array(np.arange(len(path) + 1) * path.shape[1], pa.int32()), region.names.take(pa.array(path.ravel())))
            names = pa.array([b for b, _, _ in region.rules], pa.string())
            columns = [*side(start, region.source_line), *side(end, region.sink_line), way, lists(pa.array(line, pa.int32())), lists(names.take(pa.array(rule))), lists(pa.array(region.effect[rule], pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [x.strip().split(" ")[0] for x in _CHAIN.split(", ")])

    return rows.mapInArrow(run, _CHAIN)


def counts(rows: DataFrame, nodes: int, behind: int, strong: float) -> DataFrame:
    """(metric, n): how many sources, sinks, sanitizers, distinct edges and chains the held rows have, and how many of the
    chains a sanitizer of that effectiveness rejects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region = _Region(batches, nodes - 1)
        n = region.counts | {"chains": 0, "rejected": 0}
        for path in region.walk():
            chain, _, rule = region.on_way(path, behind)
            n["chains"] += len(path)
            n["rejected"] += len(np.unique(chain[region.effect[rule] >= strong]))
        yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64())], ["metric", "n"])

    return rows.mapInArrow(run, "metric string, n long").groupBy("metric").agg(F.sum("n").alias("n"))
