"""Matching entities of two sources without a common key: sorted neighbourhood, then one-to-one assignment.

Both sources are brought to the same fields: project, file (folder and class), source and sink variable with their
spelling taken off, lines. For each of several composite sort keys the records of both are sorted together over the
whole cluster and get a global rank; records of different sources whose ranks are at most WINDOW apart are compared.
Where more records than that tie, the window reaches on: records of one project and file are also compared when their
sinks share a name key, of which any two names that count as alike share one, and their lines a band or are unknown.
So every pair that the rules allow is met, however many records a file holds. A pair's confidence is the weighted similarity of its fields; rules
that a pair must keep (the same file, for one) drop the others.

Records of one source that are alike in all fields are one kind, compared once and then dealt out, so a group of copies
costs no more than one record. Of the pairs that are left, each record may be in one: the choice with the greatest
total confidence. Pairs of kinds without any rival are taken as they are. The others fall into components, which are
solved exactly as a transport of records from kinds to kinds, whatever their size; one component is never divided. A
component has one file and alike names, and a task holds its pairs of different kinds as flat arrays.

Defined results: a missing project, file or variable (also by the end of the path) makes no pair; a line that is null
or 0 is unknown and keeps no pair from being made; records that repeat a key count once; of choices with equal totals
one is taken by key order; empty tables give no pairs; extra columns are ignored.
"""

import heapq
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.lineage import cut, partitions
from chainloom.operators.graph import components
from chainloom.operators.ordering import running_sum

#: Ranks that a compared pair may be apart, lines that two sinks may be apart.
WINDOW, LINES_APART = 20, 8
#: Weights of the fields in the confidence.
WEIGHTS = {"project": 0.15, "file": 0.2, "source": 0.2, "sink": 0.2, "sink_line": 0.15, "source_line": 0.1}
#: Letters of a name that was cut off that are left at least.
CUT_OFF = 0.6
#: Pairs of kinds that are about as many as small components bring into one call together; this changes the cost only.
LARGE = 50_000
#: Records of a file that are compared with each other without name keys; this changes the cost only.
FEW = 64
FIELDS = ("project", "file", "source", "source_words", "sink", "sink_words", "source_line", "sink_line")


def project_key(c: Column) -> Column:
    """A project's name without case, separators, remarks, .git and leading folders."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)", ""), r"(\.git)?[\s/]*$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(plain, r"^.*/", ""), "[^a-z0-9]", ""), F.lit(""))


def file_key(c: Column) -> Column:
    """Folder and class of a path in any notation; null when there is no folder."""
    parts = F.split(F.regexp_replace(F.trim(c), r"(?i)\.java$", ""), r"[\\/]+")
    parts = F.filter(F.when(F.size(parts) > 1, parts).otherwise(F.split(parts[0], r"\.")), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.lower(F.array_join(F.slice(parts, -2, 2), "/")))


def _bare(c: Column) -> Column:
    """A variable's name without the parts that style guides add."""
    front = F.regexp_replace(F.trim(c), r"^(?:this\.|m_|p_|_+|str(?=[A-Z_]))+", "")
    return F.regexp_replace(front, r"(?:_?(?:Param|Str|In)|_(?:param|str|in)|_?[0-9]+)$", "")


def squashed(c: Column) -> Column:
    """The name in lower case without separators."""
    return F.nullif(F.regexp_replace(F.lower(_bare(c)), "[^a-z0-9]", ""), F.lit(""))


def words(c: Column) -> Column:
    """The words of the name in alphabetical order."""
    return F.array_join(F.array_sort(F.split(F.lower(F.regexp_replace(_bare(c), "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+")), "")


def skeleton(c: Column) -> Column:
    """The name without its vowels but the first letter."""
    return F.concat(F.left(c, F.lit(1)), F.regexp_replace(F.substring(c, 2, 1000), "[aeiou]", ""))


def prepared(df: DataFrame, key: str, project: Column, file: Column, source: Column, sink: Column, source_line: Column, sink_line: Column, newest: str | None = None) -> DataFrame:
    """(id, *FIELDS): the common fields, one row for each key."""
    known = lambda c: F.when(c > 0, c.cast("int"))
    own = df.select(
        F.col(key).cast("long").alias("id"), project_key(project).alias("project"), file_key(file).alias("file"),
        squashed(source).alias("source"), words(source).alias("source_words"), squashed(sink).alias("sink"), words(sink).alias("sink_words"),
        known(source_line).alias("source_line"), known(sink_line).alias("sink_line"),
    ).where("id is not null and project is not null and file is not null and source is not null and sink is not null")
    return own.groupBy("id").agg(F.max(F.struct(*FIELDS)).alias("x")).select("id", "x.*")


def variable_likeness(a: Column, a_words: Column, b: Column, b_words: Column) -> Column:
    """1 for the same name, less for the same name in another spelling, 0 for another name."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    cut_off = (short >= 5) & (short >= CUT_OFF * long) & (a.startswith(b) | b.startswith(a))
    slip = (short >= 5) & (F.levenshtein(a, b) <= 1)
    vowels = (short >= 3) & (short <= 0.85 * long) & (skeleton(a) == skeleton(b))
    return F.when(a == b, 1.0).when(a_words == b_words, 0.95).when(slip, 0.9).when(vowels | cut_off, 0.85).otherwise(0.0)


def ranked(records: DataFrame, *sort: Column) -> DataFrame:
    """records with rank, their place in the global order: a range partitioning, sorted parts, and the sizes of the
    parts before, of which there are as many as partitions."""
    parts = records.repartitionByRange(partitions(records.sparkSession), *sort).sortWithinPartitions(*sort)
    numbered = cut(parts.withColumn("at", F.monotonically_increasing_id()))
    split = numbered.withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = split.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return split.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select(*records.columns, (F.col("before") + F.col("row")).alias("rank"))


def neighbours(records: DataFrame, window: int, *sort: Column) -> DataFrame:
    """(a_id, b_id): records of side a and b of one place (project and file) that are at most window apart in the order
    of places and, within them, of sort."""
    keys = [f"k{i}" for i in range(len(sort))]
    narrow = records.select("side", "id", F.xxhash64("project", "file").alias("place"), *[c.alias(k) for k, c in zip(keys, sort)])
    placed = ranked(narrow, F.col("place"), *map(F.col, keys)).select("side", "id", "place", "rank", F.floor(F.col("rank") / window).alias("block"))
    a = placed.where("side = 'a'").select("block", "place", F.col("rank").alias("rank_a"), F.col("id").alias("a_id"))
    b = placed.where("side = 'b'").select(F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), "place", F.col("rank").alias("rank_b"), F.col("id").alias("b_id"))
    return a.join(b, ["block", "place"]).where(F.abs(F.col("rank_a") - F.col("rank_b")) <= window).select("a_id", "b_id")


def name_keys(name: Column, name_words: Column) -> Column:
    """Keys of a name; names with a likeness over 0 share at least one: a slip a name less one letter, a cut-off name the
    first five letters."""
    less_one = F.when(F.length(name) >= 5, F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.lit("n:"), F.left(name, i - 1), F.substr(name, i + 1))))
    start = F.when(F.length(name) >= 5, F.array(F.concat(F.lit("c:"), F.left(name, F.lit(5)))))
    none = F.array().cast("array<string>")
    whole = F.array(F.concat(F.lit("n:"), name), F.concat(F.lit("w:"), name_words), F.concat(F.lit("v:"), skeleton(name)))
    return F.array_distinct(F.concat(whole, F.coalesce(less_one, none), F.coalesce(start, none)))


def same_key(records: DataFrame) -> DataFrame:
    """(a_id, b_id): records of side a and b of one project and file with a common key of the sink and lines in the same
    or the next band; a record without a line meets all of its key. The few records of a small file meet as they are."""
    few = cut(records.groupBy("project", "file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("side").alias("sides")).where(F.col("sides") == 2).drop("sides"))
    records = records.join(few, ["project", "file"])
    side_of = lambda side: records.where((F.col("side") == side) & (F.col("n") <= FEW)).select("project", "file", F.col("id").alias(f"{side}_id"))
    together = side_of("a").join(side_of("b"), ["project", "file"]).select("a_id", "b_id")
    records = records.where(F.col("n") > FEW)
    band, known, any_line = F.floor(F.col("sink_line") / LINES_APART), F.lit(-2).cast("long"), F.lit(-3).cast("long")
    cells = {
        "a": F.when(F.col("sink_line").isNull(), F.array(any_line)).otherwise(F.array(band, known)),
        "b": F.when(F.col("sink_line").isNull(), F.array(known, any_line)).otherwise(F.array(band - 1, band, band + 1, any_line)),
    }

    def keyed(side: str) -> DataFrame:
        own = records.where(F.col("side") == side).select(F.col("id").alias(f"{side}_id"), "project", "file", cells[side].alias("cells"), F.explode(name_keys(F.col("sink"), F.col("sink_words"))).alias("key"))
        return own.select(f"{side}_id", F.explode("cells").alias("cell"), F.xxhash64("project", "file", "key").alias("key"))

    return together.unionByName(keyed("a").join(keyed("b"), ["key", "cell"]).select("a_id", "b_id"))


def candidates(a: DataFrame, b: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a_id, b_id, confidence): compared pairs that keep the rules."""
    records = cut(a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))))
    line = F.coalesce("sink_line", F.col("source_line") + 10, F.lit(0))
    keys = [
        [skeleton(F.col("sink")), skeleton(F.col("source")), line, F.col("id")],
        [skeleton(F.col("source")), skeleton(F.col("sink")), line, F.col("id")],
        [line, F.col("sink"), F.col("id")],
        [F.col("sink_words"), F.col("source_words"), line, F.col("id")],
    ]
    met = neighbours(records, window, *keys[0])
    for key in keys[1:]:
        met = met.unionByName(neighbours(records, window, *key))
    whole = lambda side: records.where(F.col("side") == side).select(F.col("id").alias(f"{side}_id"), F.struct("id", *FIELDS).alias(side))
    met = met.unionByName(same_key(records)).distinct().join(whole("a"), "a_id").join(whole("b"), "b_id").select("a", "b")
    near = lambda x, y, far: F.when(x.isNull() | y.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(x - y) / far))
    alike = {
        "project": (F.col("a.project") == F.col("b.project")).cast("double"), "file": (F.col("a.file") == F.col("b.file")).cast("double"),
        "source": variable_likeness(F.col("a.source"), F.col("a.source_words"), F.col("b.source"), F.col("b.source_words")),
        "sink": variable_likeness(F.col("a.sink"), F.col("a.sink_words"), F.col("b.sink"), F.col("b.sink_words")),
        "sink_line": near(F.col("a.sink_line"), F.col("b.sink_line"), 2.0 * LINES_APART), "source_line": near(F.col("a.source_line"), F.col("b.source_line"), 4.0 * LINES_APART),
    }
    same = met.where((F.col("a.project") == F.col("b.project")) & (F.col("a.file") == F.col("b.file")) & F.coalesce(F.abs(F.col("a.sink_line") - F.col("b.sink_line")) <= LINES_APART, F.lit(True)))
    scored = same.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), *[v.alias(k) for k, v in alike.items()]).where("source > 0 and sink > 0")
    return scored.select("a_id", "b_id", sum(F.col(k) * w for k, w in WEIGHTS.items()).alias("confidence"))


def transport(supply: list[int], room: list[int], pairs: Sequence[Iterable[tuple[int, float]]]) -> dict[tuple[int, int], int]:
    """How many records go from each left to each right kind, with the greatest total gain; gains are positive.

    pairs lists for each left kind its right kinds with their gains. Shortest augmenting paths by costs that potentials
    keep from being negative; a record may also stay alone, at no gain.
    """
    flow: dict[tuple[int, int], int] = {}
    back: list[set[int]] = [set() for _ in room]
    left, free = list(supply), list(room)
    u, v = [-max((w for _, w in own), default=0.0) for own in pairs], [0.0] * len(room)
    for start in range(len(pairs)):
        while left[start]:
            best, end, alone = float("inf"), None, True
            rows, columns, came, via = {start: 0.0}, {}, {}, {}
            heap, done = [(0.0, 0, start)], set()
            while heap:
                d, kind, x = heapq.heappop(heap)
                if d >= best:
                    break
                if (kind, x) in done:
                    continue
                done.add((kind, x))
                if kind == 0:
                    if d - u[x] < best:
                        best, end, alone = d - u[x], x, True
                    for j, w in pairs[x]:
                        to = d + max(0.0, -w - u[x] - v[j])
                        if to < columns.get(j, float("inf")):
                            columns[j], came[j] = to, x
                            heapq.heappush(heap, (to, 1, j))
                elif free[x]:
                    best, end, alone = d, x, False
                else:
                    for y in back[x]:
                        if d < rows.get(y, float("inf")):
                            rows[y], via[y] = d, x
                            heapq.heappush(heap, (d, 0, y))
            for kind, x in done:
                if kind == 0 and rows[x] < best:
                    u[x] += best - rows[x]
                elif kind == 1 and columns[x] < best:
                    v[x] -= best - columns[x]
            # Walk back: new[(x, j)] gains, old[(y, j)] loses.
            gains, losses, row = [], [], end
            if not alone:
                gains.append((came[end], end))
                row = came[end]
            while row != start:
                losses.append((row, via[row]))
                gains.append((came[via[row]], via[row]))
                row = came[via[row]]
            n = min([left[start], *(flow[e] for e in losses), *([] if alone else [free[end]])])
            for e in losses:
                flow[e] -= n
                if not flow[e]:
                    del flow[e]
                    back[e[1]].discard(e[0])
            for e in gains:
                flow[e] = flow.get(e, 0) + n
                back[e[1]].add(e[0])
            left[start] -= n
            if not alone:
                free[end] -= n
    return flow


_FLOW = "a_id long, b_id long, confidence double, n long"


class _Gains:
    """The pairs of left kinds, in the order of their rows, as arrays: some bytes for a pair, where tuples take hundreds."""

    def __init__(self, first, right, gain):
        self.first, self.right, self.gain = first, right, gain

    def __len__(self):
        return len(self.first) - 1

    def __getitem__(self, i):
        own = slice(self.first[i], self.first[i + 1])
        return zip(self.right[own].tolist(), self.gain[own].tolist())

    def __iter__(self):
        return (self[i] for i in range(len(self)))


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """The flows of whole components. A search never leaves the component that it starts in, so several at once are solved
    as each alone would be."""
    pdf = pdf.sort_values(["a_id", "b_id"])
    a, at, n = np.unique(pdf.a_id.to_numpy(), return_index=True, return_counts=True)
    b, bt, right = np.unique(pdf.b_id.to_numpy(), return_index=True, return_inverse=True)
    gain = pdf.confidence.to_numpy()
    flow = sorted(transport(pdf.a_n.to_numpy()[at].tolist(), pdf.b_n.to_numpy()[bt].tolist(), _Gains(np.append(at, at[-1] + n[-1]), right, gain)).items())
    at_pair = [at[i] + np.searchsorted(right[at[i] : at[i] + n[i]], j) for (i, j), _ in flow]
    return pd.DataFrame([(a[i], b[j], gain[k], m) for ((i, j), m), k in zip(flow, at_pair)], columns=["a_id", "b_id", "confidence", "n"])


def assign(pairs: DataFrame, large: int = LARGE) -> DataFrame:
    """(a_id, b_id, confidence, n): how many records of kind a_id go with kind b_id, with the greatest total confidence.

    pairs (a_id, a_n, b_id, b_n, confidence) are different pairs of kinds of a_n and b_n records. Components of fewer than
    large pairs share calls, about as many pairs in one; results are the same for any.
    """
    pairs = cut(pairs)
    alone = lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias(f"{c}_times"))
    counted = pairs.join(alone("a_id"), "a_id").join(alone("b_id"), "b_id")
    single = counted.where("a_id_times = 1 and b_id_times = 1").select("a_id", "b_id", "confidence", F.least("a_n", "b_n").alias("n"))
    rest = cut(counted.where("a_id_times > 1 or b_id_times > 1").select(*pairs.columns))
    if rest.isEmpty():
        return single
    # Kinds of both sides in one numbering: even for a, odd for b.
    groups = components(rest.select(F.shiftleft("a_id", 1).alias("src"), (F.shiftleft("b_id", 1) + 1).alias("dst")))
    grouped = rest.join(groups, F.shiftleft("a_id", 1) == F.col("node")).select(F.col("component").alias("group_id"), *pairs.columns)
    sizes = cut(grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")))
    calls = sizes.where(F.col("n") < large).agg(F.coalesce(F.ceil(F.sum("n") / large), F.lit(1))).first()[0]
    call = F.when(F.col("n") < large, F.pmod(F.xxhash64("group_id"), F.lit(max(calls, partitions(pairs.sparkSession)))))
    called = grouped.join(sizes.select("group_id", call.alias("call"), F.when(F.col("n") >= large, F.col("group_id")).alias("whole")), "group_id")
    return single.unionByName(called.select(*pairs.columns, "call", "whole").groupBy("call", "whole").applyInPandas(_solve, _FLOW))


def kinds(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One record (with its number n) for each kind, by its least id; and (id, kind, place): the members of kinds."""
    alike = cut(records.groupBy(*FIELDS).agg(F.min("id").alias("kind"), F.count(F.lit(1)).alias("n")))
    copied = alike.where("n > 1").alias("y")
    same = F.lit(True)
    for f in FIELDS:
        same = same & F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}"))
    copies = running_sum(records.alias("x").join(copied, same).select("id", "kind"), "kind", ["id"], None, "place")
    return alike.withColumnRenamed("kind", "id"), copies.select("id", "kind", "place").unionByName(alike.where("n = 1").select(F.col("kind").alias("id"), "kind", F.lit(1).cast("long").alias("place")))


def dealt(flows: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, confidence) of single records: each kind's members go to its partners one after another."""
    upto = lambda side, other: F.sum("n").over(Window.partitionBy(f"{side}_id").orderBy(f"{other}_id")) - F.col("n")
    units = flows.select("*", upto("a", "b").alias("a_from"), upto("b", "a").alias("b_from")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    units = units.select("confidence", F.col("a_id").alias("a_kind"), (F.col("a_from") + F.col("i")).alias("a_place"), F.col("b_id").alias("b_kind"), (F.col("b_from") + F.col("i")).alias("b_place"))
    for side, members in (("a", a), ("b", b)):
        units = units.join(members.select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"), F.col("place").alias(f"{side}_place")), [f"{side}_kind", f"{side}_place"])
    return units.select("a_id", "b_id", "confidence")


def match_records(a: DataFrame, b: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a_id, b_id, confidence) of the matched records of two prepared sources."""
    (a_kinds, a_members), (b_kinds, b_members) = kinds(cut(a)), kinds(cut(b))
    size = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"))
    pairs = candidates(a_kinds.drop("n"), b_kinds.drop("n"), window).join(size(a_kinds, "a"), "a_id").join(size(b_kinds, "b"), "b_id")
    return dealt(assign(pairs), a_members, b_members)
