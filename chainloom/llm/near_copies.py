"""Near-duplicate records with small edits: all pairs of texts whose character n-grams have a Jaccard likeness of at
least a threshold, by a generalised pigeonhole.

A text is a set of bits, one for each n-gram in it. Equal sets become one class, so copies cost nothing. Bits are
ordered from rare to frequent by counts over all records. If two sets of a and b bits share at least o bits, then the
rarest a - o + l bits of the one and b - o + l of the other share at least l (l: the depth). Bits are divided into
partitions, and with thresholds t of the partitions for which the sum of (t - 1) is l - 1, at least one partition has
t shared bits: the generalised pigeonhole (pairs that need to share fewer than l bits meet by single bits). The probe of a partition is each combination of t of the set's bits in it.

Correlated bits (n-grams of one word) are found on a bounded sample of SAMPLE records and kept together: a group goes
to one partition as a whole. Groups are laid out from rare to frequent, so partitions differ in how often two records
share a bit of them. The thresholds are allocated by dynamic programming on the numbers of candidates and of probes
that the sample predicts for the whole collection, over all depths: partitions of rare bits keep a low threshold,
partitions of frequent ones get a higher one, and a larger collection gets higher thresholds. Sample, layout and
thresholds change only the cost: no pair is lost for any of them.

A set of more than WIDE bits has each partition split in 2, 4, 8 and so on by hash, with the same thresholds in each, so
that the probes of a set grow with its bits and not with a power of them. The smaller set of a pair decides how finely
both are split; a set near the border is entered both ways.

Candidates are met in an equi-join of the probes. Its condition holds what a pair must have: sizes in proportion, and
folded bit vectors at a Hamming distance that the threshold allows. The pairs that pass are checked exactly on the sets.

Defined results: a null text, and one too short for an n-gram, is in no pair; rows that repeat an id count once, with
the least of their texts; records with equal sets are pairs with likeness 1; a pair has the smaller id first; an empty
table gives an empty table; other columns are ignored.
"""

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.lineage import cut
from chainloom.operators.graph import components

#: Buckets in which bits are counted, partitions, the highest threshold, and bits above which partitions are split.
BUCKETS, PARTS, HIGHEST, WIDE = 1 << 16, 10, 3, 256
#: Records in the sample and bits of each that are looked at.
SAMPLE, SAMPLE_BITS = 1_000, 512
#: The depths that are tried.
DEPTHS = tuple(range(1, PARTS * (HIGHEST - 1) + 2))
#: Relative cost of writing a probe and of meeting a candidate.
PROBE_COST, MEET_COST = 30.0, 1.0
#: Words of 64 bits in the folded vectors.
WORDS = 3
VECTOR = [f"v{i}" for i in range(WORDS)]
_SETS = "id long, class long, size int, bits array<long>, " + ", ".join(f"{v} long" for v in VECTOR)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _bits(text: str, gram: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)
    n = len(codes) - gram + 1
    if n < 1:
        return np.zeros(0, _U)
    h = np.zeros(n, _U)
    for i in range(gram):
        h = _mix(h + codes[i : i + n] + _U(i + 1))
    return np.unique(h)


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bits folded by parity into a vector of 64 * words bits, as signed numbers."""
    at = (bits >> _U(20)) % _U(64 * words)
    odd = (np.bincount(at.astype(np.int64), minlength=64 * words) & 1).astype(bool)
    return np.packbits(odd).view(np.int64)


def _sets(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits = _bits(text, gram)
                if len(bits):
                    order = _mix(np.arange(1, len(bits) + 1, dtype=_U))
                    fold = _fold(bits, WORDS)
                    rows.append((key, int(np.bitwise_xor.reduce(_mix(bits * order)).view(np.int64)), len(bits), bits.view(np.int64), *fold.tolist()))
            columns = list(zip(*rows)) if rows else [[]] * (4 + WORDS)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types)], ["id", "class", "size", "bits", *VECTOR])

    return run


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(_U)
        total += np.bincount((flat % _U(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])


def overlap(a: int, b: int, threshold: float) -> int:
    """Bits that two sets of a and b bits share at least when their likeness reaches the threshold."""
    return math.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def tier(size: int) -> int:
    """How many times partitions are halved for sets of this size."""
    return max(0, math.ceil(math.log2(max(1, size) / WIDE)))


class Layout:
    """Counts of the buckets, the partition of each, and the threshold of each partition."""

    def __init__(self, counts: np.ndarray, threshold: float) -> None:
        self.counts, self.threshold = counts, threshold
        self.part = (np.arange(BUCKETS) * 7919 % BUCKETS) % PARTS
        self.thresholds = np.ones(PARTS, np.int64)
        self.cost = math.inf
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def combinations(self, n: int, t: int) -> np.ndarray:
        if (n, t) not in self.known:
            self.known[n, t] = np.array(list(itertools.combinations(range(n), t)), dtype=np.int64).reshape(-1, t)
        return self.known[n, t]

    def depth(self, halved: int = 0) -> int:
        return (int((self.thresholds - 1).sum()) << halved) + 1

    def rare_first(self, bits: np.ndarray) -> np.ndarray:
        return bits[np.lexsort((bits, self.counts[(bits % _U(BUCKETS)).astype(np.int64)]))]

    def spare(self, size: int) -> tuple[int, int]:
        """How many bits the smaller and the larger set of a pair may have that the other lacks."""
        return size - overlap(size, size, self.threshold), size - math.ceil(self.threshold * size - 1e-9)

    def probes(self, ordered: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hash of each combination, whether the smaller set of a pair needs it).

        Pairs that need to share fewer bits than the depth, so pairs of small sets, meet by single bits instead.
        """
        size = len(ordered)
        for halved in range(tier(math.ceil(self.threshold * size - 1e-9)), tier(size) + 1):
            own, depth = halved == tier(size), self.depth(halved)
            if size >= depth:
                for _, h, last in self.combined(ordered, depth, self.thresholds, halved, 2 * halved):
                    yield h, (last < self.spare(size)[0] + depth) & own
            if math.ceil(self.threshold * size - 1e-9) < depth:
                for _, h, last in self.combined(ordered, 1, np.ones(PARTS, np.int64), halved, 2 * halved + 1):
                    yield h, (last < self.spare(size)[0] + 1) & own

    def combined(self, ordered: np.ndarray, depth: int, thresholds: np.ndarray, halved: int, salt: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(partition, hash, place of its last bit) of the combinations of a set's rarest bits."""
        own = ordered[: self.spare(len(ordered))[1] + depth]
        part = (self.part[(own % _U(BUCKETS)).astype(np.int64)] << halved) + ((own >> _U(32)) % _U(1 << halved)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            p = int(part[at[0]]) if len(at) else 0
            t = int(thresholds[p >> halved])
            if len(at) >= t:
                chosen = at[self.combinations(len(at), t)]
                h = np.full(len(chosen), p * 1024 + salt + 1, _U)
                for i in range(t):
                    h = _mix(h + own[chosen[:, i]])
                yield p >> halved, h, chosen[:, -1]


def _group_correlated(layout: Layout, ordered: list[np.ndarray]) -> None:
    """Give each group of correlated buckets a partition: from rare to frequent, an equal share of rare bits in each.

    Buckets that stand in the same records mostly share the least record by a random order; those are a group. A bucket
    that no sampled record has is a group of its own.
    """
    group, order = np.arange(BUCKETS) + len(ordered), np.random.default_rng(7).permutation(len(ordered))
    weight = np.zeros(BUCKETS)
    for bits, place in zip(ordered, order):
        at = (bits % _U(BUCKETS)).astype(np.int64)
        group[at] = np.minimum(group[at], place)
        np.add.at(weight, at[: layout.spare(len(at))[1] + DEPTHS[len(DEPTHS) // 2]], 1)
    size = np.bincount(group, minlength=BUCKETS + len(ordered))
    # Groups of one frequency are told apart by a fraction, so that a border may lie between them.
    often = np.bincount(group, layout.counts, minlength=len(size)) / np.maximum(1, size) + np.arange(len(size)) * 0.6180339887 % 1
    heavy = np.bincount(group, weight, minlength=len(size))
    place = np.argsort(often, kind="stable")
    share = np.cumsum(heavy[place]) / max(1.0, heavy.sum())
    part = np.empty(len(size), np.int64)
    part[place] = np.minimum(PARTS - 1, (share * PARTS * (1 - 1e-12)).astype(np.int64))
    layout.part = part[group]


def _predicted(layout: Layout, ordered: list[np.ndarray], records: int) -> np.ndarray:
    """Cost by (depth, partition, threshold) of probes and candidates, as the sample predicts them for all records."""
    cost, n = np.full((len(DEPTHS), PARTS, HIGHEST + 1), np.inf), len(ordered)
    for t in range(1, HIGHEST + 1):
        found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(PARTS)]
        for bits in ordered:
            small, large = layout.spare(len(bits))
            for p, h, last in layout.combined(bits, DEPTHS[-1], np.full(PARTS, t), 0, 0):
                found[p].append((h, last - large, last - small))
        for p in range(PARTS):
            hashed, large, small = (np.concatenate([x[i] for x in found[p]] or [np.zeros(0, np.int64)]) for i in range(3))
            order = np.argsort(hashed, kind="stable")
            hashed, large, small = hashed[order], large[order], small[order]
            for i, depth in enumerate(DEPTHS):
                own = large < depth
                edge = np.flatnonzero(np.concatenate(([True], np.diff(hashed[own].view(np.int64)) != 0))) if own.any() else []
                if not len(edge):
                    cost[i, p, t] = 0.0
                    continue
                times = np.diff(np.append(edge, own.sum()))
                probe = np.add.reduceat((small[own] < depth).astype(np.int64), edge)
                # A sampled record meets itself in each of its own probes; that says nothing about others.
                met = max(0.0, float((times * probe).sum() - probe.sum()))
                cost[i, p, t] = PROBE_COST * times.sum() / n * records + MEET_COST * met / (n * max(1, n - 1)) * records * records
    return cost


def allocate(cost: np.ndarray, budget: int) -> tuple[float, list[int]]:
    """The thresholds with the least total cost (partition, threshold) of which the sum of (t - 1) is the budget."""
    reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in reach.items():
            for t in range(1, len(row)):
                if used + t - 1 <= budget and c + row[t] < step.get(used + t - 1, (math.inf, []))[0]:
                    step[used + t - 1] = (c + row[t], [*chosen, t])
        reach = step
    return reach.get(budget, (math.inf, []))


def plan(counts: np.ndarray, sample: list[np.ndarray], records: int, threshold: float) -> Layout:
    """The layout with the least predicted cost: dynamic programming over partitions for every depth."""
    layout = Layout(counts, threshold)
    if not sample:
        return layout
    ordered = [layout.rare_first(b) for b in sample]
    _group_correlated(layout, ordered)
    for depth, cost in zip(DEPTHS, _predicted(layout, ordered, records)):
        total, chosen = allocate(cost, depth - 1)
        if total < layout.cost:
            layout.cost, layout.thresholds = total, np.array(chosen)
    layout.known = {}
    return layout


def _probe_rows(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, start = lists.flatten().to_numpy(zero_copy_only=False).view(_U), lists.offsets.to_numpy()
            base, hashes, smalls, sizes = int(start[0]) if len(start) else 0, [np.zeros(0, _U)], [np.zeros(0, bool)], []
            for i in range(len(batch)):
                n = 0
                for h, small in layout.probes(layout.rare_first(flat[start[i] - base : start[i + 1] - base])):
                    hashes.append(h)
                    smalls.append(small)
                    n += len(h)
                sizes.append(n)
            row = pa.array(np.repeat(np.arange(len(batch)), sizes))
            own = [batch.column(i).take(row) for i in (1, 2, *range(4, 4 + WORDS))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(smalls)), *own], ["probe", "small", "class", "size", *VECTOR])

    return run


def _allowed(a: Column, b: Column, threshold: float) -> Column:
    """The most bits in which two sets of these sizes may differ."""
    return F.floor((a + b) * ((1 - threshold) / (1 + threshold)) + 1e-6)


def classes(df: DataFrame, key: str, text: str, gram: int = 3) -> DataFrame:
    """(id, class, size, bits, vector): the set of each record; equal sets have one class."""
    own = df.where(F.col(text).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(text).alias("text"))
    return own.mapInArrow(_sets(gram), _SETS)


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """(class_a, class_b, likeness), class_a < class_b: all pairs of different classes that reach the threshold."""
    one = cut(sets.groupBy("class").agg(F.min_by(F.struct("id", "size", "bits", *VECTOR), "id").alias("x")).select("x.id", "class", "x.size", "x.bits", *[f"x.{v}" for v in VECTOR]))
    counted = one.select("bits").mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[counted.bucket.to_numpy(np.int64)] = counted.n.to_numpy(np.int64)
    records = one.count()
    # Few more than SAMPLE records pass the filter, however many partitions there are, so no more reach the driver, and
    # of each no more than SAMPLE_BITS bits, the least by their hash.
    drawn = F.pmod(F.xxhash64("class"), F.lit(1 << 30)) < int(min(1.0, 1.3 * SAMPLE / max(1, records)) * (1 << 30))
    sample = [np.array(r.bits, np.int64).view(_U) for r in one.where(drawn).select(F.slice("bits", 1, SAMPLE_BITS).alias("bits"), F.xxhash64("class").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    layout = plan(counts, sample, records, threshold)
    probes = one.mapInArrow(_probe_rows(layout), "probe long, small boolean, class long, size int, " + ", ".join(f"{v} long" for v in VECTOR))
    a = probes.where("small").select("probe", *[F.col(c).alias(f"{c}_a") for c in ("class", "size", *VECTOR)])
    b = probes.select("probe", *[F.col(c).alias(f"{c}_b") for c in ("class", "size", *VECTOR)])
    distance = sum((F.bit_count(F.col(f"{v}_a").bitwiseXOR(F.col(f"{v}_b"))) for v in VECTOR), F.lit(0))
    smaller = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("class_a") < F.col("class_b")))
    near = smaller & (F.col("size_b") * threshold <= F.col("size_a") + 1e-6) & (distance <= _allowed(F.col("size_a"), F.col("size_b"), threshold))
    met = a.join(b, (a["probe"] == b["probe"]) & near).select("class_a", "class_b", "size_a", "size_b").distinct()
    bits = lambda x: one.select(F.col("class").alias(f"class_{x}"), F.col("bits").alias(f"bits_{x}"))
    shared = met.join(bits("a"), "class_a").join(bits("b"), "class_b").select("class_a", "class_b", "size_a", "size_b", F.size(F.array_intersect("bits_a", "bits_b")).alias("shared"))
    likeness = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    low, high = F.least("class_a", "class_b"), F.greatest("class_a", "class_b")
    return shared.where(likeness >= threshold - 1e-9).select(low.alias("class_a"), high.alias("class_b"), likeness.alias("likeness"))


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.7, gram: int = 3) -> DataFrame:
    """(id_a, id_b, likeness), id_a < id_b: all pairs of records, copies included."""
    # Sets are made again for the second use, which costs less than to write them.
    pairs = similar_classes(classes(df, key, text, gram), threshold)
    sets = cut(classes(df, key, text, gram).select("id", "class"))
    own = lambda x: sets.select(F.col("class").alias(f"class_{x}"), F.col("id").alias(f"id_{x}"))
    several = sets.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class").alias("class_a"))
    copies = own("a").join(several, "class_a", "left_semi").join(own("b"), F.col("class_a") == F.col("class_b")).where("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("likeness"))
    across = pairs.join(own("a"), "class_a").join(own("b"), "class_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "likeness")
    return across.unionByName(copies)


def similar_groups(df: DataFrame, key: str, text: str, threshold: float = 0.7, gram: int = 3) -> DataFrame:
    """(key, class, group_id, links): one row for each record. group_id is the least class of all that a chain of
    similar pairs connects; links counts the classes that are similar to the record's own."""
    sets = cut(classes(df, key, text, gram).select("id", "class"))
    pairs = cut(similar_classes(classes(df, key, text, gram), threshold).select("class_a", "class_b"))
    both = pairs.unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    labels = components(pairs.select(F.col("class_a").alias("src"), F.col("class_b").alias("dst"))).select(F.col("node").alias("class"), F.col("component").alias("group_id"))
    links = both.groupBy(F.col("class_a").alias("class")).agg(F.count(F.lit(1)).alias("links"))
    rows = sets.join(labels, "class", "left").join(links, "class", "left")
    return rows.select(F.col("id").alias(key), "class", F.coalesce("group_id", "class").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
