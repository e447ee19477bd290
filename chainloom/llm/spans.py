"""Long exact spans that several records share, found by compact windows.

Tokens are the GRAM-character substrings of a text, one at each character. Every run of SPAN characters then is a
window of as many tokens, and the token with the smallest hash in it (the leftmost of equals) is its signature. The
windows of a text are grouped without listing them: a node of the Cartesian tree over the token hashes that is at least
a window wide stands for all windows that have the node's token as their signature, which follow each other; this is a
compact window. The nodes are read off from the sliding minima of the hashes, so a text takes time in proportion to its
length whatever it holds, and nodes of equal tokens whose windows follow each other (as in a run of one character) are
one row. A text of n characters has about 2n / window of them. Since equal windows have equal signatures, one hash
function is enough for exact spans: two texts that share a run have compact windows with one signature around it.

Signatures that only one record has are dropped by a semi-join. Of the rest, compact windows with the same signature
and the same characters are shared as a whole, which one aggregate settles. The others agree in part only: their
windows are compared by signature, without pairs, by the hashes of all windows that a compact window stands for;
where one signature has more than LARGE different compact windows, those hashes go through an aggregate of their own.
Shared windows are joined to maximal stretches per record.

Hashes have 64 bits, and window hashes are compared within one signature only, so two different windows pass as equal
with a chance of about 2**-64 for each pair of them that also shares a signature.

Defined results: null, empty and shorter texts give no stretch and count as not shared; a run that occurs twice in one
record only isn't shared; rows that repeat an id count as one record; texts that
repeat under different ids are shared whole; an empty table gives an empty table; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.lineage import cut, partitions

#: Least length of a shared run, and length of a token, both in characters.
SPAN, GRAM = 200, 100
#: Different compact windows of one signature that are compared inside one task; more go through an aggregate.
LARGE = 20_000
#: Rows whose windows are hashed together.
BLOCK = 4_000
_ODD, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse, as many as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 16)
            powers = lambda base: np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size, base, np.uint64))))
            self.up, self.down = powers(_ODD), powers(_BACK)
        return self.up, self.down


def _prefixes(codes: np.ndarray, powers: _Powers) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows."""
    up, _ = powers.upto(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(_ODD)) * up[: len(codes)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hash of each substring [start, end), the same wherever it stands."""
    _, down = powers.upto(len(sums))
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def compact_windows(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, least): runs of windows, by their first tokens, that have one least token, with its hash."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Minima of blocks from their starts and to their ends; a window is the end of one block and the start of the next.
    blocks = np.full(-(-len(hashes) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(hashes)] = hashes
    blocks = blocks.reshape(-1, width)
    ahead, behind = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    edge = np.flatnonzero(least[1:] != least[:-1])
    return np.concatenate(([0], edge + 1)), np.append(edge, n - 1), least[np.append(edge, n - 1)]


def _signatures(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, width = _Powers(), span - gram + 1
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int32, np.int32)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text) < span:
                    continue
                sums = _prefixes(_codes(text), powers)
                at = np.arange(len(text) - gram + 1)
                hashes = _hashes(sums, at, at + gram, powers)
                first, last, least = compact_windows(hashes, width)
                whole = _hashes(sums, first, last + span, powers)
                for column, values in zip(out, (least, whole, np.full(len(first), doc), first, last)):
                    column.append(values)
            columns = [np.concatenate(x) for x in out]
            types = (np.int64, np.int64, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t, copy=False) if c.dtype != np.uint64 else c.view(np.int64)) for c, t in zip(columns, types)], ["sig", "whole", "doc", "first", "last"])

    return run


def _window_hashes(texts: list[str], first: np.ndarray, last: np.ndarray, span: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window start, hash) of all windows of each compact window, whose characters are given."""
    codes = np.concatenate([_codes(t) for t in texts])
    size = np.array([len(t) for t in texts], dtype=np.int64)
    sums, base = _prefixes(codes, powers), np.cumsum(size) - size
    count = last - first + 1
    row = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = base[row] + offset
    return row, first[row] + offset, _hashes(sums, start, start + span, powers)


def _slices(span: int):
    """Adds to each compact window the characters that it stands for; input is a record with its compact windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, windows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += [(w["sig"], doc, w["first"], w["last"], text[w["first"] : w["last"] + span]) for w in windows]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["sig", "doc", "first", "last", "chars"])

    return run


def _shared_in(block: pd.DataFrame, span: int, powers: _Powers) -> pd.DataFrame:
    """Stretches of windows that another record has under the same signature; block holds whole signatures."""
    row, start, hashed = _window_hashes(block.chars.tolist(), block["first"].to_numpy(np.int64), block["last"].to_numpy(np.int64), span, powers)
    doc, key = block.doc.to_numpy(np.int64)[row], hashed + _mix(block.sig.to_numpy(np.int64).view(np.uint64))[row]
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(key[order].view(np.int64)) != 0)))
    low, high = np.minimum.reduceat(doc[order], edge), np.maximum.reduceat(doc[order], edge)
    hit = np.zeros(len(order), bool)
    hit[order] = np.repeat(low < high, np.diff(np.append(edge, len(order))))
    row, start = row[hit], start[hit]
    if not len(row):
        return pd.DataFrame({"doc": [], "span_start": [], "span_end": []}).astype("int64")
    cuts = np.flatnonzero((np.diff(row) != 0) | (np.diff(start) != 1))
    begin, end = np.concatenate(([0], cuts + 1)), np.append(cuts, len(row) - 1)
    return pd.DataFrame({"doc": block.doc.to_numpy(np.int64)[row[begin]], "span_start": start[begin], "span_end": start[end] + span})


def _compare(span: int):
    """Rows come sorted by signature; whole signatures are taken together in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, held = _Powers(), None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) >= BLOCK and held.sig.iloc[0] != held.sig.iloc[-1]:
                whole = held.sig != held.sig.iloc[-1]
                yield _shared_in(held[whole], span, powers)
                held = held[~whole].reset_index(drop=True)
        if held is not None and len(held):
            yield _shared_in(held, span, powers)

    return run


def _explode_windows(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for batch in batches:
            if len(batch):
                row, start, hashed = _window_hashes(batch.chars.tolist(), batch["first"].to_numpy(np.int64), batch["last"].to_numpy(np.int64), span, powers)
                yield pd.DataFrame({"sig": batch.sig.to_numpy()[row], "hashed": hashed.view(np.int64), "doc": batch.doc.to_numpy()[row], "start": start})

    return run


def signatures(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(sig, whole, doc, first, last): the compact windows of all texts (doc, text); first and last are the
    starts of the first and last run that each stands for, whole hashes the characters of all its runs."""
    return texts.mapInArrow(_signatures(span, gram), "sig long, whole long, doc long, first int, last int")


def shared_spans(df: DataFrame, key: str, text: str, span: int = SPAN, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """(key, span_start, span_end): the maximal stretches of each record that other records have, in runs of at least
    span characters."""
    n = partitions(df.sparkSession)
    long = F.col(text).isNotNull() & (F.char_length(F.col(text)) >= span)
    texts = df.where(long).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    windows = signatures(texts, span, gram)
    several = windows.groupBy("sig").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("sig")
    common = cut(windows.join(several, "sig", "left_semi"))
    classes = common.groupBy("sig", "whole").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    marked = common.join(classes, ["sig", "whole"])
    equal = marked.where("low < high").select("doc", F.col("first").cast("long").alias("span_start"), (F.col("last") + span).cast("long").alias("span_end"))
    # What is left of a signature that all its records have alike needs no further look.
    unlike = classes.groupBy("sig").agg(F.count(F.lit(1)).alias("unlike")).where("unlike > 1")
    partial = marked.where("low = high or doc = low or doc = high").dropDuplicates(["sig", "whole", "doc", "first"]).join(unlike, "sig")
    per_record = partial.groupBy("doc").agg(F.collect_list(F.struct("sig", "first", "last")).alias("windows"), F.max("unlike").alias("unlike"))
    pieces = cut(texts.join(per_record.select("doc", "windows"), "doc").select("doc", "text", "windows").mapInArrow(_slices(span), "sig long, doc long, first int, last int, chars string"))
    sized = pieces.join(unlike.where(F.col("unlike") > large).select("sig", F.lit(True).alias("many")), "sig", "left")
    few = sized.where("many is null").drop("many").repartition(n, "sig").sortWithinPartitions("sig")
    inside = few.mapInPandas(_compare(span), "doc long, span_start long, span_end long")
    runs = sized.where("many").drop("many").mapInPandas(_explode_windows(span), "sig long, hashed long, doc long, start long")
    known = runs.groupBy("sig", "hashed").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    across = runs.join(known.select("sig", "hashed"), ["sig", "hashed"], "left_semi").select("doc", F.col("start").alias("span_start"), (F.col("start") + span).alias("span_end"))
    return merge_intervals(equal.unionByName(inside).unionByName(across)).withColumnRenamed("doc", key)


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """(doc, span_start, span_end): overlapping and touching intervals of each record joined."""
    earlier = Window.partitionBy("doc").orderBy("span_start", "span_end")
    new = F.coalesce(F.col("span_start") > F.max("span_end").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = intervals.distinct().select("*", new.cast("int").alias("new")).select("*", F.sum("new").over(earlier.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    return numbered.groupBy("doc", "stretch").agg(F.min("span_start").cast("int").alias("span_start"), F.max("span_end").cast("int").alias("span_end")).drop("stretch")


def shared_share(df: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """(key, chars, shared_chars, share): how much of each record stands in others too; null texts have no characters."""
    shared = spans.groupBy(F.col(key).cast("long").alias("doc")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = df.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long").alias("chars"))
    share = F.coalesce(F.try_divide(F.col("shared_chars"), F.col("chars")), F.lit(0.0))
    return sizes.join(shared, "doc", "left").select(F.col("doc").alias(key), "chars", F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"), share.alias("share"))
