"""Mixing sources to target weights by Poisson replication.

Every document has a fixed number u in (0, 1) from a hash of its id and a seed. With mean repetition rate r its number
of uses is the inverse of the Poisson distribution with mean r at u, at most the cap of its source. So a document is
used more than k times exactly when r is above a threshold that follows from u and k alone. The thresholds of a source,
weighted with the tokens of the documents, tell for each r how many tokens the source gives; the rate of a source is
the one that comes closest to its share. It is found by two aggregates over histograms of the thresholds, a coarse one
and a fine one within the cell that matters, so no document passes through the driver and no source through one task.

The mixture has the largest size at which every source can give its share within its cap, unless a total is given; then
sources that are too small give all they may, and the report shows by how much they miss their share.

Defined results: documents without source, without target, with a weight or cap that isn't positive, or without tokens
are not used; targets without documents are reported with 0 tokens, and the others share their weight; rows that repeat
an id count once; a repeated target counts once, with its greatest weight; empty tables give an empty mixture; extra
columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.lineage import cut
from chainloom.llm.encoding import FOLDER, count_tokens

#: Cells of the coarse histogram for each doubling of the rate, and cells of the fine one within a coarse cell.
COARSE, FINE = 64, 4096


def _thresholds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each use that a document may have: the rate above which it has it."""
    for batch in batches:
        row = np.repeat(np.arange(len(batch)), batch["cap"])
        own = batch.iloc[row].reset_index(drop=True)
        k = np.concatenate([np.arange(c) for c in batch["cap"]]) if len(batch) else np.zeros(0, int)
        low, high = np.full(len(own), -40.0), np.full(len(own), 12.0)
        u, top = own["u"].to_numpy(float), int(k.max(initial=0))
        for _ in range(60):  # bisection for the logarithm of the rate at which P(N <= k) falls to u
            middle = (low + high) / 2
            rate = np.exp(middle)
            term = np.exp(-rate)
            below = term.copy()
            for i in range(1, top + 1):
                term = term * rate / i
                below += np.where(k >= i, term, 0.0)
            low, high = np.where(below > u, middle, low), np.where(below > u, high, middle)
        yield pd.DataFrame({"doc": own["doc"], "source": own["source"], "tokens": own["tokens"], "k": k, "at": (low + high) / 2})


def _closest(tries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of (source, cell, tokens), the last cell at whose start a source has given no more than it should.

    (source, wanted, cell, before): tokens given before the cell.
    """
    given = F.sum("tokens").over(Window.partitionBy("source").orderBy("cell"))
    run = tries.select("source", "cell", "tokens", given.alias("upto")).join(wanted, "source").withColumn("before", F.col("upto") - F.col("tokens"))
    at = run.where("before <= wanted").groupBy("source").agg(F.max_by(F.struct("cell", "before", "upto"), "cell").alias("x"), F.first("wanted").alias("wanted"))
    return at.select("source", "wanted", "x.cell", "x.before", "x.upto")


def sized(documents: DataFrame, key: str, source: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc, source, tokens) of the documents that have a source and tokens, each id once."""
    counted = count_tokens(documents.where(F.col(source).isNotNull() & F.col(text).isNotNull()), (key, source), text, tokenizer, folder)
    return counted.toDF("doc", "source", "tokens").groupBy("doc").agg(F.max_by("source", "tokens").alias("source"), F.max("tokens").alias("tokens")).where("tokens > 0")


def _targets(targets: DataFrame) -> DataFrame:
    return targets.groupBy("source").agg(F.max("target_weight").alias("weight"), F.max("max_repeats").cast("int").alias("cap"))


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """(doc, source, tokens, uses) of the chosen documents; documents are (doc, source, tokens), see sized()."""
    usable = _targets(targets).where("weight > 0 and cap > 0 and not isnan(weight)")
    stock = documents.groupBy("source").agg(F.sum("tokens").alias("stock")).join(usable, "source")
    whole = stock.agg(F.sum("weight").alias("weights"), F.min(F.col("stock") * F.col("cap") / F.col("weight")).alias("least"))
    size = F.lit(float(total)) if total is not None else F.col("least") * F.col("weights")
    wanted = cut(stock.crossJoin(F.broadcast(whole)).select("source", "cap", (size * F.col("weight") / F.col("weights")).alias("wanted")))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc")), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    drawn = documents.join(wanted.select("source", "cap"), "source").select("doc", "source", "tokens", u.alias("u"), "cap")
    uses = cut(drawn.mapInPandas(_thresholds, "doc long, source string, tokens long, k int, at double"))
    coarse = F.floor(F.col("at") * COARSE / np.log(2)).cast("long")
    target = wanted.select("source", "wanted")
    first = _closest(uses.groupBy("source", coarse.alias("cell")).agg(F.sum("tokens").alias("tokens")), target)
    fine = F.floor((F.col("at") * COARSE / np.log(2) - F.col("coarse")) * FINE).cast("long")
    inside = uses.join(first.select("source", F.col("cell").alias("coarse"), F.col("before").alias("base"), "wanted"), "source").where(coarse == F.col("coarse"))
    cells = inside.groupBy("source", fine.alias("cell")).agg(F.sum("tokens").alias("tokens"), F.first("base").alias("base"), F.first("wanted").alias("wanted"))
    rest = cells.groupBy("source").agg((F.first("wanted") - F.first("base")).alias("wanted"))
    second = _closest(cells.select("source", "cell", "tokens"), rest)
    # The cell where the share is passed is taken in whole when that comes closer.
    edge = second.select("source", F.when(F.col("upto") - F.col("wanted") < F.col("wanted") - F.col("before"), F.col("cell") + 1).otherwise(F.col("cell")).alias("fine_edge"))
    limit = first.select("source", F.col("cell").alias("coarse_edge")).join(edge, "source")
    chosen = uses.join(limit, "source").where((coarse < F.col("coarse_edge")) | ((coarse == F.col("coarse_edge")) & (F.floor((F.col("at") * COARSE / np.log(2) - F.col("coarse_edge")) * FINE) < F.col("fine_edge"))))
    return chosen.groupBy("doc").agg(F.first("source").alias("source"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).cast("int").alias("uses"))


def shares(chosen: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The report: one row for each target with its share as wanted (of all targets that have documents) and as it is."""
    given = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    stock = documents.groupBy("source").agg(F.sum("tokens").alias("stock_tokens"))
    rows = _targets(targets).join(stock, "source", "left").join(given, "source", "left")
    sums = rows.agg(F.sum("tokens").alias("all_tokens"), F.sum(F.when(F.col("stock_tokens").isNotNull() & (F.col("cap") > 0), F.col("weight"))).alias("weights"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    target = F.when(F.col("stock_tokens").isNotNull() & (F.col("cap") > 0), F.try_divide("weight", "weights")).otherwise(0.0)
    return rows.crossJoin(F.broadcast(sums)).select("source", F.col("weight").alias("target_weight"), target.alias("target_share"), F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"), zero("stock_tokens"), zero("documents"), zero("most_uses"), zero("tokens"), F.col("cap").alias("max_repeats"))


def shuffled(chosen: DataFrame, seed: int = 17) -> DataFrame:
    """(place, doc, copy_no): every use of every document in a global order by hash; place is the sort key."""
    copies = chosen.select("doc", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy_no"))
    return copies.select(F.xxhash64(F.lit(seed + 1), "doc", "copy_no").alias("place"), "doc", "copy_no").orderBy("place", "doc", "copy_no")
