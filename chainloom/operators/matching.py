"""Joins of findings, labels, scopes and paths: bands, intervals, suffixes, priority de-duplication, checkpoints.

None of them compares all rows with all: bands and intervals become equal buckets, suffixes become equal keys.

Defined results: null keys match nothing; repeated rows match again; of equal candidates the least key wins; empty
tables give what their join kind says.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.operators.ordering import running_sum


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the given order: aggregates a struct, so hot keys are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("x")).select(*keys, *[F.col("x")[c].alias(c) for c in rest])


def band_join(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str, width: float, buckets: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with equal keys whose left and right values are at most width apart.

    Values fall into buckets of that width; a row of b is looked up in its own bucket and both neighbours, so the join
    is on equal (keys, bucket) and no key is compared as a whole.
    """
    bucket = lambda c: F.floor(F.col(c).cast("double") / width)
    x = a.withColumn("__bucket", bucket(left))
    y = b.withColumn("__bucket", F.explode(F.array(*[bucket(right) + i for i in (-1, 0, 1)])))
    return x.join(y, [*keys, "__bucket"]).where(F.abs(F.col(left).cast("double") - F.col(right).cast("double")) <= width).drop("__bucket")


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path that start at a segment, longest first, in lower case."""
    parts = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/+")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def longest_suffix(paths: DataFrame, path: str, known: DataFrame, name: str) -> DataFrame:
    """Each distinct path with the longest known name that it ends with at a segment: an equi-join on its suffixes."""
    own = paths.select(path).where(F.col(path).isNotNull()).distinct().select(path, F.explode(path_suffixes(F.col(path))).alias("__suffix"))
    names = known.select(F.col(name), F.lower(F.regexp_replace(F.col(name), r"\\", "/")).alias("__suffix")).where(F.col(name).isNotNull()).distinct()
    return own.join(names, "__suffix").groupBy(path).agg(F.min_by(name, F.struct(-F.length("__suffix"), F.col(name))).alias(name))


def overlay(base: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """base with the rows of update in place of those with the same key, and update's other rows added."""
    rest = [c for c in base.columns if c != key]
    x = base.select(key, F.struct(*rest).alias("old"))
    y = update.select(key, F.struct(*rest).alias("new"))
    return x.join(y, key, "full_outer").select(key, F.coalesce("new", "old").alias("x")).select(key, "x.*")


def running_cut(df: DataFrame, group: str, order: list[str], size: str, budget: float) -> DataFrame:
    """Rows of each group in order, as long as the running size stays within the budget."""
    return running_sum(df, group, order, size, "running").where(F.col("running") <= budget)


def replace_groups(base: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """base without the rows whose key update has, and update: what is done again for a file takes the place of all its
    rows. Rows of a null key stay and are added."""
    return base.join(update.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*base.columns).unionByName(update.select(*base.columns))


def two_tier_suffix(wanted: DataFrame, path: str, known: DataFrame, name: str) -> DataFrame:
    """(path, name, tier): each distinct path with the known names that end with the whole of it (1) or, where none does,
    with it without its first segment (2)."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\\/]+", "/"))
    own = wanted.select(path).where(F.col(path).isNotNull()).distinct()
    rest = F.regexp_replace(plain(F.col(path)), "^[^/]*/", "")
    both = F.array(F.struct(F.lit(1).alias("tier"), plain(F.col(path)).alias("suffix")), F.struct(F.lit(2).alias("tier"), F.when(plain(F.col(path)).contains("/"), rest).alias("suffix")))
    keys = own.select(path, F.explode(both).alias("k")).select(path, "k.*").where("suffix <> ''")
    ends = known.select(name).where(F.col(name).isNotNull()).distinct().select(name, F.explode(path_suffixes(F.col(name))).alias("suffix")).distinct()
    met = keys.join(ends, "suffix")
    best = met.groupBy(path).agg(F.min("tier").alias("tier"))
    return met.join(best, [path, "tier"]).select(path, name, "tier")
