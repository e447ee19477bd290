"""Differences between two copies of one data set, field by field.

compare_copies takes, on each side, the latest version of every key, joins both sides with a null-safe full outer
join and reports rows that one side lacks and fields whose normalised values differ.

Defined results: a key that is null on both sides is one key; a version with a null time is older than any other; of
versions with the same time the largest by values counts, so repeated rows change nothing; a null deletion flag means
not deleted; a row that is missing on both sides gives nothing; empty tables give every row of the other side as
missing; columns that are not named in the arguments are ignored, whatever they are called.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]


def as_text(c: Column) -> Column:
    """Text without outer white space; empty is null."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def as_path(c: Column) -> Column:
    """A path with / as separator and without a leading ./ ; case counts."""
    return F.nullif(F.regexp_replace(F.regexp_replace(as_text(c), r"\\", "/"), r"^(\./+)+", ""), F.lit(""))


def as_count(c: Column) -> Column:
    """A count in whatever spelling of the number; text that is no number stays text."""
    text = as_text(c)
    number = text.try_cast("decimal(38,9)")
    return F.coalesce(number.cast("string"), text)


def as_ratio(digits: int) -> Rule:
    """A number rounded half up to so many decimals; text that is no number stays text."""

    def rule(c: Column) -> Column:
        text = as_text(c)
        return F.coalesce(F.round(text.try_cast("decimal(38,18)"), digits).cast("string"), text)

    return rule


def latest(df: DataFrame, key: str, fields: dict[str, Rule], version: str, deleted: str) -> DataFrame:
    """The newest version of each key with normalised fields; withdrawn keys are left out.

    One aggregate with map-side combining, so a key with very many versions is no hot spot.
    """
    kept = F.struct(F.col(version), F.coalesce(F.col(deleted), F.lit(False)).alias("gone"), *[rule(F.col(f)).alias(f"f{i}") for i, (f, rule) in enumerate(fields.items())])
    newest = df.select(F.col(key).alias("key"), kept.alias("v")).groupBy("key").agg(F.max("v").alias("v"))
    return newest.where(~F.col("v.gone")).select("key", *[F.col(f"v.f{i}").alias(f"f{i}") for i in range(len(fields))])


def compare_copies(left: DataFrame, right: DataFrame, key: str, fields: dict[str, Rule], version: str, deleted: str) -> DataFrame:
    """(key, field, left_value, right_value), one row for each difference.

    field is missing_in_a or missing_in_b (values null) when one side lacks the key.
    """
    a = latest(left, key, fields, version, deleted).withColumn("here", F.lit(True)).alias("a")
    b = latest(right, key, fields, version, deleted).withColumn("here", F.lit(True)).alias("b")
    both = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")), "full_outer")
    differences = F.array(*[
        F.when(~F.col(f"a.f{i}").eqNullSafe(F.col(f"b.f{i}")), F.struct(F.lit(f).alias("field"), F.col(f"a.f{i}").alias("left_value"), F.col(f"b.f{i}").alias("right_value")))
        for i, f in enumerate(fields)
    ])
    missing = lambda name: F.array(F.struct(F.lit(name).alias("field"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    found = (
        F.when(F.col("a.here").isNull(), missing("missing_in_a"))
        .when(F.col("b.here").isNull(), missing("missing_in_b"))
        .otherwise(F.filter(differences, lambda x: x.isNotNull()))
    )
    return both.select(F.coalesce("a.key", "b.key").alias(key), F.explode(found).alias("d")).select(key, "d.*")
