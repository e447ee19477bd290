"""Running sums and places within groups of any size.

A window over a group puts the whole group into one task. Here the rows are partitioned by ranges of (group, order), so
a group that holds a large share of all rows is spread over many tasks; each part is summed on its own, and the sums of
the parts before it, one row for each group and part, are added.

Defined results: null groups are one group; rows with equal order get consecutive values in no certain order; a null
size counts nothing; an empty table stays empty; other columns are kept, and may have any names but those asked for.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.lineage import cut, partitions


def running_sum(df: DataFrame, group: str, order: list[str], size: str | None, name: str) -> DataFrame:
    """df with name, the sum of size (of 1 for None) over the rows of the group up to and with this one, in order."""
    by_range = df.repartitionByRange(partitions(df.sparkSession), group, *order).withColumn("__part", F.spark_partition_id())
    # Written once: what range a row is in must be the same for the rows and for the sums.
    parts = cut(by_range)
    amount = F.coalesce(F.col(size), F.lit(0)) if size else F.lit(1)
    sums = parts.groupBy("__part", group).agg(F.sum(amount).alias("__sum"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = parts.withColumn("__own", F.sum(amount).over(within))
    both = own.join(before, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return both.select(*df.columns, (F.col("__before") + F.col("__own")).alias(name))
