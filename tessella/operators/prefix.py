"""Running sums and positions over groups of any size.

A window over a group sorts the group in one task. Here rows are
range-partitioned by group and order, so a group with a third of all rows
spreads over many tasks; each task sums its own part, and the sums of the
parts before it are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.joins import lookup_join
from tessella.scratch import Scratch


def running(df: DataFrame, group: list[str], order: list[str], values: dict[str, F.Column]) -> DataFrame:
    """Adds for each name the sum of its column over the rows of the group up to and including the row.

    Rows are ordered by ``order`` (ascending, nulls first), which must tell
    rows of a group apart for the result to be the same on every run. Null
    values count as 0. Null groups are a group of their own.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = df.withColumns({f"__v_{n}": F.coalesce(c, F.lit(0)) for n, c in values.items()} | {f"__g{i}": F.coalesce(F.col(g).cast("string"), F.lit("\0")) for i, g in enumerate(group)})
    keys = [f"__g{i}" for i in range(len(group))]
    laid = scratch.cut(named.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()), "laid")
    sums = laid.groupBy(*keys, "__part").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.cut(sums.select(*keys, "__part", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values]), "base")
    inner = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumns({f"__l_{n}": F.sum(f"__v_{n}").over(inner) for n in values})
    out = lookup_join(local, base, [*keys, "__part"], "inner")
    return out.select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__b_{n}")).alias(n) for n in values])
