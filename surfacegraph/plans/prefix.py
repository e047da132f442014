"""Running sums over sorted rows, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import stored


def running_sum(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same keys that come before, in the order.

    Rows are sorted over all partitions. A partition adds up its own rows, and
    what a group has in earlier partitions is added from one row a partition
    and group. Rows that tie in keys and order count in some order.
    """
    columns = rows.columns
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # what the partitions hold must not change between the two readings
    dealt = stored(rows.withColumn("r_value", value).repartitionByRange(parts, *by).withColumn("r_part", F.spark_partition_id()))
    earlier = Window.partitionBy("r_part", *keys).orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("r_own", F.coalesce(F.sum("r_value").over(earlier), F.lit(0)))
    sums = dealt.groupBy("r_part", *keys).agg(F.sum("r_value").alias("r_sum"))
    over = Window.partitionBy(*keys).orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1)
    named = {k: f"r_{k}" for k in keys}
    base = sums.select(F.col("r_part").alias("b_part"), *[F.col(k).alias(named[k]) for k in keys], F.coalesce(F.sum("r_sum").over(over), F.lit(0)).alias("r_base"))
    on = F.col("r_part") == F.col("b_part")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(named[k]))
    return own.join(base, on).select(*columns, (F.col("r_own") + F.col("r_base")).alias(name))
