"""Running totals over a table's global order, without one task that sees all rows.

Rows are dealt by ranges of the order; each range is summed on its own and moved by the total of the ranges before it (one row for each range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.sources.shared import cut


def running(df: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over all rows that come earlier (rows equal in ``order`` in any order)."""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({**dict(zip(names, order, strict=True)), "_v": value})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept, because the ranges are sampled: dealt anew they could differ
    dealt = cut(cut(keyed).repartitionByRange(n, *names).withColumn("_p", F.spark_partition_id()))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offset = dealt.groupBy("_p").agg(F.sum("_v").alias("_t")).select("_p", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_p").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(F.broadcast(offset), "_p")
    return out.withColumn("before", F.col("_off") + F.col("_in")).drop("_p", "_v", "_in", "_off", *names)
