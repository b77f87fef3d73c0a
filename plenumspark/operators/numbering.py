"""Numbers in order without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plenumspark.session import checkpointed


def number_rows(df: DataFrame, order: Sequence[str], out: str, first: int = 0) -> DataFrame:
    """`df` with `out`, numbers from `first` on in the order given, which must be total.

    Rows are range-partitioned by the order and kept by a checkpoint; each partition numbers its own and
    adds the sizes of those before it, which are one row a partition.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = ranged.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    return local.join(before, "__p").withColumn(out, F.col("__before") + F.col("__i") + (first - 1)).drop("__p", "__i", "__before")
