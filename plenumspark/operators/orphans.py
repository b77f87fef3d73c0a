"""References to records that do not exist: missing, deleted or late parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plenumspark.functions.wallclock import wall_micros

FOREVER = 2**62


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Child rows whose parent is not in force at their time, with the reason.

    children: (child_table, child_key, ref, at); parents: (key, recorded_at, deleted_at), in force from
    recorded_at until deleted_at. Returns (child_table, child_key, period, reason) with reason `missing`
    (no parent row at any time), `late` (all recorded after `at`) or `deleted`.

    Children and parents are co-partitioned by key and calendar year, sorted by time and merged in one
    linear pass: a running maximum of the parents' ends tells whether any is still in force. A key's
    earlier years reach a shard as one carry row, so a hot key is split over its years and no shard
    holds more than its own rows.

    A null `ref` is no reference. A child with null `at` can only be `missing` (period null). Parents
    with null key or recorded_at count for nothing. Repeated rows count once; empty tables are fine.
    """
    c = children.where("ref IS NOT NULL").distinct().select("child_table", "child_key", F.col("ref").alias("key"), wall_micros(F.col("at")).alias("t"), F.year("at").alias("shard"))
    p = (
        parents.where("key IS NOT NULL AND recorded_at IS NOT NULL")
        .select("key", wall_micros(F.col("recorded_at")).alias("t"), F.year("recorded_at").alias("shard"), F.coalesce(wall_micros(F.col("deleted_at")), F.lit(FOREVER)).alias("until"))
        .groupBy("key", "shard", "t").agg(F.max("until").alias("until"))
    )
    years = (
        p.groupBy("key", "shard").agg(F.max("until").alias("until"))
        .unionByName(c.select("key", "shard").distinct().withColumn("until", F.lit(None).cast("long")))
        .groupBy("key", "shard").agg(F.max("until").alias("until"))
    )
    earlier = W.partitionBy("key").orderBy(F.col("shard").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    carry = years.select(
        "key", "shard", F.max("until").over(earlier).alias("carried"),
        F.max(F.col("until").isNotNull()).over(W.partitionBy("key")).alias("exists"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    events = (
        carry.select("key", "shard", F.lit(-FOREVER).alias("t"), F.lit(0).alias("kind"), F.col("carried").alias("until"), "exists", none("string").alias("child_table"), none("long").alias("child_key"))
        .unionByName(p.select("key", "shard", "t", F.lit(1).alias("kind"), "until", none("boolean").alias("exists"), none("string").alias("child_table"), none("long").alias("child_key")))
        .unionByName(c.select("key", "shard", "t", F.lit(2).alias("kind"), none("long").alias("until"), none("boolean").alias("exists"), "child_table", "child_key"))
    )
    merge = W.partitionBy("key", "shard").orderBy(F.col("t").asc_nulls_last(), "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = events.withColumn("until_now", F.max("until").over(merge)).withColumn("any", F.max("exists").over(merge)).where("kind = 2")
    reason = (
        F.when(~F.col("any"), F.lit("missing"))
        .when(F.col("t").isNull(), F.lit(None))
        .when(F.col("until_now").isNull(), F.lit("late"))
        .when(F.col("until_now") <= F.col("t"), F.lit("deleted"))
    )
    return merged.withColumn("reason", reason).where("reason IS NOT NULL").select("child_table", "child_key", F.col("shard").cast("int").alias("period"), "reason")
