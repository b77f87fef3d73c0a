"""Runs of equal keys in order, split over chunks so that no sequence needs one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Places of a sequence in one chunk.
CHUNK = 4096


def previous_of(df: DataFrame, group: str, place: str, tie: str, columns: list[str], chunk: int = CHUNK, following: bool = False) -> DataFrame:
    """`df` with __prev, a struct of the columns of the row before in order of (place, tie) within `group`; null for the first.

    With `following` also __next, of the row after. Within chunks by a window; a chunk's first row gets the
    last row of the chunk before (its last the first of the chunk after), one row a chunk.
    """
    df = df.withColumn("__c", F.floor(F.col(place) / F.lit(chunk)))
    w, at, row = W.partitionBy(group, "__c").orderBy(place, tie), F.struct(place, tie), F.struct(*columns)
    inner = df.withColumn("__lag", F.lag(row).over(w))
    if following:
        inner = inner.withColumn("__lead", F.lead(row).over(w))
    ends = inner.groupBy(group, "__c").agg(F.max_by(row, at).alias("__last"), F.min_by(row, at).alias("__first"))
    order = W.partitionBy(group).orderBy("__c")
    ends = ends.select(F.col(group).alias("__g"), F.col("__c").alias("__c2"), F.lag("__last").over(order).alias("__before"), F.lead("__first").over(order).alias("__after"))
    j = inner.join(ends, inner[group].eqNullSafe(ends["__g"]) & inner["__c"].eqNullSafe(ends["__c2"]))
    j = j.withColumn("__prev", F.coalesce("__lag", "__before"))
    if following:
        j = j.withColumn("__next", F.coalesce("__lead", "__after"))
    return j.drop("__c", "__c2", "__g", "__lag", "__lead", "__before", "__after")


def place_in(df: DataFrame, group: str, place: str, tie: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """`df` with `out`, each row's number from 1 in order of (place, tie) within `group`; by chunks."""
    return running_count(df.withColumn("__one", F.lit(True)), group, place, tie, "__one", out, chunk).drop("__one")


def running_count(df: DataFrame, group: str, place: str, tie: str, flag: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """`df` with `out`, how many rows up to each have `flag` (boolean) set, in order of (place, tie) within `group`; by chunks."""
    df = df.withColumn("__c", F.floor(F.col(place) / F.lit(chunk))).withColumn("__f", F.coalesce(F.col(flag), F.lit(False)).cast("long"))
    w = W.partitionBy(group, "__c").orderBy(place, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = df.withColumn("__in", F.sum("__f").over(w))
    n = inner.groupBy(group, "__c").agg(F.sum("__f").alias("__n"))
    order = W.partitionBy(group).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    n = n.select(F.col(group).alias("__g"), F.col("__c").alias("__c2"), F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__base"))
    j = inner.join(n, inner[group].eqNullSafe(n["__g"]) & inner["__c"].eqNullSafe(n["__c2"]))
    return j.withColumn(out, F.col("__base") + F.col("__in")).drop("__c", "__c2", "__g", "__f", "__in", "__base")


def number_runs(df: DataFrame, group: str, place: str, tie: str, key: str, out: str = "run_no", chunk: int = CHUNK) -> DataFrame:
    """`df` with `out`: the number, from 1, of the run of equal `key` each row is in, in order of (place, tie) within `group`.

    Runs are found within chunks of `chunk` places; one summary row a chunk then tells whether the
    chunk's first run goes on from the one before, so a group of any length is spread over tasks.
    Keys are compared null-safely. `place` must be an integer.
    """
    df = df.withColumn("__c", F.floor(F.col(place) / F.lit(chunk)))
    w = W.partitionBy(group, "__c").orderBy(place, tie)
    inner = df.withColumn("__first", F.row_number().over(w) == 1).withColumn("__new", (~F.col("__first") & ~F.lag(key).over(w).eqNullSafe(F.col(key))).cast("long"))
    inner = inner.withColumn("__in", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    at = F.struct(place, tie)
    # The summaries come from the rows as partitioned for the windows, so they cost no shuffle of their own.
    chunks = inner.groupBy(group, "__c").agg(F.min_by(F.struct(F.col(key).alias("k")), at).alias("a"), F.max_by(F.struct(F.col(key).alias("k")), at).alias("b"), F.sum("__new").alias("__n"))
    order = W.partitionBy(group).orderBy("__c")
    s = chunks.withColumn("__prev", F.lag("b").over(order))
    s = s.withColumn("__start", F.when(F.col("__prev").isNotNull() & F.col("__prev.k").eqNullSafe(F.col("a.k")), 0).otherwise(1))
    s = s.withColumn("__base", F.sum(F.col("__start") + F.col("__n")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n"))
    s = s.select(F.col(group).alias("__g"), F.col("__c").alias("__c2"), "__base")
    joined = inner.join(s, (inner[group].eqNullSafe(s["__g"])) & (inner["__c"].eqNullSafe(s["__c2"])))
    return joined.withColumn(out, F.col("__base") + F.col("__in")).drop("__c", "__c2", "__g", "__first", "__new", "__in", "__base")
