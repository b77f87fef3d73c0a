"""Attributes as known at event time, and the point-in-time lookups of speakers' parties and offices."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plenumspark.functions.wallclock import wall_micros

DAY_US = 86_400_000_000
#: Width of a time bucket. Narrower buckets split hot entities further, wider ones repeat long rows less.
BUCKET_DAYS = 1461


def _sweep(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """One pass over rows sorted by (entity, bucket, lo): the best active row between successive change times.

    State is the rows of one entity and bucket that are still active; expired rows leave the heap.
    Neighbouring intervals of one winner are joined.
    """
    group = None
    heap: list[tuple] = []
    now = 0
    open_ = None
    out: list[tuple] = []

    def close() -> None:
        nonlocal open_
        if open_ is not None:
            out.append((group[0], group[1], *open_))
            open_ = None

    def advance(to: int | None) -> None:
        nonlocal now, open_
        while True:
            while heap and heap[0][-1][0] <= now:
                heapq.heappop(heap)
            if not heap or (to is not None and now >= to):
                break
            best = heap[0]
            end = best[-1][0] if to is None else min(best[-1][0], to)
            if open_ is not None and open_[2] == best[-1][1] and open_[1] == now:
                open_ = (open_[0], end, open_[2])
            else:
                close()
                open_ = (now, end, best[-1][1])
            now = end
        if to is not None:
            now = to

    schema = ["entity", "bucket", "valid_from", "valid_to", "row_key"]
    for pdf in batches:
        order = [pdf[f"o{i}"].tolist() for i in range(width)]
        for entity, bucket, lo, hi, key, *rank in zip(pdf["entity"].tolist(), pdf["bucket"].tolist(), pdf["lo"].tolist(), pdf["hi"].tolist(), pdf["row_key"].tolist(), *order):
            if (entity, bucket) != group:
                advance(None)
                close()
                group, heap, now = (entity, bucket), [], lo
            advance(lo)
            heapq.heappush(heap, (*(-r for r in rank), (hi, key)))
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=schema)
            out = []
    advance(None)
    close()
    yield pd.DataFrame(out, columns=schema)


def validity_intervals(rows: DataFrame, first: int, last: int, width: int = 3, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """Disjoint validity intervals (entity, bucket, valid_from, valid_to, row_key), half open, in microseconds.

    `rows` has entity, lo, hi, row_key and the ranks o0..o{width-1} (long, larger wins). Rows are
    exploded into the time buckets they touch within [first, last] before anything is grouped, so that
    an entity with many rows is spread over its buckets; each (entity, bucket) is sorted by change time
    and swept once.
    """
    size = bucket_days * DAY_US
    lo, hi = F.greatest("lo", F.lit(first)), F.least("hi", F.lit(last + 1))
    bucket = lambda c: F.floor(c / F.lit(size))
    split = (
        rows.withColumn("lo", lo).withColumn("hi", hi).where(F.col("lo") < F.col("hi"))
        .withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi") - 1))))
        .withColumn("lo", F.greatest("lo", F.col("bucket") * size))
        .withColumn("hi", F.least("hi", (F.col("bucket") + 1) * size))
        .select("entity", "bucket", "lo", "hi", "row_key", *[f"o{i}" for i in range(width)])
        .distinct()
    )
    schema = T.StructType([T.StructField("entity", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("valid_from", T.LongType()), T.StructField("valid_to", T.LongType()), T.StructField("row_key", T.LongType())])
    return split.repartition("entity", "bucket").sortWithinPartitions("entity", "bucket", "lo").mapInPandas(lambda it: _sweep(it, width), schema)


def known_at(
    events: DataFrame, attributes: DataFrame, *, event_entity: str, event_time: str, entity: str, start: str, end: str, known: str, row_key: str, bucket_days: int = BUCKET_DAYS,
) -> DataFrame:
    """Each distinct (event_entity, event_time) with the attribute row in force and already known at that time.

    In force: start <= t and (end null or end >= t, `end` a date counted to its last instant);
    known: known <= t. Of several rows the latest start wins, then the latest `known`, then the largest
    `row_key` (long). Returns (entity, event_micros, row_key), one row per event that has such a row; event_micros is
    `wall_micros` of the event time.

    Events or attributes with a null entity, time, start, `known` or key match nothing. Repeated rows
    count once. Empty inputs give an empty result. Extra columns are ignored.
    """
    events = events.select(F.col(event_entity).alias("entity"), wall_micros(F.col(event_time)).alias("t")).where("entity IS NOT NULL AND t IS NOT NULL").distinct()
    size = bucket_days * DAY_US
    bounds = events.agg(F.min("t"), F.max("t")).first()
    first, last = (0, -1) if bounds[0] is None else bounds
    rows = attributes.select(
        F.col(entity).alias("entity"),
        wall_micros(F.col(start)).alias("o0"),
        wall_micros(F.col(known)).alias("o1"),
        F.col(row_key).cast("long").alias("o2"),
        F.when(F.col(end).isNotNull(), wall_micros(F.date_add(F.col(end).cast("date"), 1))).otherwise(F.lit(2**62)).alias("hi"),
    ).where("entity IS NOT NULL AND o0 IS NOT NULL AND o1 IS NOT NULL AND o2 IS NOT NULL")
    rows = rows.withColumn("lo", F.greatest("o0", "o1")).withColumn("row_key", F.col("o2"))
    spans = validity_intervals(rows, first, last, 3, bucket_days)
    e = events.withColumn("bucket", F.floor(F.col("t") / F.lit(size)))
    return e.join(spans, ["entity", "bucket"]).where("valid_from <= t AND t < valid_to").select("entity", F.col("t").alias("event_micros"), "row_key")


# ------------------------------------------------------------------ speakers' parties and offices by year


def party_at(events: DataFrame, party: DataFrame, *, fixed: DataFrame | None = None) -> DataFrame:
    """Distinct (person_id, year) with the party in force that year.

    A person's fixed party (`fixed`: person_id, party_id, 0 for none) wins; else the first row, in
    `rn` order and closed spans before open ones, of `party` (person_id, party_id, start_year,
    end_year, rn) whose years hold the event's year, both included; else 0. Spans are exploded to
    years, so the join is an equi-join with no range residual.
    """
    keys = events.select("person_id", "year").where("person_id IS NOT NULL AND year IS NOT NULL").distinct()
    bounds = keys.agg(F.min("year"), F.max("year")).first()
    first, last = (0, -1) if bounds[0] is None else bounds
    spans = (
        party.withColumn("is_open", (F.col("start_year").isNull() | F.col("end_year").isNull()).cast("int"))
        .withColumn("a", F.greatest(F.coalesce("start_year", F.lit(0)), F.lit(first)))
        .withColumn("b", F.least(F.coalesce("end_year", F.lit(9999)), F.lit(last)))
        .where("a <= b AND person_id IS NOT NULL")
        .select("person_id", F.explode(F.sequence("a", "b")).alias("year"), F.struct("is_open", "rn", "party_id").alias("best"))
        .groupBy("person_id", "year").agg(F.min("best").alias("best"))
    )
    out = keys.join(spans, ["person_id", "year"], "left").withColumn("party_id", F.col("best.party_id"))
    if fixed is not None:
        f = fixed.groupBy("person_id").agg(F.min(F.when(F.col("party_id") > 0, F.col("party_id"))).alias("fixed_party"))
        out = out.join(f, "person_id", "left").withColumn("party_id", F.coalesce("fixed_party", "party_id"))
    return out.select("person_id", "year", F.coalesce("party_id", F.lit(0)).cast("int").alias("party_id"))


def office_at(events: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct (person_id, year) with the office in force: the first covering term in `rn` order, else the person's last term, else 0.

    `terms`: person_id, office_type_id, start_year, end_year, rn. Null years are open ends.
    """
    keys = events.select("person_id", "year").where("person_id IS NOT NULL AND year IS NOT NULL").distinct()
    bounds = keys.agg(F.min("year"), F.max("year")).first()
    first, last = (0, -1) if bounds[0] is None else bounds
    known = terms.where("person_id IS NOT NULL")
    covering = (
        known.withColumn("a", F.greatest(F.coalesce("start_year", F.lit(0)), F.lit(first)))
        .withColumn("b", F.least(F.coalesce("end_year", F.lit(9999)), F.lit(last)))
        .where("a <= b")
        .select("person_id", F.explode(F.sequence("a", "b")).alias("year"), "rn", "office_type_id")
        .groupBy("person_id", "year").agg(F.min_by("office_type_id", "rn").alias("covering"))
    )
    latest = known.groupBy("person_id").agg(F.max_by("office_type_id", "rn").alias("latest"))
    return (
        keys.join(covering, ["person_id", "year"], "left").join(latest, "person_id", "left")
        .select("person_id", "year", F.coalesce("covering", "latest", F.lit(0)).cast("int").alias("office_type_id"))
    )


def with_sequence(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """`df` with `rn`, its place within `keys` in the order `by` (a total order)."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*by)))
