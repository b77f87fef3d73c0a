"""References to persons: trimming, the register's Wikidata ids, references that name nobody."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trimmed(ref: Column) -> Column:
    """The reference without surrounding Unicode white space."""
    return F.regexp_replace(ref, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+\z", "")


def names_somebody(ref: Column) -> Column:
    """False for null, blank and `unknown` in any letter case."""
    t = trimmed(ref)
    return F.coalesce((t != "") & (F.lower(t) != "unknown"), F.lit(False))


def wiki_map(person: DataFrame) -> DataFrame:
    """(wiki_key, wiki_person): one row per wiki_id of the register; of several persons the smallest id."""
    return (
        person.where(F.col("wiki_id").isNotNull() & F.col("person_id").isNotNull())
        .groupBy(F.col("wiki_id").alias("wiki_key"))
        .agg(F.min("person_id").alias("wiki_person"))
    )


def resolve(df: DataFrame, ref: str, person: DataFrame, out: str = "person_key") -> DataFrame:
    """`df` with `out`: the person a reference names, null where it names nobody.

    A trimmed reference equal to some `person.wiki_id` stands for that person; any other is kept as
    written. The join is a left join on a key unique on the right, so rows are neither lost nor
    multiplied; adaptive execution splits a hot reference on the left. Columns of `df` other than
    `out` pass through unchanged, whatever they are called.
    """
    key = F.when(names_somebody(F.col(ref)), trimmed(F.col(ref)))
    w = wiki_map(person)
    left = df.withColumn("__ref", key)
    # Rows that name nobody are spread over partitions under keys that match nothing.
    nobody = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[df[c] for c in df.columns]), F.lit(997)).cast("string"))
    joined = left.join(w, F.coalesce(left["__ref"], nobody) == w["wiki_key"], "left")
    kept = [left[c] for c in df.columns if c != out]
    return joined.select(*kept, F.coalesce(w["wiki_person"], left["__ref"]).alias(out))
