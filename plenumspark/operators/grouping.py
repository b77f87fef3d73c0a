"""Segments grouped by period and attributes: texts, counts, names and hashes of the groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumspark.functions.dates import period
from plenumspark.functions.text import slugify


def group_label(keys: Sequence[str]) -> Column:
    """The group's key values as one slug, in the order given."""
    return slugify(F.concat_ws("_", *[F.replace(F.lower(F.coalesce(F.col(k).cast("string"), F.lit("none"))), F.lit(" "), F.lit("_")) for k in keys]))


def group_hash(label: Column) -> Column:
    return F.md5(label)


def ordered_text(order: Sequence[str], text: str = "data", by: str = "\n") -> Column:
    """An aggregate: the texts in order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("__t")))), lambda x: x["__t"]), by)


def group_segments(
    segments: DataFrame, temporal: str | Mapping[str, tuple[int, int]] | None = "year", keys: Sequence[str] = (), *, order: Sequence[str] = ("name", "id"), with_text: bool = True,
) -> DataFrame:
    """One row a group: period, the keys, n_segments, n_tokens, year and, unless left out, data.

    All segments of a period and key values are one group, wherever they come in the input. Keys cannot
    be combined with protocol segments; unknown keys raise. Without a text only sums are shuffled, combined
    before the shuffle, so a period with most segments is no hot task. A year in no period has its
    protocol's name as period.
    """
    missing = [k for k in keys if k not in segments.columns]
    if missing:
        raise ValueError(f"unknown keys: {', '.join(missing)}")
    s = segments.withColumn("period", period("year", temporal, F.col("protocol_name")))
    by = list(dict.fromkeys(["period", *keys]))
    aggs = [F.count("*").alias("n_segments"), F.sum(F.coalesce("n_tokens", F.lit(0)).cast("long")).alias("n_tokens")]
    if "year" not in by:
        aggs.append(F.min("year").alias("year"))
    if with_text:
        aggs.append(ordered_text([c for c in order if c not in by]).alias("data"))
    return s.groupBy(*by).agg(*aggs)


def named_groups(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with group_name (the slug of the keys) and group_hash; without keys both come from the period."""
    label = group_label(keys) if keys else slugify(F.coalesce("period", F.lit("")))
    return groups.withColumn("group_name", label).withColumn("group_hash", group_hash(F.col("group_name")))


def records(df: DataFrame, key: str) -> DataFrame:
    """(key, records): the rows of each key as an array of structs, sorted."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("records"))


def with_properties(segments: DataFrame, sources: Sequence[DataFrame], on: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Segments with the properties `names`, each from the last source that has it; the segments' own win. Missing names raise."""
    out = segments
    for s in sources:
        have = [n for n in names if n in s.columns]
        part = s.select(*on, *[F.col(n).alias(f"__{n}") for n in have]).dropDuplicates(list(on))
        out = out.join(part, list(on), "left")
        for n in have:
            out = out.withColumn(n, F.coalesce(F.col(f"__{n}"), F.col(n)) if n in out.columns and n not in segments.columns else (F.col(n) if n in segments.columns else F.col(f"__{n}"))).drop(f"__{n}")
    missing = [n for n in names if n not in out.columns]
    if missing:
        raise ValueError(f"unknown properties: {', '.join(missing)}")
    return out
