"""Code tables: encoding, decoding, property lookups and speakers of segments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumspark.operators.asof import office_at, party_at


@dataclass(frozen=True)
class Codec:
    """Values of a column `source` looked up in `table` (key, value) or given by a function, under the name `target`."""

    source: str
    target: str
    table: DataFrame | None = None
    key: str | None = None
    value: str | None = None
    function: Callable[[Column], Column] | None = None
    default: Any = None


def apply_codecs(df: DataFrame, codecs: list[Codec], drop: bool = False, keep_existing: bool = True) -> DataFrame:
    """`df` with each codec's target; a target that exists stays, if `keep_existing`. Unknown sources are passed by.

    The tables are unique by key; of several values the smallest counts.
    """
    out = df
    for c in codecs:
        if c.source not in out.columns or (keep_existing and c.target in out.columns):
            continue
        if c.function is not None:
            out = out.withColumn(c.target, c.function(F.col(c.source)))
        else:
            t = c.table.groupBy(F.col(c.key).alias("__k")).agg(F.min(c.value).alias("__v"))
            columns = [x for x in out.columns if x != c.target]
            j = out.join(t, out[c.source] == t["__k"], "left")
            found = F.coalesce(t["__v"], F.lit(c.default)) if c.default is not None else t["__v"]
            out = j.select(*[out[x] for x in columns], found.alias(c.target))
    return out.drop(*{c.source for c in codecs if c.source in df.columns}) if drop else out


def decode_value(codecs: list[Codec], source: str, value: Any, default: Any = None, target: str | None = None) -> Any:
    """One value by the first codec from `source`."""
    for c in codecs:
        if c.source == source and target in (None, c.target) and c.table is not None:
            row = c.table.where(F.col(c.key) == F.lit(value)).select(c.value).orderBy(c.value).first()
            return row[0] if row else default
    return default


def any_person(df: DataFrame, ref: str, persons: DataFrame) -> DataFrame:
    """`df` with pid of a reference that is a number (pid), a Wikidata id (Q…) or a person_id; 0 for unknown ones.

    persons: pid, person_id, wiki_id.
    """
    text = F.col(ref).cast("string")
    by = F.when(text.rlike(r"^\d+$"), "pid").when(text.startswith("Q"), "wiki").otherwise("person")
    keys = (
        persons.select(F.lit("pid").alias("__by"), F.col("pid").cast("string").alias("__k"), "pid")
        .unionByName(persons.select(F.lit("wiki").alias("__by"), F.col("wiki_id").alias("__k"), "pid"))
        .unionByName(persons.select(F.lit("person").alias("__by"), F.col("person_id").alias("__k"), "pid"))
    ).where("__k IS NOT NULL").groupBy("__by", "__k").agg(F.min("pid").alias("__pid"))
    left = df.drop("pid")
    out = left.withColumn("__b", by).withColumn("__t", text)
    j = out.join(keys, (out["__b"] == keys["__by"]) & (out["__t"] == keys["__k"]), "left")
    return j.select(*[out[c] for c in left.columns], F.coalesce("__pid", F.lit(0).cast("long")).alias("pid"))


def overload_by_person(df: DataFrame, persons: DataFrame, columns: tuple[str, ...] = ("gender_id", "party_id"), ref: str = "who") -> DataFrame:
    """`df` with pid and the persons' columns, 0 where unknown; columns of that name are replaced."""
    p = persons.groupBy(F.col("pid").alias("__p")).agg(*[F.min(c).alias(f"__{c}") for c in columns])
    d = any_person(df.drop(*columns), ref, persons)
    j = d.join(p, d["pid"] == p["__p"], "left").drop("__p")
    for c in columns:
        j = j.withColumn(c, F.coalesce(f"__{c}", F.lit(0))).drop(f"__{c}")
    return j


def speakers(segments: DataFrame, persons: DataFrame, parties: DataFrame, terms: DataFrame) -> DataFrame:
    """(person_id, year, name, gender_id, party_id, office_type_id) of the distinct speakers and years of the segments.

    Looked up once a speaker and year, then joined back by whoever needs them; persons the register
    doesn't have are left out (see `unknown_speakers`).
    """
    keys = segments.select(F.col("who").alias("person_id"), "year").where("person_id IS NOT NULL AND year IS NOT NULL").distinct()
    p = persons.select("person_id", "name", "gender_id").dropDuplicates(["person_id"])
    known = keys.join(p, "person_id")
    return (
        known.join(party_at(known, parties, fixed=persons.select("person_id", "party_id")), ["person_id", "year"]).join(office_at(known, terms), ["person_id", "year"])
        .select("person_id", "year", "name", "gender_id", "party_id", "office_type_id")
    )


def unknown_speakers(segments: DataFrame, persons: DataFrame) -> DataFrame:
    """(who, n_segments): speakers the persons table doesn't have."""
    s = segments.groupBy("who").agg(F.count("*").alias("n_segments"))
    return s.join(persons.select(F.col("person_id").alias("who")).distinct(), "who", "left_anti")
