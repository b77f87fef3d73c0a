"""Checks and subsets: keys without parents, duplicates, columns that differ, protocols that are empty."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenumspark.functions.text import base_name


def foreign_key_violations(children: DataFrame, column: str, parents: DataFrame, key: str, name: str) -> DataFrame:
    """(name, n_rows, missing): child rows whose key no parent has, and the keys. Null keys are no violation."""
    orphans = children.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__k")).agg(F.count("*").alias("n"))
    orphans = orphans.join(parents.select(F.col(key).alias("__k")).distinct(), "__k", "left_anti")
    return orphans.groupBy(F.lit(name).alias("name")).agg(F.sum("n").alias("n_rows"), F.array_join(F.array_sort(F.collect_list(F.col("__k").cast("string"))), ", ").alias("missing"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows) of keys in several rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def column_differences(left: Mapping[str, list[str]], right: Mapping[str, list[str]]) -> dict[str, dict[str, list[str]]]:
    """Tables and columns that only one side has, by side; {} if both conform."""
    out: dict[str, dict[str, list[str]]] = {}
    for side, a, b in (("left", left, right), ("right", right, left)):
        for t in sorted(a):
            only = sorted(set(a[t]) - set(b.get(t, [])))
            if only or t not in b:
                out.setdefault(side, {})[t] = only
    return out


def subset_by_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table with the rows whose key columns are among `keys` (column -> one-column DataFrame)."""
    out = {}
    for name, df in tables.items():
        for column, wanted in keys.items():
            if column in df.columns:
                df = df.join(wanted.select(F.col(wanted.columns[0]).alias(column)).distinct(), column, "left_semi")
        out[name] = df
    return out


def corpus_subset(metadata: Mapping[str, DataFrame], utterances: DataFrame, protocols: DataFrame) -> dict[str, DataFrame]:
    """Metadata of the persons and protocols that a subset of protocols (protocol_name) has."""
    used = utterances.join(protocols.select("protocol_name").distinct(), "protocol_name", "left_semi")
    persons = used.select(F.col("who").alias("person_id")).distinct()
    return subset_by_keys(metadata, {"person_id": persons, "protocol_name": protocols.select("protocol_name")})


def empty_protocols(protocols: DataFrame, utterances: DataFrame) -> DataFrame:
    """Protocols without an utterance."""
    return protocols.join(utterances.select("protocol_name").distinct(), "protocol_name", "left_anti")


def missing_files(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(filename) of the wanted files the index doesn't have."""
    return wanted.select("filename").distinct().join(index.select("filename"), "filename", "left_anti")


def changed_checksums(old: DataFrame, new: DataFrame) -> DataFrame:
    """(protocol_name) of those whose checksum is new or has changed: what an incremental run must do again."""
    return new.join(old.select("protocol_name", "checksum"), ["protocol_name", "checksum"], "left_anti").select("protocol_name")


def replace_keys(df: DataFrame, lookup: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """`df` with keys replaced by a lookup (old, new); those it doesn't have stay."""
    l = lookup.groupBy(F.col(old).alias("__old")).agg(F.min(new).alias("__new"))  # noqa: E741
    j = df.join(l, df[column] == l["__old"], "left")
    return j.select(*[F.coalesce(F.col("__new"), df[c]).alias(c) if c == column else df[c] for c in df.columns])


def files_of_protocols(files: DataFrame, protocols: DataFrame) -> DataFrame:
    """The index rows of the files of some protocols."""
    return files.join(protocols.select(F.col("protocol_name").alias("name")).distinct(), "name", "left_semi")


def names_of_files(files: DataFrame) -> DataFrame:
    return files.select(base_name("path").alias("protocol_name")).distinct()
