"""Speeches from the ordered utterances of protocols: sequence merges as window expressions.

`utterances`: protocol_name, u_idx (the order in the protocol), u_id, who, prev_id, next_id,
speaker_note_id; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plenumspark.operators.runs import number_runs, previous_of, running_count


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _by_who(df: DataFrame) -> DataFrame:
    first = df.groupBy("protocol_name", "who").agg(F.min("u_idx").alias("__first"))
    ranked = first.withColumn("group_no", F.dense_rank().over(W.partitionBy("protocol_name").orderBy("__first", F.col("who").asc_nulls_first())))
    r = ranked.select(F.col("protocol_name").alias("__p"), F.col("who").alias("__w"), "group_no")
    return df.join(r, df["protocol_name"].eqNullSafe(r["__p"]) & df["who"].eqNullSafe(r["__w"])).drop("__p", "__w")


def _runs(key: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda df: number_runs(df.withColumn("__key", key), "protocol_name", "u_idx", "u_id", "__key", "group_no").drop("__key")


def _chain(unknowns_go_on: bool) -> Callable[[DataFrame], DataFrame]:
    def go(df: DataFrame) -> DataFrame:
        start = _blank("prev_id")
        if unknowns_go_on:
            df = previous_of(df, "protocol_name", "u_idx", "u_id", ["who", "speaker_note_id"])
            goes_on = _blank("next_id") & (F.col("who") == "unknown") & (F.col("__prev.who") == "unknown") & F.col("__prev.speaker_note_id").eqNullSafe(F.col("speaker_note_id"))
            start = start & ~F.coalesce(goes_on, F.lit(False))
        out = running_count(df.withColumn("__start", start), "protocol_name", "u_idx", "u_id", "__start", "group_no")
        # What comes before the first start belongs to no speech.
        return out.where("group_no > 0").drop("__start", "__prev")

    return go


def _strategies() -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {
        "who": _by_who,
        "who_sequence": _runs(F.col("who")),
        "speaker_note_id_sequence": _runs(F.col("speaker_note_id")),
        "who_speaker_note_id_sequence": _runs(F.concat(F.coalesce("who", F.lit("")), F.lit("_"), F.coalesce("speaker_note_id", F.lit("")))),
        "chain": _chain(False),
        "chain_consecutive_unknowns": _chain(True),
    }


_CUSTOM: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_strategy(name: str, strategy: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a merge strategy: a function that gives the utterances a group_no (from 1, in order, per protocol)."""
    _CUSTOM[name] = strategy


def strategy(name: str) -> Callable[[DataFrame], DataFrame]:
    known = _strategies() | _CUSTOM
    if name not in known:
        raise ValueError(f"unknown merge strategy: {name}; known: {', '.join(known)}")
    return known[name]


def grouped(utterances: DataFrame, name: str = "chain") -> DataFrame:
    """The utterances with group_no, the speech they belong to by a strategy.

    A null protocol is one of its own. Utterances before the first link of a chain belong to no speech and
    are left out (see `orphans_of_chain`).
    """
    return strategy(name)(utterances)


def speech_numbers(utterances: DataFrame, name: str = "chain") -> DataFrame:
    """`grouped` with speech_index, the place of the speech in its protocol from 1, without gaps."""
    g = grouped(utterances, name)
    if name not in _CUSTOM:
        return g.withColumnRenamed("group_no", "speech_index")  # numbered from 1 without gaps as it is
    return g.withColumn("speech_index", F.dense_rank().over(W.partitionBy("protocol_name").orderBy("group_no")))


def speeches(utterances: DataFrame, name: str = "chain", skip_size: int = 1, text: Column | None = None) -> DataFrame:
    """One row a speech: document_name, speech_id (its first u_id), who, page_number, speaker_note_id, speech_index, n_utterances, text.

    Speeches are numbered first; those of fewer than `skip_size` characters are left out then, so numbers
    can have gaps. The text is that of the utterances that have one, a line each.
    """
    u = speech_numbers(utterances.withColumn("__text", text if text is not None else F.coalesce("data", F.lit(""))), name)
    at = F.struct("u_idx", "u_id")
    ordered = F.sort_array(F.collect_list(F.struct("u_idx", "u_id", F.col("__text").alias("t"))))
    joined = F.array_join(F.transform(F.filter(ordered, lambda x: x["t"] != ""), lambda x: x["t"]), "\n")
    out = u.groupBy("protocol_name", "speech_index").agg(
        F.min_by("u_id", at).alias("speech_id"), F.min_by("who", at).alias("who"), F.min_by("page_number", at).alias("page_number"),
        F.min_by("speaker_note_id", at).alias("speaker_note_id"), F.count("*").alias("n_utterances"),
        F.regexp_replace(joined, r"(?U)^\s+|\s+\z", "").alias("text"),
    )
    out = out.withColumn("document_name", F.concat(F.col("protocol_name"), F.lit("_"), F.format_string("%03d", F.col("speech_index").cast("long"))))
    return out.where(F.length("text") >= skip_size)


def orphans_of_chain(utterances: DataFrame) -> DataFrame:
    """(protocol_name, n_orphans): utterances before the first start of a chain, which no speech holds."""
    c = running_count(utterances.withColumn("__start", _blank("prev_id")), "protocol_name", "u_idx", "u_id", "__start", "__chain")
    return c.where("__chain = 0").groupBy("protocol_name").agg(F.count("*").alias("n_orphans"))


def strategy_table(utterances: DataFrame) -> DataFrame:
    """(protocol_name, u_id, one column a strategy): the speech of each utterance by every strategy, 0 for none."""
    out = utterances.select("protocol_name", "u_idx", "u_id").distinct()
    for name in _strategies():
        g = speech_numbers(utterances, name).select("protocol_name", "u_id", F.col("speech_index").alias(name)).distinct()
        out = out.join(g, ["protocol_name", "u_id"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def invalid_speeches(utterances: DataFrame, name: str = "chain") -> DataFrame:
    """(protocol_name, speech_index, n_who): speeches of more than one speaker, which no strategy may make."""
    s = speech_numbers(utterances, name).groupBy("protocol_name", "speech_index").agg(F.count_distinct(F.coalesce("who", F.lit("")))
        .alias("n_who"))
    return s.where("n_who > 1")


def checked(utterances: DataFrame, name: str = "chain") -> DataFrame:
    """`speech_numbers` that fails the query at the first speech of two speakers."""
    s = speech_numbers(utterances, name)
    bad = invalid_speeches(utterances, name).select("protocol_name", "speech_index", F.lit(True).alias("__bad"))
    out = s.join(bad, ["protocol_name", "speech_index"], "left")
    return out.withColumn("who", F.when(F.col("__bad"), F.raise_error(F.concat(F.lit("a speech of several speakers in "), F.col("protocol_name"))).cast("string")).otherwise(F.col("who"))).drop("__bad")


def broken_links(utterances: DataFrame) -> DataFrame:
    """(protocol_name, u_id, prev_id, expected): utterances whose prev_id isn't the u_id before them."""
    u = previous_of(utterances, "protocol_name", "u_idx", "u_id", ["u_id"]).withColumn("expected", F.col("__prev.u_id"))
    return u.where(~_blank("prev_id") & ~F.col("prev_id").eqNullSafe(F.col("expected"))).select("protocol_name", "u_id", "prev_id", "expected")
