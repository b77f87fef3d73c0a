"""Transcripts into clean, ordered speaker turns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenumspark.llm.transcript import has_speech, parse_label, speech
from plenumspark.operators.persons import resolve
from plenumspark.operators.runs import number_runs
from plenumspark.session import checkpointed, spread

NO_NOTE = "missing"


@F.pandas_udf(T.BooleanType())
def spoken(text: pd.Series) -> pd.Series:
    return pd.Series([has_speech(t) for t in text])


@F.pandas_udf(T.StringType())
def clean(text: pd.Series) -> pd.Series:
    return pd.Series([speech(t) for t in text])


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("family", "given", "place", "party")]))
def label(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_label(t) or (None,) * 4 for t in text], columns=["family", "given", "place", "party"])


def _settled(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """(protocol_name, speaker_note_id, named): the one known speaker of the protocol a label names.

    A known speaker fits unless its labels in the protocol give another place, or given names that all
    differ (an initial agrees with its name). Of several that fit, the one that place, then given name,
    then party point to; none if that leaves more than one.
    """
    used = rows.where(F.coalesce(F.col("speaker_note_id"), F.lit(NO_NOTE)) != NO_NOTE).select("protocol_name", "speaker_note_id", "speaker").distinct()
    # Only notes in use are parsed, each once.
    wanted = notes.select("speaker_note_id", "speaker_note").join(used.select("speaker_note_id").distinct(), "speaker_note_id", "left_semi").distinct()
    labels = wanted.withColumn("l", label("speaker_note")).select("speaker_note_id", "l.*").where("family IS NOT NULL")
    l = checkpointed(used.join(labels, "speaker_note_id"))
    kept = lambda c: F.collect_set(F.when(F.col(c) != "", F.col(c)))
    known = l.where("speaker IS NOT NULL").groupBy("protocol_name", "family", "speaker").agg(kept("place").alias("places"), kept("given").alias("givens"), kept("party").alias("parties"))
    unknown = l.where("speaker IS NULL").drop("speaker")
    given_fits = F.exists("givens", lambda g: g.startswith(F.col("given")) | F.col("given").startswith(g))
    place_fits = F.array_contains("places", F.col("place"))
    pairs = unknown.join(known, ["protocol_name", "family"]).where(
        ((F.col("place") == "") | (F.size("places") == 0) | place_fits) & ((F.col("given") == "") | (F.size("givens") == 0) | given_fits)
    )
    rank = (place_fits & (F.col("place") != "")).cast("int") * 4 + (given_fits & (F.col("given") != "")).cast("int") * 2 + F.array_contains("parties", F.col("party")).cast("int")
    best = pairs.withColumn("rank", rank).groupBy("protocol_name", "speaker_note_id", "rank").agg(F.min("speaker").alias("named"), F.max("speaker").alias("other"))
    best = best.groupBy("protocol_name", "speaker_note_id").agg(F.max_by(F.struct("named", "other"), "rank").alias("b"))
    return best.where("b.named = b.other").select("protocol_name", "speaker_note_id", "b.named")


def speaker_segments(segments: DataFrame, notes: DataFrame, person: DataFrame) -> DataFrame:
    """The segments with speech left, each with its settled speaker (null: unknown) and turn_no.

    Returns protocol_name, place, u_id, speaker, speaker_note_id, turn_no.
    """
    place = F.regexp_extract("name", r"(\d+)$", 1).try_cast("long")
    rows = spread(segments.where(F.col("protocol_name").isNotNull()).withColumn("place", F.coalesce(place, F.lit(0))).select("protocol_name", "place", "u_id", "who", "speaker_note_id", "data"))
    rows = rows.where(spoken("data")).drop("data")
    # The settled labels and the turns both come from these rows.
    rows = checkpointed(resolve(rows.distinct(), "who", person, "speaker").drop("who"))
    found = _settled(rows, notes)
    rows = rows.join(found, ["protocol_name", "speaker_note_id"], "left").withColumn("speaker", F.coalesce("speaker", "named")).drop("named")
    key = F.coalesce(F.concat(F.lit("p"), F.col("speaker")), F.concat(F.lit("n"), F.coalesce("speaker_note_id", F.lit(""))))
    return number_runs(rows.withColumn("run_key", key), "protocol_name", "place", "u_id", "run_key", "turn_no").drop("run_key")


def speaker_turns(segments: DataFrame, notes: DataFrame, person: DataFrame, with_text: bool = False) -> DataFrame:
    """One row a turn: protocol_name, turn_no, first_u_id, last_u_id, speaker_id (and text).

    Segments without a spoken word (null and blank ones too) part nothing. A segment's speaker is the
    person in `who`, else the known speaker of the protocol its note names, else `unknown`; unknown
    segments form a run while speaker_note_id stays the same. Order is the number that ends `name`
    (0 if there is none), ties by u_id. Repeated rows count once; segments without protocol are left out.
    Texts are read up to their first spoken word to number the segments and are cleaned on their way to the
    numbered segments at the end, shuffled for that and the turn alone; a segment without u_id has a turn but no text.
    """
    at = F.struct("place", "u_id")
    rows = speaker_segments(segments, notes, person)
    aggs = [F.min_by("u_id", at).alias("first_u_id"), F.max_by("u_id", at).alias("last_u_id"), F.coalesce(F.first("speaker"), F.lit("unknown")).alias("speaker_id")]
    if with_text:
        texts = spread(segments.select("u_id", "data").where("u_id IS NOT NULL AND data IS NOT NULL")).select("u_id", clean("data").alias("text"))
        rows = rows.join(texts, "u_id", "left")
        # Repeated rows bring the same text again.
        ordered = F.sort_array(F.collect_set(F.struct("place", "u_id", F.coalesce("text", F.lit("")).alias("text"))))
        aggs.append(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    return rows.groupBy("protocol_name", F.col("turn_no").cast("int").alias("turn_no")).agg(*aggs)
