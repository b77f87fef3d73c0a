"""Protocols cut into segments: protocol, who, speech, utterance, paragraph or sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plenumspark.functions.text import chamber_of, join_paragraphs, protocol_label
from plenumspark.functions.tokenize import sentences
from plenumspark.operators.runs import place_in, running_count
from plenumspark.operators.sequence import speech_numbers, speeches

COLUMNS = [
    "protocol_name", "chamber_abbrev", "segment_level", "name", "who", "id", "u_id", "data", "page_number", "year", "n_utterances",
    "speaker_note_id", "speech_index", "speech_name",
]
LEVELS = ("protocol", "who", "speech", "utterance", "paragraph", "sentence")


def _three(c: Column) -> Column:
    return F.format_string("%03d", c.cast("long"))


def _finish(df: DataFrame, level: str, year: Column) -> DataFrame:
    out = df.withColumn("segment_level", F.lit(level)).withColumn("chamber_abbrev", chamber_of("protocol_name")).withColumn("year", year)
    for name, kind in (("who", "string"), ("speaker_note_id", "string"), ("speech_index", "int"), ("speech_name", "string"), ("page_number", "int"), ("u_id", "string")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.select(*[F.col(c) if c not in ("n_utterances", "speech_index") else F.col(c).cast("int").alias(c) for c in COLUMNS])


def segments(utterances: DataFrame, level: str = "speech", strategy: str = "chain", skip_size: int = 0) -> DataFrame:
    """The segments of a level.

    `utterances` as for sequence merges, with `paragraphs` (array) or `data` (text) and `year`. Names:
    protocol, protocol_NNN (NNN the place of the speech, speaker or utterance from 001), for paragraphs
    protocol_NNN_NNN of utterance and paragraph; a paragraph's id is u_id@place from 0. Only texts longer
    than `skip_size` stay, if it is above 0. Null texts are ''.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level: {level}; known: {', '.join(LEVELS)}")
    has_paragraphs = "paragraphs" in utterances.columns
    text = join_paragraphs("paragraphs") if has_paragraphs else F.regexp_replace(F.coalesce("data", F.lit("")), r"(?U)^\s+|\s+\z", "")
    u = utterances.withColumn("__text", F.coalesce(text, F.lit("")))
    year = F.col("year")
    if level in ("speech", "who"):
        s = speeches(u, strategy if level == "speech" else "who", skip_size=0, text=F.col("__text"))
        years = utterances.groupBy("protocol_name").agg(F.min("year").alias("year"))
        s = s.join(years, "protocol_name", "left").withColumn("id", F.col("speech_id") if level == "speech" else F.col("who")).withColumn("u_id", F.col("speech_id"))
        s = s.withColumn("name", F.col("document_name")).withColumn("data", F.col("text"))
        if level == "speech":
            s = s.withColumn("speech_name", protocol_label("protocol_name", F.col("speech_index")))
        else:
            s = s.drop("speech_index")
        out = _finish(s, level, year)
    elif level == "protocol":
        ordered = F.sort_array(F.collect_list(F.struct("u_idx", "u_id", F.col("__text").alias("t"))))
        joined = F.array_join(F.transform(F.filter(ordered, lambda x: x["t"] != ""), lambda x: x["t"]), "\n")
        p = u.groupBy("protocol_name").agg(joined.alias("data"), F.min("year").alias("year"), F.count("*").alias("n_utterances"), F.min("page_number").alias("page_number"))
        out = _finish(p.withColumn("name", F.col("protocol_name")).withColumn("id", F.col("protocol_name")), level, year)
    else:
        n = place_in(u, "protocol_name", "u_idx", "u_id", "__no").withColumn("name", F.concat("protocol_name", F.lit("_"), _three(F.col("__no")))).withColumn("n_utterances", F.lit(1))
        if level == "utterance":
            out = _finish(n.withColumn("id", F.col("u_id")).withColumn("data", F.col("__text")), level, year)
        else:
            parts = F.col("paragraphs") if has_paragraphs else F.split("__text", "\n")
            if level == "sentence":
                parts = sentences("__text")
            e = n.drop(*[c for c in ("data",) if c in n.columns]).select("*", F.posexplode(parts).alias("__i", "data"))
            e = e.withColumn("id", F.concat("u_id", F.lit("@"), F.col("__i").cast("string"))).withColumn("name", F.concat("name", F.lit("_"), _three(F.col("__i") + 1)))
            out = _finish(e, level, year)
    return out.where(F.length("data") > skip_size) if skip_size > 0 else out


def utterance_speeches(utterances: DataFrame, strategy: str = "chain") -> DataFrame:
    """(protocol_name, u_id, speech_index): the speech of each utterance."""
    return speech_numbers(utterances, strategy).select("protocol_name", "u_id", "speech_index")


def page_numbers(elements: DataFrame) -> DataFrame:
    """Body elements (protocol_name, pos, tag) with page_number: 1 and one more after each `pb`."""
    e = running_count(elements.withColumn("__pb", F.col("tag") == "pb"), "protocol_name", "pos", "tag", "__pb", "__pages")
    return e.withColumn("page_number", (F.col("__pages") + 1).cast("int")).drop("__pb", "__pages")


def attribute_notes(elements: DataFrame) -> DataFrame:
    """The utterances among body elements (protocol_name, pos, tag, u_id, who, prev_id, note_id) with speaker_note_id.

    A speaker note holds for the utterances after it until one of another speaker, or one that doesn't go
    on from the one before it since the note; from there on, and before any note, it is `missing`. A
    protocol's elements are read from one file by one task, and no more of them meet in one here.
    """
    w = W.partitionBy("protocol_name").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    note = (F.col("tag") == "note") & F.col("note_id").isNotNull()
    e = elements.withColumn("__island", F.sum(note.cast("int")).over(w)).withColumn("__note", F.last(F.when(note, F.col("note_id")), ignorenulls=True).over(w))
    u = e.where("tag = 'u'")
    i = W.partitionBy("protocol_name", "__island").orderBy("pos")
    u = u.withColumn("__who", F.lag("who").over(i)).withColumn("__u", F.lag("u_id").over(i))
    broken = F.col("__u").isNotNull() & (~F.col("__who").eqNullSafe(F.col("who")) | ~F.col("prev_id").eqNullSafe(F.col("__u")))
    u = u.withColumn("__broken", F.max(broken.cast("int")).over(i.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return u.withColumn("speaker_note_id", F.when((F.col("__broken") == 1) | F.col("__note").isNull(), "missing").otherwise(F.col("__note"))).drop("__island", "__note", "__who", "__u", "__broken", "note_id")


def page_references(elements: DataFrame) -> DataFrame:
    """(protocol_name, pos, source_id, page_number, reference) of the `pb` elements (n, facs).

    A numeric n is the page; of a facsimile link of source 1 (kb.se) the number before .jp2, of source 2
    (riksdagen.se) that after #page=; any other is the page before plus 1.
    """
    link = F.coalesce("facs", F.when(F.col("n").startswith("http"), F.col("n")))
    source = F.when(link.contains("kb.se"), 1).when(link.contains("riksdagen.se"), 2).otherwise(0)
    p = elements.where("tag = 'pb'").withColumn("__link", link).withColumn("source_id", source)
    number = F.coalesce(
        F.regexp_extract("n", r"^(\d+)$", 1).try_cast("int"),
        F.when(F.col("source_id") == 1, F.regexp_extract("__link", r"-(\d+)\.jp2", 1).try_cast("int")),
        F.when(F.col("source_id") == 2, F.regexp_extract("__link", r"#page=(\d+)", 1).try_cast("int")),
    )
    w = W.partitionBy("protocol_name").orderBy("pos")
    p = p.withColumn("__n", number)
    p = p.withColumn("__island", F.count("__n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    i = W.partitionBy("protocol_name", "__island").orderBy("pos")
    page = F.coalesce(F.first("__n").over(i) + F.row_number().over(i) - 1, F.row_number().over(i) - 1)
    reference = F.regexp_replace(F.regexp_extract("__link", r"([^/]*)$", 1), "#.*$", "")
    return p.withColumn("page_number", page.cast("int")).withColumn("reference", reference).select("protocol_name", "pos", "source_id", "page_number", "reference")
