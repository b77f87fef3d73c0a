"""Protocols as vertical text (VRT) and XML, built by ordered string aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumspark.functions.text import chamber_of, xml_escape
from plenumspark.operators.sequence import speech_numbers


def _attr(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), F.coalesce(value.cast("string"), F.lit("")), F.lit('"'))


def without_header(annotation: Column) -> Column:
    """Tagged rows without the line of column names; '' where there are none."""
    return F.when(F.coalesce(F.instr(annotation, "\n"), F.lit(0)) > 1, F.regexp_extract(annotation, r"(?s)^[^\n]*\n(.*)$", 1)).otherwise("")


def _ordered(text: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("u_idx", "u_id", F.col(text).alias("t")))), lambda x: x["t"]), "\n")


def vrt(utterances: DataFrame, tags: tuple[str, ...] = ("protocol", "speech", "utterance"), strategy: str = "chain_consecutive_unknowns", speakers: DataFrame | None = None) -> DataFrame:
    """(protocol_name, value): each protocol as nested elements around its escaped tagged rows.

    utterances: protocol_name, u_idx, u_id, who, prev_id, next_id, speaker_note_id, page_number, date,
    annotation. `speakers` (u_id, name, party_id, gender_id, office_type_id, sub_office_type_id) fills the
    attributes of speeches. Sentence elements are not supported.
    """
    if "sentence" in tags:
        raise NotImplementedError("vertical text with sentence elements")
    u = utterances.withColumn("__rows", xml_escape(without_header(F.coalesce("annotation", F.lit("")))))
    if "utterance" in tags:
        u = u.withColumn("__rows", F.concat(F.lit("<utterance"), _attr("id", F.col("u_id")), _attr("page_number", F.col("page_number")), _attr("who", F.col("who")), F.lit(">\n"), F.col("__rows"), F.lit("</utterance>\n")))
    if "speech" in tags:
        u = speech_numbers(u, strategy)
        at = F.struct("u_idx", "u_id")
        s = u.groupBy("protocol_name", "speech_index").agg(
            _ordered("__rows").alias("__rows"), F.min_by("u_id", at).alias("u_id"), F.min_by("who", at).alias("who"), F.min_by("page_number", at).alias("page_number"), F.min("date").alias("date"),
        )
        names = ("name", "party_id", "gender_id", "office_type_id", "sub_office_type_id")
        if speakers is not None:
            s = s.join(speakers.select("u_id", *names), "u_id", "left")
        else:
            s = s.select("*", *[F.lit(None).cast("string").alias(n) for n in names])
        title = F.concat("protocol_name", F.lit("_"), F.format_string("%03d", F.col("speech_index").cast("long")))
        ids = [_attr(n, F.coalesce(F.col(n).cast("string"), F.lit("0"))) for n in names[1:]]
        head = F.concat(F.lit("<speech"), _attr("id", F.col("u_id")), _attr("title", title), _attr("who", F.col("who")), _attr("date", F.col("date")), *ids, _attr("name", xml_escape(F.col("name"))), _attr("page_number", F.col("page_number")), F.lit(">\n"))
        u = s.withColumn("__rows", F.concat(head, F.col("__rows"), F.lit("\n</speech>"))).withColumn("u_idx", F.col("speech_index"))
    p = u.groupBy("protocol_name").agg(_ordered("__rows").alias("value"), F.min("date").alias("date"))
    if "protocol" in tags:
        head = F.concat(F.lit("<protocol"), _attr("title", F.col("protocol_name")), _attr("date", F.col("date")), _attr("chamber", chamber_of("protocol_name")), F.lit(">\n"))
        p = p.withColumn("value", F.concat(head, F.col("value"), F.lit("\n</protocol>")))
    return p.select("protocol_name", "value")


def write_vrt(texts: DataFrame, folder: str, year: Column) -> None:
    """Vertical text by year, one folder each, compressed."""
    texts.withColumn("year", year).repartition("year").sortWithinPartitions("protocol_name").select("year", "value").write.mode("overwrite").partitionBy("year").option("compression", "gzip").text(folder)


def protocol_xml(speeches: DataFrame, cdata: bool = False) -> DataFrame:
    """(protocol_name, value): protocols of speeches (protocol_name, speech_index, speech_id, who, date, text) as XML; '' for one without text."""
    body = F.concat(F.lit("<![CDATA["), F.coalesce("text", F.lit("")), F.lit("]]>")) if cdata else xml_escape(F.coalesce("text", F.lit("")))
    one = F.concat(F.lit("<speech"), _attr("who", F.col("who")), _attr("speech_id", F.col("speech_id")), _attr("speech_date", F.col("date")), _attr("speech_index", F.col("speech_index")), F.lit(">\n"), body, F.lit("\n</speech>"))
    s = speeches.withColumn("__x", one)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("speech_index", F.col("__x").alias("t")))), lambda x: x["t"]), "\n")
    p = s.groupBy("protocol_name").agg(joined.alias("value"), F.min("date").alias("date"), F.max(F.length("text")).alias("n"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<protocol'), _attr("name", F.col("protocol_name")), _attr("date", F.col("date")), F.lit(">\n"))
    return p.select("protocol_name", F.when(F.coalesce("n", F.lit(0)) > 0, F.concat(head, F.col("value"), F.lit("\n</protocol>"))).otherwise("").alias("value"))


def protocol_text(speeches: DataFrame) -> DataFrame:
    """(protocol_name, value): protocols as plain text with a line of attributes before each speech."""
    one = F.concat(F.lit("### <speech"), _attr("who", F.col("who")), _attr("speech_index", F.col("speech_index")), _attr("speech_date", F.col("date")), F.lit(">\n"), F.coalesce("text", F.lit("")))
    s = speeches.withColumn("__x", one)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("speech_index", F.col("__x").alias("t")))), lambda x: x["t"]), "\n")
    p = s.groupBy("protocol_name").agg(joined.alias("value"), F.min("date").alias("date"))
    return p.select("protocol_name", F.concat(F.lit("### <protocol"), _attr("name", F.col("protocol_name")), _attr("date", F.col("date")), F.lit(">\n"), F.col("value"), F.lit("\n### </speech>")).alias("value"))
