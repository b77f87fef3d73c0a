"""Annotated protocol documents (TEI XML) and their manifests as DataFrames."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenumspark.functions.dates import in_years, year_of_date
from plenumspark.functions.text import base_name, chamber_of
from plenumspark.operators.numbering import number_rows
from plenumspark.operators.segment import attribute_notes, page_numbers, page_references

ELEMENTS = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("protocol_name", T.StringType()), T.StructField("preface_name", T.StringType()),
        T.StructField("date", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("tag", T.StringType()),
        T.StructField("u_id", T.StringType()), T.StructField("who", T.StringType()), T.StructField("prev_id", T.StringType()),
        T.StructField("next_id", T.StringType()), T.StructField("note_id", T.StringType()), T.StructField("note", T.StringType()),
        T.StructField("n", T.StringType()), T.StructField("facs", T.StringType()), T.StructField("paragraphs", T.ArrayType(T.StringType())),
    ]
)
_ID = "{http://www.w3.org/XML/1998/namespace}id"


def _local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _children(root: ET.Element | None, *names: str) -> Iterator[ET.Element]:
    """Elements by a path of local names."""
    level = [root] if root is not None else []
    for name in names:
        level = [c for e in level for c in e if _local(c.tag) == name]
    yield from level


def _zero_filled(name: str) -> str:
    head, _, last = name.rpartition("-")
    return f"{head}-{last.zfill(3)}" if head and last.isdigit() else name


def _clean_lines(text: str) -> str:
    return "\n".join(line.strip() for line in text.split("\n"))


def elements_of(content: bytes, path: str = "") -> list[tuple]:
    """The body elements of one document in order (rows of ELEMENTS); page breaks, speaker notes and utterances.

    A document that can't be parsed, or has no body, has no elements.
    """
    try:
        root = ET.parse(io.BytesIO(content)).getroot()
    except ET.ParseError:
        return []
    tei = root if _local(root.tag) == "TEI" else next(_children(root, "TEI"), None)
    text = next(_children(tei, "text"), None)
    name = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    front = next(_children(text, "front", "div"), None)
    head = next(_children(front, "head"), None)
    preface = "".join(head.itertext()).strip() if head is not None else None
    if preface and preface.startswith("prot_"):
        preface = preface.replace("_", "-").lower()
    preface = _zero_filled(preface) if preface else None
    date = next((d.get("when") for d in (front.iter() if front is not None else ()) if _local(d.tag) == "docDate"), None)
    out: list[tuple] = []

    def add(tag: str, u_id=None, who=None, prev=None, next_=None, note_id=None, note=None, n=None, facs=None, paragraphs=None) -> None:
        out.append((path, name, preface, date, len(out), tag, u_id, who, prev, next_, note_id, note, n, facs, paragraphs))

    for section in (s for body in _children(text, "body") for s in body):
        for e in section:
            tag = _local(e.tag)
            if tag == "pb":
                add("pb", n=e.get("n"), facs=e.get("facs"))
            elif tag == "note" and e.get("type") == "speaker":
                add("note", note_id=e.get(_ID), note=" ".join("".join(e.itertext()).split()))
            elif tag == "u":
                segs = [_clean_lines("".join(s.itertext())).strip() for s in e if _local(s.tag) == "seg"]
                add("u", u_id=e.get(_ID), who=e.get("who") or "unknown", prev=e.get("prev"), next_=e.get("next"), paragraphs=segs)
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            yield pd.DataFrame(elements_of(content, path), columns=ELEMENTS.names)


def read_elements(spark: SparkSession, path: str | list[str], years: str | None = None, pattern: str = "*.xml") -> DataFrame:
    """All body elements of the documents below `path`; a file is one row of the scan, files are spread over tasks.

    `years` ("1920-1938,1955") prunes files by the year in their name before any is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    files = files.where(F.col("length") > 0)
    if years:
        files = files.where(in_years(F.regexp_extract("path", r"prot-(\d{4})[^/]*$", 1).try_cast("int"), years))
    return files.select("path", "content").mapInPandas(_parse, ELEMENTS)


def utterances(elements: DataFrame) -> DataFrame:
    """The utterances with page number and attributed speaker note, u_idx their order; see `operators.sequence`."""
    numbered = page_numbers(elements)
    u = attribute_notes(numbered)
    return u.select(
        "protocol_name", F.col("pos").alias("u_idx"), "u_id", "who", "prev_id", "next_id", "paragraphs", "page_number", "speaker_note_id", "date", year_of_date("date").alias("year"),
    )


def protocols(elements: DataFrame) -> DataFrame:
    """(document_id, document_name, date, year, chamber_abbrev, protocol_name), numbered in order of names."""
    p = elements.groupBy("protocol_name").agg(F.first("date", ignorenulls=True).alias("date"), F.first("preface_name", ignorenulls=True).alias("preface_name"))
    return number_rows(p, ["protocol_name"], "document_id").select(
        "document_id", F.col("protocol_name").alias("document_name"), "date",
        year_of_date("date").alias("year"), chamber_of("protocol_name").alias("chamber_abbrev"), F.coalesce("preface_name", "protocol_name").alias("protocol_name"),
    )


def speaker_notes(elements: DataFrame) -> DataFrame:
    """(speaker_note_id, speaker_note); of several notes of one id the last."""
    n = elements.where("tag = 'note' AND note_id IS NOT NULL")
    return n.groupBy(F.col("note_id").alias("speaker_note_id")).agg(F.max_by("note", F.struct("protocol_name", "pos")).alias("speaker_note"))


def corpus_index(elements: DataFrame) -> dict[str, DataFrame]:
    """The tables of a corpus index: protocols, utterances, speaker_notes, page_references, source_references, speeches, empty_protocols."""
    from plenumspark.functions.text import join_paragraphs
    from plenumspark.operators.sequence import speeches

    p, u = protocols(elements), utterances(elements)
    names = p.select(F.col("document_name").alias("protocol_name"), "document_id")
    refs = page_references(elements).join(names, "protocol_name")
    used = u.join(names, "protocol_name")
    said = speeches(u.withColumn("data", join_paragraphs("paragraphs")), "chain")
    return {
        "protocols": p,
        "utterances": used.select("u_id", "document_id", F.col("who").alias("person_id"), "speaker_note_id", "page_number"),
        "speaker_notes": speaker_notes(elements),
        "page_references": refs.select("document_id", "source_id", "page_number"),
        "source_references": refs.where("reference <> ''").select("document_id", "source_id", "reference").distinct(),
        "speeches": said.select("speech_id", F.col("who").alias("person_id"), F.col("protocol_name"), "document_name", "speech_index", "page_number", F.size(F.split("text", r"(?U)\s+")).alias("num_words")),
        "empty_protocols": p.join(used.select("document_id").distinct(), "document_id", "left_anti"),
    }


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(chamber, filename): the documents included by the manifests prot-ak.xml, prot-fk.xml and prot-ek.xml below `path`."""
    f = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"prot-(\w+)\.xml$", 1).alias("chamber"), "value")
    bad = F.raise_error(F.concat(F.lit("unknown chamber: "), F.col("chamber"))).cast("string")
    f = f.withColumn("chamber", F.when(F.col("chamber").isin("ak", "fk", "ek"), F.col("chamber")).otherwise(bad))
    e = f.select("chamber", F.explode(F.regexp_extract_all("value", F.lit(r"<xi:include[^>]*href=\"([^\"]+)\""), F.lit(1))).alias("href"))
    name = F.regexp_replace("href", r"^\./", "")
    return e.select("chamber", F.when(name.endswith(".xml"), name).otherwise(F.concat(name, F.lit(".xml"))).alias("filename"))


def chamber_index(manifest: DataFrame) -> DataFrame:
    """(chamber, protocols): the names of each chamber's protocols."""
    return manifest.groupBy("chamber").agg(F.array_sort(F.collect_set(base_name("filename"))).alias("protocols"))


def manifest_lines(documents: DataFrame) -> DataFrame:
    """(chamber, value): the text of each chamber's manifest; documents: chamber, folder, document."""
    line = F.concat(F.lit('  <xi:include href="./'), F.col("folder"), F.lit("/"), F.col("document"), F.lit('"/>'))
    body = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    head = '<?xml version="1.0" encoding="utf-8"?>\n<teiCorpus xmlns="http://www.tei-c.org/ns/1.0" xmlns:xi="http://www.w3.org/2001/XInclude">\n'
    return documents.groupBy("chamber").agg(F.concat(F.lit(head), body, F.lit("\n</teiCorpus>")).alias("value"))
