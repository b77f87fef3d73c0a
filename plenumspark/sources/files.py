"""File listings, tagged archives, delimited utterances and metadata tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenumspark.functions.dates import in_years, year_of_protocol
from plenumspark.functions.text import base_name, decode_paragraphs

UTTERANCES = T.StructType([T.StructField(n, T.StringType()) for n in ("u_id", "who", "prev_id", "next_id", "paragraphs", "annotation", "page_number", "speaker_note_id")])
TAGGED = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("protocol_name", T.StringType()), T.StructField("date", T.StringType()), T.StructField("checksum", T.StringType()), T.StructField("u_idx", T.IntegerType())]
    + UTTERANCES.fields
)


def source_index(spark: SparkSession, path: str, pattern: str = "*", years: str | None = None) -> DataFrame:
    """(path, filename, name, subfolder, year, length) of the files below `path`, without reading them; empty files are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
    f = f.withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("name", base_name("path")).withColumn("subfolder", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))
    f = f.withColumn("year", year_of_protocol("name"))
    f = f.where(F.col("length") > 0)
    return f.where(in_years("year", years)) if years else f


def checked_index(index: DataFrame) -> DataFrame:
    """The index; a file whose name doesn't begin with `prot-` and a year fails the query."""
    bad = F.raise_error(F.concat(F.lit("not a protocol: "), F.col("filename"))).cast("int")
    return index.withColumn("year", F.when(F.col("year").isNotNull(), F.col("year")).otherwise(bad))


def protocol_files(spark: SparkSession, path: str) -> DataFrame:
    """The index of files named like `prot-….xml` with a number at the end."""
    return source_index(spark, path, "*.xml").where(F.col("filename").rlike(r"^prot-\d*-.*-\d*\.xml$"))


def _tagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = set(z.namelist())
                    if "metadata.json" in names:
                        meta = json.loads(z.read("metadata.json"))
                        name = meta.get("name") or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                        base = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                        if f"{base}.json" in names:
                            items = json.loads(z.read(f"{base}.json"))
                            for u in items:
                                p = u.get("paragraphs")
                                u["paragraphs"] = "@#@".join(p) if isinstance(p, list) else p
                        elif f"{base}.csv" in names:
                            frame = pd.read_csv(io.BytesIO(z.read(f"{base}.csv")), sep="\t", dtype=str, keep_default_na=False, quotechar='"', escapechar="\\", doublequote=False)
                            items = frame.to_dict("records")
                        else:
                            items = []
                        rows = [(path, name, meta.get("date"), meta.get("checksum"), i, *(None if u.get(k) in (None, "") else str(u[k]) for k in UTTERANCES.names)) for i, u in enumerate(items)]
            except (zipfile.BadZipFile, json.JSONDecodeError, KeyError, UnicodeDecodeError):
                rows = []
            yield pd.DataFrame(rows, columns=TAGGED.names)


def read_tagged(spark: SparkSession, path: str, years: str | None = None) -> DataFrame:
    """Utterances with their tagged text of archives of `metadata.json` and <name>.json or <name>.csv; broken and empty ones are skipped."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path).where(F.col("length") > 0)
    if years:
        f = f.where(in_years(year_of_protocol(base_name("path")), years))
    out = f.select("path", "content").mapInPandas(_tagged, TAGGED)
    return out.withColumn("paragraphs", decode_paragraphs("paragraphs")).withColumn("page_number", F.col("page_number").try_cast("int"))


def read_utterance_csv(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of tab-separated files with quoted texts and escaped quotes."""
    u = spark.read.csv(path, sep="\t", header=True, quote='"', escape="\\", multiLine=True, schema=UTTERANCES)
    return u.withColumn("paragraphs", decode_paragraphs("paragraphs")).withColumn("page_number", F.col("page_number").try_cast("int"))


def read_utterance_json(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of files that hold a list of objects."""
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if f.name == "paragraphs" else f.dataType) for f in UTTERANCES.fields])
    return spark.read.json(path, schema=schema, multiLine=True).withColumn("page_number", F.col("page_number").try_cast("int"))


def read_table(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None) -> DataFrame:
    """A metadata table of delimited text (.csv, .csv.gz), every column text unless a schema is given."""
    return spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True, schema=schema)


def read_word_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_patterns(spark: SparkSession, path: str, extension: str = "zip") -> DataFrame:
    """(pattern): one document pattern a line, with the extension unless it has a wildcard."""
    p = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    return p.select(F.when(F.col("value").contains("*") | F.col("value").endswith("." + extension), F.col("value")).otherwise(F.concat("value", F.lit("." + extension))).alias("pattern"))


def read_database(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database through its JDBC driver; the driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def read_tables(spark: SparkSession, source: str, sep: str = ",") -> dict[str, DataFrame]:
    """The delimited files of a folder, of one zip archive, or of archives in it, by file name without extension; all columns are strings."""
    tables: dict[str, DataFrame] = {}
    places = [source] if source.endswith(".zip") else sorted(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,csv.gz,csv.bz2,tsv,zip}").load(source).select("path").collect())
    for path in places:
        name = path.rsplit("/", 1)[-1].split(".")[0]
        if path.endswith(".zip"):
            members = _members(spark, path).where(F.col("member").rlike(r"\.(csv|tsv)$"))
            for r in members.select("member").distinct().collect():
                lines = members.where(F.col("member") == r["member"]).select(F.explode("lines").alias("value"))
                inner = r["member"].rsplit("/", 1)[-1].split(".")[0]
                tables[inner] = spark.read.option("header", True).option("sep", "\t" if r["member"].endswith(".tsv") else sep).csv(lines.rdd.map(lambda x: x[0]))
        else:
            tables[name] = spark.read.option("header", True).option("sep", "\t" if ".tsv" in path else sep).csv(path)
    return tables


def _members(spark: SparkSession, path: str) -> DataFrame:
    """(member, lines) of an archive."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame({"member": [name], "lines": [z.read(name).decode("utf-8-sig").splitlines()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "member string, lines array<string>")
