"""The engine's pipelines from documents to exports; each is one lazy plan up to its writer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenumspark.functions.dehyphen import dehyphenate
from plenumspark.functions.text import dedent, join_paragraphs
from plenumspark.functions.tokenize import plain_words, pretokenize
from plenumspark.operators.codecs import speakers
from plenumspark.operators.grouping import group_segments, named_groups
from plenumspark.operators.quality import changed_checksums, corpus_subset, files_of_protocols
from plenumspark.operators.segment import segments
from plenumspark.operators.tagged import filtered, id_frame, n_token_lines, term_counts, token_rows, vocabulary
from plenumspark.operators.warehouse import build, version_table
from plenumspark.session import checkpointed
from plenumspark.sinks.markup import vrt, write_vrt
from plenumspark.sinks.writers import FRAME_TARGETS, document_index, item_filename, write_frames, write_index, write_table, write_word_counts, writer
from plenumspark.sources.files import read_tables, read_tagged
from plenumspark.sources.parlaclarin import corpus_index, read_elements, utterances
from plenumspark.streaming.ingest import tag

PREPROCESSORS = {"dedent": dedent, "pretokenize": pretokenize, "lower": F.lower}


def register_preprocessor(name: str, function) -> None:
    """Adds a text preprocessor: a function of a Column to a Column."""
    PREPROCESSORS[name] = function


def preprocessed(df: DataFrame, names: Sequence[str], column: str = "data") -> DataFrame:
    """The texts through the named preprocessors, from left to right; unknown names raise."""
    for n in names:
        if n not in PREPROCESSORS:
            raise ValueError(f"unknown preprocessor: {n}; known: {', '.join(PREPROCESSORS)}")
        df = df.withColumn(column, PREPROCESSORS[n](F.col(column)))
    return df


def with_speakers(parts: DataFrame, metadata: Mapping[str, DataFrame]) -> DataFrame:
    """Segments with name, gender_id, party_id and office_type_id of their speakers in their year; unknown speakers keep nulls."""
    s = speakers(parts, metadata["persons_of_interest"], metadata["person_party"], metadata["terms_of_office"]).withColumnRenamed("name", "speaker_name").withColumnRenamed("person_id", "who")
    return parts.join(s, ["who", "year"], "left")


def text_segments(
    spark: SparkSession, source: str, *, years: str | None = None, level: str = "speech", strategy: str = "chain", skip_size: int = 1, preprocess: Sequence[str] = (), frequencies: DataFrame | None = None,
    metadata: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Segments of the documents below `source`, preprocessed, dehyphenated if frequencies are given, with speakers if metadata is."""
    u = utterances(read_elements(spark, source, years))
    out = preprocessed(segments(u, level, strategy, skip_size), preprocess)
    if frequencies is not None:
        out = out.drop("data").join(dehyphenate(out, "name", "data", frequencies), "name")
    return with_speakers(out, metadata) if metadata else out


def extract_text(spark: SparkSession, source: str, target: str, *, temporal=None, keys: Sequence[str] = (), target_type: str = "files-in-folder", **options) -> int:
    """Texts grouped by period and keys, written by a named writer; ungrouped if `temporal` is None and there are no keys."""
    s = text_segments(spark, source, **options)
    if temporal is None and not keys:
        items = s.select("name", "who", "year", "protocol_name", "data").withColumn("filename", F.concat("name", F.lit(".txt"))).withColumn("period", F.coalesce(F.col("year").cast("string"), F.col("protocol_name")))
    else:
        g = named_groups(group_segments(s.withColumn("n_tokens", F.size(plain_words(F.coalesce("data", F.lit(""))))), temporal, keys), keys)
        items = g.withColumn("filename", item_filename(F.col("period"), [F.col(k).cast("string") for k in keys]))
    return writer(target_type)(items, target)


def extract_tagged(
    spark: SparkSession, source: str, target: str, *, years: str | None = None, strategy: str = "chain", target_type: str | None = None, as_ids: bool = True, level: str = "speech", keys: Sequence[str] = (),
    skip_text: bool = False, skip_lemma: bool = False, skip_punctuation: bool = False, skip_stopwords: bool = False, lowercase: bool = True, temporal: str = "year", kind: str = "parquet", metadata: Mapping[str, DataFrame] | None = None,
) -> dict[str, int]:
    """Tagged frames of documents at a level (protocol, speech, who or utterance) in folders by period and keys, their index and, for integer frames, one vocabulary; returns row counts.

    `target_type` is one of FRAME_TARGETS: strings or numbers, all in one frame or a frame and an index a
    group; without it frames go by period, as numbers if `as_ids`. Keys are columns of the index: who,
    protocol_name or, with metadata, a speaker's attributes; null keys are a group of their own.
    """
    from plenumspark.functions.dates import period, year_of_date
    from plenumspark.operators.sequence import speech_numbers

    if target_type is not None and target_type not in FRAME_TARGETS:
        raise ValueError(f"unknown target: {target_type}; known: {', '.join(FRAME_TARGETS)}")
    as_ids, per_group = FRAME_TARGETS[target_type] if target_type else (as_ids, True)
    u = read_tagged(spark, source, years).withColumn("year", year_of_date("date"))
    s = speech_numbers(u, strategy) if level == "speech" else u
    number = {"speech": "speech_index", "utterance": "u_idx"}
    names = {c: F.concat("protocol_name", F.lit("_"), F.format_string("%03d", F.col(n).cast("long"))) for c, n in number.items()} | {"protocol": F.col("protocol_name"), "who": F.concat("protocol_name", F.lit("_"), F.coalesce("who", F.lit("unknown")))}
    if level not in names:
        raise ValueError(f"unknown level: {level}; known: {', '.join(names)}")
    s = s.withColumn("document_name", names[level])
    s = s.withColumn("period", period("year", temporal, F.col("protocol_name")))
    first = lambda c: F.min_by(c, "u_idx").alias(c)
    documents = s.groupBy("document_name", "period", "year").agg(first("u_id"), first("who"), first("protocol_name"), F.sum(n_token_lines(F.col("annotation"))).alias("n_tokens"), F.count("*").alias("n_utterances"))
    documents = with_speakers(documents, metadata) if metadata else documents
    index = document_index(documents, ["document_name"])
    groups = ["period", *keys] if per_group else []
    rows = token_rows(s.withColumnRenamed("u_idx", "utt"), ["document_name", "utt"]).withColumn("tok_idx", F.col("utt").cast("long") * (1 << 20) + F.col("tok_idx")).drop("utt")
    rows = rows.join(index.select("document_name", "document_id", *groups), "document_name").drop("document_name")
    rows = filtered(rows, lowercase=lowercase, skip_text=skip_text, skip_lemma=skip_lemma, skip_punctuation=skip_punctuation, skip_stopwords=skip_stopwords)
    if as_ids:
        v = vocabulary(rows)
        rows = id_frame(rows, v)
        v.write.mode("overwrite").parquet(f"{target}/token2id")
    rows = checkpointed(rows)
    write_frames(rows, f"{target}/frames", groups, kind, ["document_id", "tok_idx"])
    write_index(index, f"{target}/document_index")
    if keys and per_group:
        write_frames(index, f"{target}/document_index_by_group", groups, "parquet", ["document_id"])
    return {"documents": index.count(), "tokens": rows.count()}


def extract_speech_index(spark: SparkSession, source: str, target: str, *, strategy: str = "chain", years: str | None = None, metadata: Mapping[str, DataFrame] | None = None) -> None:
    """All speeches without their texts, with speakers if metadata is given."""
    write_index(text_segments(spark, source, years=years, strategy=strategy, metadata=metadata).withColumn("n_chars", F.length("data")).drop("data"), target)


def term_frequencies(spark: SparkSession, source: str, target: str, *, years: str | None = None, cut_off: int = 0) -> None:
    """Word counts of all documents."""
    u = utterances(read_elements(spark, source, years)).select(F.explode(plain_words(join_paragraphs("paragraphs"))).alias("word"))
    write_word_counts(term_counts(u), target, cut_off)


def export_vrt(spark: SparkSession, source: str, target: str, *, years: str | None = None, tags: Sequence[str] = ("protocol", "speech", "utterance"), strategy: str = "chain_consecutive_unknowns", speaker_table: DataFrame | None = None) -> None:
    """Tagged protocols as vertical text, a folder a year."""
    from plenumspark.functions.dates import year_of_protocol

    u = read_tagged(spark, source, years)
    write_vrt(vrt(u, tuple(tags), strategy, speaker_table), target, year_of_protocol("protocol_name"))


def build_metadata(spark: SparkSession, raw: Mapping[str, DataFrame], target: str, version: str) -> None:
    """The warehouse's tables as Parquet below `target`, and its version."""
    for name, df in build(dict(raw)).items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")
    version_table(spark, version).write.mode("overwrite").parquet(f"{target}/version")


def build_metadata_files(spark: SparkSession, source: str, target: str, *, version: str = "local") -> None:
    """`build_metadata` of the delimited files (csv, also packed or within zip archives) of a folder, one table a file name."""
    build_metadata(spark, read_tables(spark, source), target, version)


def build_corpus_index(spark: SparkSession, source: str, target: str, *, years: str | None = None) -> None:
    """The corpus index as delimited text; the documents are parsed once and kept as Parquet."""
    read_elements(spark, source, years).write.mode("overwrite").parquet(f"{target}/elements")
    for name, df in corpus_index(spark.read.parquet(f"{target}/elements")).items():
        write_table(df, f"{target}/{name}")


def subset_corpus(metadata: Mapping[str, DataFrame], spoken: DataFrame, protocols: DataFrame, files: DataFrame, target: str) -> None:
    """Metadata and the list of files of some protocols."""
    for name, df in corpus_subset(metadata, spoken, protocols).items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")
    files_of_protocols(files, protocols).write.mode("overwrite").parquet(f"{target}/files")


def tag_changed(spark: SparkSession, source: str, done: DataFrame, tagger, *, years: str | None = None) -> DataFrame:
    """(u_id, annotation) of the utterances of protocols whose text has changed since `done` (protocol_name, checksum)."""
    u = utterances(read_elements(spark, source, years)).withColumn("data", join_paragraphs("paragraphs"))
    new = u.groupBy("protocol_name").agg(F.sha1(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("u_idx", "data"))), lambda x: x["data"]), "")).alias("checksum"))
    return tag(u.join(changed_checksums(done, new), "protocol_name", "left_semi"), tagger)
