"""Writers of grouped texts, tagged frames, archives and indexes, by name."""

from __future__ import annotations

import gzip
import io
import json
import lzma
import os
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenumspark.functions.text import slugify
from plenumspark.functions.tokenize import plain_words
from plenumspark.operators.numbering import number_rows

COMPRESSION = {"csv": "none", "gzip": "gzip", "bz2": "bzip2", "zstd": "zstd", "none": "none"}


def compression(name: str) -> str:
    if name not in COMPRESSION:
        raise ValueError(f"unsupported compression: {name}; known: {', '.join(COMPRESSION)}")
    return COMPRESSION[name]


def document_index(items: DataFrame, order: list[str], extra: list[str] | None = None) -> DataFrame:
    """The items' index: document_id from 0 in the given order, without their texts."""
    keep = [c for c in items.columns if c not in ("data", "text", "period_", "protocol_name_")]
    return number_rows(items.select(*(extra or keep)), order, "document_id")


def item_filename(temporal: Column, labels: list[Column], extension: str = "txt") -> Column:
    """`<period>_<labels>.<extension>`; unknown labels ("?") are `unknown`."""
    parts = [F.when(x.isNull() | (x == "?"), "unknown").otherwise(x) for x in labels]
    return F.concat(F.concat_ws("_", temporal, *parts), F.lit("." + extension))


def speech_filename(name: Column, labels: list[Column], speaker: Column, person: Column) -> Column:
    """Name, labels and speaker of a speech as one slug."""
    return F.concat(name, F.lit("_"), slugify(F.lower(F.concat_ws("_", *[F.coalesce(x, F.lit("unknown")) for x in labels], F.substring(F.coalesce(speaker, F.lit("")), 1, 80), F.coalesce(person, F.lit("")))), True))


_WRITTEN = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_items", T.LongType())])


def _files(folder: str, lower: bool, packed: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            out = []
            for name, text in zip(pdf["filename"], pdf["data"]):
                data = ((text or "").lower() if lower else text or "").encode("utf-8")
                path = os.path.join(folder, name + (".gz" if packed else ""))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(gzip.compress(data) if packed else data)
                out.append((path, 1))
            yield pd.DataFrame(out, columns=_WRITTEN.names)

    return write


def write_folder(items: DataFrame, folder: str, lower: bool = False, packed: bool = False) -> int:
    """One file an item (filename, data), written by the tasks to a shared folder, and document_index.csv beside them."""
    n = items.select("filename", "data").mapInPandas(_files(folder, lower, packed), _WRITTEN).agg(F.sum("n_items")).first()[0] or 0
    document_index(items, ["filename"]).coalesce(1).write.mode("overwrite").csv(os.path.join(folder, "document_index.csv"), header=True)
    return n


def write_partitioned(items: DataFrame, folder: str, by: str = "period", name: str = "none") -> None:
    """Texts as Parquet by period: the form for large exports."""
    items.repartition(by).write.mode("overwrite").partitionBy(by).option("compression", {"none": "uncompressed"}.get(compression(name), "zstd")).parquet(folder)


def write_zip(items: DataFrame, path: str) -> int:
    """One archive of all items and their index. One writer streams them, partition by partition: for exports of a size to send."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in items.select("filename", "data").orderBy("filename").toLocalIterator():
            z.writestr(r["filename"], r["data"] or "")
            n += 1
        if n:
            text = io.StringIO()
            for i, r in enumerate(document_index(items, ["filename"]).orderBy("document_id").toLocalIterator()):
                if not i:
                    text.write("\t".join(r.asDict()) + "\n")
                text.write("\t".join("" if v is None else str(v) for v in r) + "\n")
            z.writestr("document_index.csv", text.getvalue())
    return n


def write_zip_per_period(items: DataFrame, folder: str) -> int:
    """One archive a period, in a subfolder of its first four characters, each written by one task and with an index of its own."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        period = str(pdf["period"].iloc[0])
        target = os.path.join(folder, period[:4])
        os.makedirs(target, exist_ok=True)
        path = os.path.join(target, f"{period}.zip")
        pdf = pdf.sort_values("filename")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in zip(pdf["filename"], pdf["data"]):
                z.writestr(name, text or "")
            index = pdf.drop(columns=["data"]).reset_index(drop=True)
            index.insert(0, "document_id", range(len(index)))
            z.writestr("document_index.csv", index.to_csv(sep="\t", index=False))
        return pd.DataFrame([(path, len(pdf))], columns=_WRITTEN.names)

    return items.groupBy("period").applyInPandas(one, _WRITTEN).agg(F.sum("n_items")).first()[0] or 0


def write_tagged_archives(utterances: DataFrame, folder: str) -> int:
    """One archive a protocol (metadata.json with name, date and checksum, and <name>.json), written by the tasks."""
    u = utterances.select("protocol_name", "date", "u_idx", "u_id", "who", "prev_id", "next_id", "paragraphs", "annotation", "page_number", "speaker_note_id")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        os.makedirs(folder, exist_ok=True)
        pdf = pdf.sort_values("u_idx")
        name = pdf["protocol_name"].iloc[0]
        rows = [{k: (list(v) if k == "paragraphs" and v is not None else v) for k, v in r.items() if k not in ("protocol_name", "date", "u_idx")} for r in pdf.to_dict("records")]
        text = "".join("\n".join(p for p in r["paragraphs"] or [] if p) for r in rows)
        meta = {"name": name, "date": pdf["date"].iloc[0], "checksum": hashlib.sha1(text.encode("utf-8")).hexdigest()}
        path = os.path.join(folder, f"{name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("metadata.json", json.dumps(meta))
            z.writestr(f"{name}.json", json.dumps(rows, ensure_ascii=False, default=str))
        return pd.DataFrame([(path, 1)], columns=_WRITTEN.names)

    return u.groupBy("protocol_name").applyInPandas(one, _WRITTEN).agg(F.sum("n_items")).first()[0] or 0


def write_table(df: DataFrame, path: str, sep: str = "\t", name: str = "gzip") -> None:
    """A table as delimited text."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True, compression=compression(name))


def write_index(df: DataFrame, path: str) -> None:
    """An index both as delimited text and as Parquet."""
    write_table(df, path + ".csv")
    df.write.mode("overwrite").parquet(path + ".parquet")


def write_word_counts(counts: DataFrame, path: str, cut_off: int = 0) -> None:
    """(word, n) of the words with more than `cut_off` occurrences."""
    counts.where(F.col("n") > cut_off).write.mode("overwrite").parquet(path)


def write_database(df: DataFrame, url: str, name: str, **options: str) -> None:
    df.write.format("jdbc").mode("overwrite").options(url=url, dbtable=name, **options).save()


def write_sorted_speeches(items: DataFrame, path: str, labels: Sequence[str] = ()) -> int:
    """One archive of speeches (name, data, and the label columns, speaker and person if there), in order of their slugs; tokens are counted anew from the texts."""
    label = lambda c: F.col(c).cast("string") if c in items.columns else F.lit(None).cast("string")
    named = speech_filename(F.col("name"), [label(c) for c in labels], label("speaker"), label("who"))
    return write_zip(items.withColumn("filename", F.concat(named, F.lit(".txt"))).withColumn("n_tokens", F.size(plain_words(F.coalesce("data", F.lit(""))))), path)


#: Targets of tagged frames: (whether strings become numbers, whether frames are parted by group).
FRAME_TARGETS = {
    "single-tagged-frame": (False, False), "single-tagged-frame-per-group": (False, True),
    "single-id-tagged-frame": (True, False), "single-id-tagged-frame-per-group": (True, True),
}


def _frame_files(folder: str, by: list[str], kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for no, batch in enumerate(batches):
            out = []
            for group, pdf in batch.groupby(by, sort=True, dropna=False) if by else [((), batch)]:
                # Names by task and batch: a task that runs again writes the same files.
                place = os.path.join(folder, *[f"{c}={v}" for c, v in zip(by, group)])
                os.makedirs(place, exist_ok=True)
                name, pdf = os.path.join(place, f"part-{task:05d}-{no:05d}"), pdf.drop(columns=by).reset_index(drop=True)
                if kind == "feather":
                    path = name + ".feather"
                    pdf.to_feather(path)
                elif kind == "zip":
                    path = name + ".csv.zip"
                    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr(os.path.basename(name) + ".csv", pdf.to_csv(sep="\t", index=False))
                else:
                    path = name + ".csv.xz"
                    with open(path, "wb") as f:
                        f.write(lzma.compress(pdf.to_csv(sep="\t", index=False).encode("utf-8")))
                out.append((path, len(pdf)))
            yield pd.DataFrame(out, columns=_WRITTEN.names)

    return write


def write_frames(rows: DataFrame, folder: str, by: Sequence[str] = (), kind: str = "parquet", order: Sequence[str] = ()) -> None:
    """Token rows in folders by group; `kind` is parquet, feather, lzma, zip or a compression of delimited text.

    Rows of a group are brought together in pieces of a size, so a group that holds a third of all rows is
    written by many tasks. feather, lzma and zip files are written by the tasks to a shared folder.
    """
    by = list(by)
    rows = rows.hint("rebalance", *by) if by else rows
    rows = rows.sortWithinPartitions(*by, *order) if by or order else rows
    if kind in ("feather", "lzma", "zip"):
        rows.mapInPandas(_frame_files(folder, by, kind), _WRITTEN).agg(F.sum("n_items")).first()
        return
    w = rows.write.mode("overwrite")
    w = w.partitionBy(*by) if by else w
    w.parquet(folder) if kind == "parquet" else w.csv(folder, sep="\t", header=True, compression=compression(kind))


WRITERS: dict[str, Callable] = {"files-in-folder": write_folder, "files-in-zip": write_zip, "checkpoint-per-group": write_zip_per_period, "partitioned": write_partitioned, "sorted-speeches-in-zip": write_sorted_speeches}


def register_writer(name: str, writer: Callable) -> None:
    WRITERS[name] = writer


def writer(name: str) -> Callable:
    if name not in WRITERS:
        raise ValueError(f"unknown target: {name}; known: {', '.join(WRITERS)}")
    return WRITERS[name]
