"""Extensions for growing corpora: documents that arrive, running counts, incremental runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plenumspark.functions.tokenize import plain_words
from plenumspark.sources.parlaclarin import ELEMENTS, _parse


def stream_elements(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """Body elements of the documents that arrive in a folder; each file is one whole document."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    f = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    return f.where("length > 0").select("path", "content").mapInPandas(_parse, ELEMENTS)


def running_word_counts(texts: DataFrame, text: str = "data") -> DataFrame:
    """(word, n): words counted over all that has arrived (complete or update mode)."""
    return texts.select(F.explode(plain_words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, key, n): events by time window; a window is final once `late` has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def run_batches(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Batch operators on what has arrived: sequence merges need whole documents, which a micro-batch of files has."""
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tag(segments: DataFrame, tagger: Callable[[], Callable[[str], str]], text: str = "data", id_column: str = "u_id") -> DataFrame:
    """(id, annotation): texts tagged by a plug-in made once in each task; '' for blank texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagged = tagger()
        for pdf in batches:
            yield pd.DataFrame({id_column: pdf[id_column], "annotation": [tagged(t) if t and t.strip() else "" for t in pdf[text]]})

    return segments.select(id_column, text).mapInPandas(run, f"{id_column} string, annotation string")
