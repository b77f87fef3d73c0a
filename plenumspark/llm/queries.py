"""Queries of the text operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenumspark.llm.leakage import leaks
from plenumspark.llm.packing import containers
from plenumspark.llm.pages import line_defects, paragraphs
from plenumspark.llm.sentences import sentences
from plenumspark.llm.turns import speaker_turns
from plenumspark.session import table


def _turns(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    return speaker_turns(table(spark, d, "protocol_segments"), table(spark, d, "speaker_notes"), table(spark, d, "person").select("person_id", "wiki_id"), with_text)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d, False)


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns with their clean text."""
    return _turns(spark, d, True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return line_defects(table(spark, d, "protocol_segments").select("u_id", "data"))


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired paragraphs of every segment."""
    return paragraphs(table(spark, d, "protocol_segments").select("u_id", "data"), mend_years=True)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "context_budget"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each capacity, their tokens, and the fewest containers that could hold them."""
    budgets = table(spark, d, "context_budget").select("budget_id", "capacity_tokens").distinct()
    placed = p7_containers(spark, d).groupBy("budget_id", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"))
    filled = placed.groupBy("budget_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    return filled.join(budgets, "budget_id").select("budget_id", "capacity_tokens", "n_containers", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("fewest"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents it leaked into."""
    found = p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, d, "benchmark").select("item_id").distinct().join(found, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents").select("doc_id", "text"))


QUERIES = {q.__name__: q for q in (p2_found, p2_turns, p4_found, p4_paragraphs, p7_containers, p7_fill, p8_found, p8_items, p9_found)}
SQL: dict[str, str] = {}
