"""Words hyphenated at line ends, resolved by the corpus' own word frequencies, the same in any order of the texts.

A first pass finds the distinct dashed words and decides each once by joins with the frequency table; a
second rewrites the texts with the decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words after which a dashed first part stays as it is, and compounds that keep their hyphen.
CONJUNCTIONS = "än eller framför inklusive kontra liksom men o och og respektive samt såväl snart som till und utan".split()
HYPHENATED = r"^(?:[A-ZÅÄÖ]+-[a-zåäö]+|[A-ZÅÄÖ][a-zåäö]+-[A-ZÅÄÖ][a-zåäö]+|\d+-\w+|icke-\w+)"
PARAGRAPH = "##PARAGRAPH##"
#: How paragraphs are merged in the end.
KEEP, MERGE_WORDS, MERGE_ALL = 0, 1, 2


def prepared(text: Column) -> Column:
    """One line: paragraph marks for blank lines but not within a broken word, white space evened."""
    t = F.regexp_replace(text, r"\n{3,}", "\n\n")
    t = F.replace(t, F.lit("\n\n"), F.lit(PARAGRAPH))
    t = F.regexp_replace(t, rf"-\s*{PARAGRAPH}", "- ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def dashed_words(text: Column) -> Column:
    """The distinct "left- right" pairs of a prepared text that aren't followed up by a conjunction."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(\w+- \w+)"), F.lit(1)))
    stops = "|".join(CONJUNCTIONS)
    return F.filter(found, lambda w: ~w.rlike(rf" (?:{stops})$"))


def decide(dashed: DataFrame, frequencies: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """(dashed, resolved, reason): what becomes of each dashed word.

    In this order: a whitelisted compound or dashed form; a compound that keeps its hyphen; the form that
    is more frequent; where both are as frequent but not 0, unresolved; a compound if no part is known;
    else unresolved (resolved = dashed). `frequencies`: word, n; `whitelist`: word; both lower case.
    """
    d = dashed.select("dashed").where("dashed IS NOT NULL").distinct()
    d = d.withColumn("compound", F.replace("dashed", F.lit("- "), F.lit(""))).withColumn("joined", F.replace("dashed", F.lit("- "), F.lit("-")))
    d = d.withColumn("first_part", F.regexp_extract("dashed", r"^(.*)- ", 1))
    tf = frequencies.groupBy("word").agg(F.sum("n").alias("n"))
    white = (whitelist if whitelist is not None else frequencies.select("word").limit(0)).select("word").distinct().withColumn("listed", F.lit(True))
    for name, key in (("n_compound", F.lower("compound")), ("n_joined", F.lower("joined")), ("n_first", F.col("first_part"))):
        t = tf.select(F.col("word").alias("__w"), F.col("n").alias(name))
        d = d.join(t, key == t["__w"], "left").drop("__w").withColumn(name, F.coalesce(name, F.lit(0)))
    d = d.withColumn("last_part", F.regexp_extract("dashed", r"- (.*)$", 1))
    for name, key in (("w_compound", F.lower("compound")), ("w_joined", F.lower("joined")), ("w_first", F.lower("first_part")), ("w_last", F.lower("last_part"))):
        t = white.select(F.col("word").alias("__w"), F.col("listed").alias(name))
        d = d.join(t, key == t["__w"], "left").drop("__w").withColumn(name, F.coalesce(name, F.lit(False)))
    reason = (
        F.when(F.col("w_compound") | F.col("w_joined"), "whitelisted").when(F.col("joined").rlike(HYPHENATED), "hyphenated")
        .when(F.col("n_compound") != F.col("n_joined"), "frequency").when(F.col("n_joined") > 0, "unresolved").when((F.col("n_first") == 0) & ~F.col("w_first") & ~F.col("w_last"), "unknown parts").otherwise("unresolved")
    )
    d = d.withColumn("reason", reason)
    resolved = (
        F.when(F.col("reason") == "whitelisted", F.when(F.col("w_compound"), F.col("compound")).otherwise(F.col("joined")))
        .when(F.col("reason") == "hyphenated", F.col("joined"))
        .when(F.col("reason") == "frequency", F.when(F.col("n_compound") > F.col("n_joined"), F.col("compound")).otherwise(F.col("joined")))
        .when(F.col("reason") == "unknown parts", F.col("compound")).otherwise(F.col("dashed"))
    )
    return d.select("dashed", resolved.alias("resolved"), "reason")


def merged(text: Column, how: int) -> Column:
    if how == MERGE_WORDS:
        return F.regexp_replace(text, r"(?U)(\w+)\n\n(\w+)", "$1 $2")
    return F.replace(text, F.lit("\n\n"), F.lit(" ")) if how == MERGE_ALL else text


def dehyphenate(texts: DataFrame, id_column: str, text: str, frequencies: DataFrame, whitelist: DataFrame | None = None, how: int = KEEP) -> DataFrame:
    """(id, text): the texts with their dashed words resolved; null stays null."""
    ready = texts.select(F.col(id_column).alias("__id"), prepared(F.col(text)).alias("__text"))
    found = ready.select("__id", F.explode(dashed_words(F.col("__text"))).alias("dashed"))
    decided = decide(found, frequencies, whitelist).where("resolved <> dashed")
    fixes = found.join(decided, "dashed").groupBy("__id").agg(F.array_sort(F.collect_set(F.struct("dashed", "resolved"))).alias("fixes"))
    out = ready.join(fixes, "__id", "left")
    fixed = F.when(F.col("fixes").isNull(), F.col("__text")).otherwise(F.aggregate("fixes", F.col("__text"), lambda acc, f: F.replace(acc, f["dashed"], f["resolved"])))
    back = F.replace(fixed, F.lit(PARAGRAPH), F.lit("\n\n"))
    return out.select(F.col("__id").alias(id_column), merged(back, how).alias(text))
