"""Tagged tokens: long frames, filters, vocabularies, integer frames and part-of-speech counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenumspark.functions.pos import UNKNOWN, pos_group, pos_id, scheme
from plenumspark.functions.stopwords import STOPWORDS
from plenumspark.operators.numbering import number_rows

#: Tags of punctuation in the default scheme (fixed values).
PUNCTUATION = ("MID", "MAD", "PAD")


def token_rows(frames: DataFrame, keys: Sequence[str], annotation: str = "annotation") -> DataFrame:
    """(keys, tok_idx, token, lemma, pos, xpos): tab-separated rows under a line of column names, as token rows.

    Columns come in any order; those that are missing are null, blank lines count for nothing.
    """
    lines = F.split(F.col(annotation), "\n")
    head = F.split(F.get(lines, F.lit(0)), "\t")
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x != "")
    f = frames.where(F.col(annotation).isNotNull() & (F.col(annotation) != "")).select(*keys, head.alias("__h"), F.posexplode(body).alias("tok_idx", "__l"))
    cells = F.split("__l", "\t")
    at = lambda n: F.when(F.array_position("__h", n) > 0, F.get(cells, (F.array_position("__h", n) - 1).cast("int"))).alias(n)
    return f.select(*keys, "tok_idx", at("token"), at("lemma"), at("pos"), at("xpos"))


def merged_frames(frames: Column) -> Column:
    """Tagged frames as one: the first's line of column names once, the others' rows after it."""
    first = F.get(frames, F.lit(0))
    rest = F.transform(F.slice(frames, 2, F.greatest(F.size(frames) - 1, F.lit(0))), lambda x: F.regexp_extract(x, r"(?s)^[^\n]+\n(.*)$", 1))
    return F.array_join(F.filter(F.concat(F.array(F.coalesce(first, F.lit(""))), rest), lambda x: x != ""), "\n")


def n_token_lines(annotation: Column) -> Column:
    """The number of tokens of a tagged frame: its line breaks."""
    return F.length(F.coalesce(annotation, F.lit(""))) - F.length(F.replace(F.coalesce(annotation, F.lit("")), F.lit("\n"), F.lit("")))


def filtered(tokens: DataFrame, *, lowercase: bool = False, skip_text: bool = False, skip_lemma: bool = False, skip_punctuation: bool = False, skip_stopwords: bool = False, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """Token rows without what is skipped; xpos is always dropped. Each option works by itself.

    Null lemmas are ''. Stop words are compared in lower case; a null token is none.
    """
    if skip_text and skip_lemma:
        raise ValueError("token and lemma cannot both be skipped")
    out = tokens.drop("xpos").withColumn("lemma", F.coalesce("lemma", F.lit("")))
    if skip_stopwords:
        out = out.where(~F.coalesce(F.lower("token").isin(*stopwords), F.lit(False)))
    if skip_punctuation:
        out = out.where(~F.coalesce(F.col("pos").isin(*PUNCTUATION), F.lit(False)))
    if lowercase:
        out = out.withColumn("token", F.lower("token")).withColumn("lemma", F.lower("lemma"))
    return out.drop(*["token"] * skip_text, *["lemma"] * skip_lemma)


def vocabulary(tokens: DataFrame, document: str = "document_id") -> DataFrame:
    """(token, token_id): the distinct strings of token and lemma, numbered from 0 in order of first appearance.

    Order: documents, in each all tokens before all lemmas, by place. Nulls are not numbered.
    """
    parts = [
        tokens.select(F.col(c).alias("token"), F.struct(F.col(document), F.lit(k).alias("c"), F.col("tok_idx")).alias("at"))
        for k, c in enumerate(c for c in ("token", "lemma") if c in tokens.columns)
    ]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    firsts = both.where("token IS NOT NULL").groupBy("token").agg(F.min("at").alias("at")).select("token", "at")
    return number_rows(firsts, ["at"], "token_id").select("token", "token_id")


def id_frame(tokens: DataFrame, token2id: DataFrame, pos_scheme: str = "SUC") -> DataFrame:
    """Token rows with token_id, lemma_id and pos_id in place of the strings; -1 for a tag the scheme doesn't have.

    Joins on strings that a third of all tokens may share are split by adaptive execution; the vocabulary is
    the smaller side.
    """
    out = tokens
    for name in ("token", "lemma"):
        if name in tokens.columns:
            v = token2id.select(F.col("token").alias(f"__{name}"), F.col("token_id").alias(f"{name}_id"))
            out = out.join(v, out[name] == v[f"__{name}"], "left").drop(f"__{name}", name)
    return out.withColumn("pos_id", F.coalesce(pos_id(F.col("pos"), pos_scheme), F.lit(UNKNOWN))).drop("pos")


def pos_counts(tokens: DataFrame, by: Sequence[str], pos_scheme: str = "SUC", pos: str = "pos") -> DataFrame:
    """The tokens of each group of the scheme as columns, 0 where there are none, and n_tokens.

    n_tokens leaves out delimiters; tags the scheme doesn't have count in it but in no group.
    """
    groups = sorted({g for _, g in scheme(pos_scheme).values()})
    t = tokens.withColumn("__g", pos_group(F.col(pos), pos_scheme))
    counts = [F.count(F.when(F.col("__g") == g, 1)).alias(g) for g in groups]
    return t.groupBy(*by).agg(*counts, F.count(F.when(F.coalesce("__g", F.lit("")) != "Delimiter", 1)).alias("n_tokens"))


def term_counts(words: DataFrame, word: str = "word", cut_off: int = 0) -> DataFrame:
    """(word, n) of the words that occur more than `cut_off` times; combined before the shuffle."""
    out = words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    return out.where(F.col("n") > cut_off) if cut_off else out


def incidence(tokens: DataFrame, token2id: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, token_id): which strings a document has, the rows of a sparse 0/1 matrix."""
    return tokens.join(token2id, "token").select(document, "token_id").distinct()
