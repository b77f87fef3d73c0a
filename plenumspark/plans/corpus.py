"""Queries of the corpus operators over whole tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plenumspark.functions.dates import in_years, partial_date, partial_flag, period
from plenumspark.functions.dehyphen import dashed_words, decide, dehyphenate, prepared
from plenumspark.functions.pos import pos_group
from plenumspark.functions.stopwords import STOPWORDS
from plenumspark.functions.text import chamber_of, checksum, protocol_label, require_letter, sanitize, short_checksum, slugify, xml_escape, zero_fill
from plenumspark.functions.tokenize import plain_words, sentence_words, sentences, tokens
from plenumspark.operators.asof import office_at, party_at, with_sequence
from plenumspark.operators.codecs import Codec, any_person, apply_codecs, overload_by_person, speakers, unknown_speakers
from plenumspark.operators.grouping import group_segments, named_groups, records
from plenumspark.operators.quality import corpus_subset, duplicates, empty_protocols, foreign_key_violations
from plenumspark.operators.runs import previous_of
from plenumspark.operators.segment import attribute_notes, page_numbers, segments
from plenumspark.operators.sequence import broken_links, invalid_speeches, orphans_of_chain, speech_numbers, speeches, strategy_table
from plenumspark.operators.tagged import filtered, id_frame, incidence, pos_counts, term_counts, vocabulary
from plenumspark.operators.warehouse import code_table, numbered, upsert, with_single_party, years
from plenumspark.session import table
from plenumspark.sinks.markup import protocol_xml, vrt
from plenumspark.sinks.writers import document_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ the tables as utterances, tokens and spans

_U = """s AS (SELECT DISTINCT protocol_name, chamber_abbrev, CAST(regexp_extract(name, '([0-9]+)$', 1) AS INTEGER) AS u_idx, u_id, coalesce(who, 'unknown') AS who,
  speaker_note_id, page_number, year, data, n_tokens FROM protocol_segments),
u AS (SELECT *, CASE WHEN lag(who) OVER w = who AND lag(speaker_note_id) OVER w = speaker_note_id THEN lag(u_id) OVER w END AS prev_id,
  CASE WHEN lead(who) OVER w = who AND lead(speaker_note_id) OVER w = speaker_note_id THEN lead(u_id) OVER w END AS next_id
  FROM s WINDOW w AS (PARTITION BY protocol_name ORDER BY u_idx, u_id))"""


def utterances(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """protocol_segments as utterances: repeated rows once, linked to their neighbours of the same speaker and note."""
    s = table(spark, d, "protocol_segments").select(
        "protocol_name", F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("u_idx"), "u_id", F.coalesce("who", F.lit("unknown")).alias("who"), "speaker_note_id", "page_number", "year", *more
    ).dropDuplicates(["u_id"])
    s = previous_of(s, "protocol_name", "u_idx", "u_id", ["who", "speaker_note_id", "u_id"], following=True)
    for side, out in (("__prev", "prev_id"), ("__next", "next_id")):
        s = s.withColumn(out, F.when((F.col(f"{side}.who") == F.col("who")) & (F.col(f"{side}.speaker_note_id") == F.col("speaker_note_id")), F.col(f"{side}.u_id"))).drop(side)
    return s


_TOKEN = r"[\p{L}\p{N}_]+|[.,!?]"
_T = _U.split(",\nu AS")[0] + f""",
d AS (SELECT u_id AS document_id, unnest(regexp_extract_all(data, '{_TOKEN}')) AS token, generate_subscripts(regexp_extract_all(data, '{_TOKEN}'), 1) - 1 AS tok_idx FROM s),
t AS (SELECT document_id, tok_idx, token, lower(token) AS lemma, CASE WHEN token = ',' THEN 'MID' WHEN token IN ('.', '!', '?') THEN 'MAD' WHEN regexp_matches(token, '^[0-9]+$') THEN 'RG'
  WHEN lower(token) <> token THEN 'PM' ELSE 'NN' END AS pos FROM d)"""


def token_table(spark: SparkSession, d: str) -> DataFrame:
    """The texts as tagged tokens, with plain rules in place of a tagger."""
    s = table(spark, d, "protocol_segments").select("u_id", "data").dropDuplicates(["u_id"])
    t = s.select(F.col("u_id").alias("document_id"), F.posexplode(F.regexp_extract_all("data", F.lit(f"({_TOKEN})"), F.lit(1))).alias("tok_idx", "token"))
    pos = F.when(F.col("token") == ",", "MID").when(F.col("token").isin(".", "!", "?"), "MAD").when(F.col("token").rlike("^[0-9]+$"), "RG").when(F.lower("token") != F.col("token"), "PM").otherwise("NN")
    return t.withColumn("lemma", F.lower("token")).withColumn("pos", pos).withColumn("xpos", F.col("pos"))


def _big(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ sequence merges

_RUN = "SELECT protocol_name, u_id, CAST(sum(CASE WHEN {first} OR {key} IS DISTINCT FROM {lagged} THEN 1 ELSE 0 END) OVER (PARTITION BY protocol_name ORDER BY u_idx, u_id) AS BIGINT) AS speech_index FROM (SELECT *, row_number() OVER w = 1 AS f, lag({key}) OVER w AS l FROM u WINDOW w AS (PARTITION BY protocol_name ORDER BY u_idx, u_id))"


def _run_sql(key: str) -> str:
    return "WITH " + _U + " " + _RUN.format(first="f", key=key, lagged="l")


_CHAIN = "SELECT protocol_name, u_id, CAST(dense_rank() OVER (PARTITION BY protocol_name ORDER BY c) AS BIGINT) AS speech_index FROM (SELECT *, sum(CASE WHEN {start} THEN 1 ELSE 0 END) OVER (PARTITION BY protocol_name ORDER BY u_idx, u_id) AS c FROM {source}) WHERE c > 0"
_UNKNOWN = "(SELECT *, lag(who) OVER w AS lw, lag(speaker_note_id) OVER w AS ln FROM u WINDOW w AS (PARTITION BY protocol_name ORDER BY u_idx, u_id))"
_GOES_ON = "prev_id IS NULL AND NOT coalesce(next_id IS NULL AND who = 'unknown' AND lw = 'unknown' AND ln IS NOT DISTINCT FROM speaker_note_id, false)"
_STRATEGY_SQL = {
    "who": "WITH " + _U + " SELECT u.protocol_name, u_id, CAST(dense_rank() OVER (PARTITION BY u.protocol_name ORDER BY first_idx, u.who) AS BIGINT) AS speech_index FROM u JOIN (SELECT protocol_name, who, min(u_idx) AS first_idx FROM u GROUP BY 1, 2) g ON g.protocol_name = u.protocol_name AND g.who = u.who",
    "who_sequence": _run_sql("who"),
    "speaker_note_id_sequence": _run_sql("speaker_note_id"),
    "who_speaker_note_id_sequence": _run_sql("(coalesce(who, '') || '_' || coalesce(speaker_note_id, ''))"),
    "chain": "WITH " + _U + " " + _CHAIN.format(start="prev_id IS NULL", source="u"),
    "chain_consecutive_unknowns": "WITH " + _U + " " + _CHAIN.format(start=_GOES_ON, source=_UNKNOWN),
}


def _speech_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _big(speech_numbers(utterances(spark, d), name).select("protocol_name", "u_id", "speech_index"), "speech_index")


for _name, _sql in _STRATEGY_SQL.items():
    QUERIES[f"speech_{_name}"], SQL[f"speech_{_name}"] = _speech_query(_name), _sql


@query(
    "WITH " + ", ".join(f"q_{k} AS ({v})" for k, v in _STRATEGY_SQL.items()) + " SELECT a.protocol_name, a.u_id, "
    + ", ".join(f"coalesce(q_{k}.speech_index, 0) AS {k}" for k in _STRATEGY_SQL)
    + " FROM (SELECT DISTINCT protocol_name, u_id FROM protocol_segments) a " + " ".join(f"LEFT JOIN q_{k} ON q_{k}.u_id = a.u_id" for k in _STRATEGY_SQL)
)
def speech_strategy_compare(spark: SparkSession, d: str) -> DataFrame:
    return _big(strategy_table(utterances(spark, d)).drop("u_idx"), *_STRATEGY_SQL)


_SPEECH = _STRATEGY_SQL["chain"].replace("SELECT protocol_name, u_id, CAST(dense_rank()", "SELECT protocol_name, u_id, who, u_idx, data, page_number, year, speaker_note_id, CAST(dense_rank()")
_STRIP = "regexp_replace({0}, '^[\\s\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+$', '', 'g')"
_SPOKEN = f"""WITH x AS ({_SPEECH}),
sp AS (SELECT protocol_name, speech_index, arg_min(u_id, (u_idx, u_id)) AS speech_id, arg_min(who, (u_idx, u_id)) AS who, CAST(count(*) AS BIGINT) AS n_utterances,
  {_STRIP.format("coalesce(string_agg(data, chr(10) ORDER BY u_idx, u_id) FILTER (WHERE data <> ''), '')")} AS text FROM x GROUP BY 1, 2)"""


@query(_SPOKEN + " SELECT * FROM sp WHERE length(text) >= 1")
def speech_text(spark: SparkSession, d: str) -> DataFrame:
    s = speeches(utterances(spark, d, "data"), "chain", skip_size=1)
    return _big(s.select("protocol_name", "speech_index", "speech_id", "who", "n_utterances", "text"), "speech_index", "n_utterances")


@query(_SPOKEN + " SELECT protocol_name, speech_index, CAST(length(text) AS BIGINT) AS n_chars FROM sp WHERE length(text) >= 500")
def speech_size_filter(spark: SparkSession, d: str) -> DataFrame:
    s = speeches(utterances(spark, d, "data"), "chain", skip_size=500)
    return _big(s.select("protocol_name", "speech_index", F.length("text").alias("n_chars")), "speech_index", "n_chars")


@query("WITH " + _U + " SELECT protocol_name, CAST(count(*) AS BIGINT) AS n_orphans FROM (SELECT *, sum(CASE WHEN prev_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY protocol_name ORDER BY u_idx, u_id) AS c FROM u) WHERE c = 0 GROUP BY 1")
def chain_orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans_of_chain(utterances(spark, d))


@query(_STRATEGY_SQL["speaker_note_id_sequence"].replace("SELECT protocol_name, u_id,", "SELECT protocol_name, speech_index, CAST(count(DISTINCT who) AS BIGINT) AS n_who FROM (SELECT protocol_name, who,", 1) + ") GROUP BY 1, 2 HAVING count(DISTINCT who) > 1")
def mixed_speeches(spark: SparkSession, d: str) -> DataFrame:
    return _big(invalid_speeches(utterances(spark, d), "speaker_note_id_sequence"), "speech_index", "n_who")


@query("WITH " + _U + ", b AS (SELECT *, lag(u_id) OVER (PARTITION BY protocol_name ORDER BY u_idx, u_id) AS expected FROM u) SELECT protocol_name, u_id, prev_id, expected FROM b WHERE prev_id IS NOT NULL AND prev_id IS DISTINCT FROM expected")
def chain_broken_links(spark: SparkSession, d: str) -> DataFrame:
    return broken_links(utterances(spark, d))


# ------------------------------------------------------------------ segments, attribution

_STRIPPED = _STRIP.format("data")


@query("WITH " + _U + f" SELECT protocol_name AS id, string_agg(t, chr(10) ORDER BY u_idx, u_id) FILTER (WHERE t <> '') AS data, CAST(count(*) AS BIGINT) AS n_utterances FROM (SELECT *, {_STRIPPED} AS t FROM u) GROUP BY 1")
def segment_protocol(spark: SparkSession, d: str) -> DataFrame:
    return _big(segments(utterances(spark, d, "data"), "protocol").select("id", "data", "n_utterances"), "n_utterances")


@query(
    "WITH " + _U + f", g AS (SELECT protocol_name, who, min(u_idx) AS f, string_agg(t, chr(10) ORDER BY u_idx, u_id) FILTER (WHERE t <> '') AS data, CAST(count(*) AS BIGINT) AS n_utterances FROM (SELECT *, {_STRIPPED} AS t FROM u) GROUP BY 1, 2) "
    "SELECT printf('%s_%03d', protocol_name, dense_rank() OVER (PARTITION BY protocol_name ORDER BY f, who)) AS name, who AS id, coalesce(data, '') AS data, n_utterances FROM g"
)
def segment_who(spark: SparkSession, d: str) -> DataFrame:
    return _big(segments(utterances(spark, d, "data"), "who").select("name", "id", "data", "n_utterances"), "n_utterances")


@query(_SPOKEN + " SELECT printf('%s_%03d', protocol_name, speech_index) AS name, speech_id AS id, n_utterances, CAST(length(text) AS BIGINT) AS n_chars FROM sp")
def segment_speech(spark: SparkSession, d: str) -> DataFrame:
    s = segments(utterances(spark, d, "data"), "speech")
    return _big(s.select("name", "id", "n_utterances", F.length("data").alias("n_chars")), "n_utterances", "n_chars")


@query("WITH " + _U + f" SELECT printf('%s_%03d', protocol_name, row_number() OVER (PARTITION BY protocol_name ORDER BY u_idx, u_id)) AS name, u_id AS id, who, {_STRIPPED} AS data FROM u")
def segment_utterance(spark: SparkSession, d: str) -> DataFrame:
    return segments(utterances(spark, d, "data"), "utterance").select("name", "id", "who", "data")


@query(
    "WITH " + _U + f", n AS (SELECT *, row_number() OVER (PARTITION BY protocol_name ORDER BY u_idx, u_id) AS no, string_split({_STRIPPED}, chr(10)) AS p FROM u), "
    "e AS (SELECT protocol_name, no, u_id, unnest(p) AS data, generate_subscripts(p, 1) AS i FROM n) SELECT printf('%s_%03d_%03d', protocol_name, no, i) AS name, u_id || '@' || CAST(i - 1 AS VARCHAR) AS id, data FROM e"
)
def segment_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return segments(utterances(spark, d, "data"), "paragraph").select("name", "id", "data")


@query()
def segment_sentence(spark: SparkSession, d: str) -> DataFrame:
    return segments(utterances(spark, d, "data"), "sentence").select("name", "id", "data")


@query("WITH " + _U + f" SELECT u_id AS id, CAST(length({_STRIPPED}) AS BIGINT) AS n_chars FROM u WHERE length({_STRIPPED}) > 300")
def segment_size_filter(spark: SparkSession, d: str) -> DataFrame:
    s = segments(utterances(spark, d, "data"), "utterance", skip_size=300)
    return _big(s.select("id", F.length("data").alias("n_chars")), "n_chars")


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Body elements of the protocols: a page break where the page changes, a note where the note does, the utterances."""
    u = utterances(spark, d)
    w = W.partitionBy("protocol_name").orderBy("u_idx", "u_id")
    u = u.withColumn("__n", F.lag("speaker_note_id").over(w)).withColumn("__p", F.lag("page_number").over(w)).withColumn("no", F.row_number().over(w))
    note = F.when((F.col("speaker_note_id") != "missing") & ~F.col("__n").eqNullSafe(F.col("speaker_note_id")), F.struct(F.lit("note").alias("tag"), F.lit(1).alias("k")))
    page = F.when(F.col("__p").isNotNull() & ~F.col("__p").eqNullSafe(F.col("page_number")), F.struct(F.lit("pb").alias("tag"), F.lit(0).alias("k")))
    parts = F.filter(F.array(page, note, F.struct(F.lit("u").alias("tag"), F.lit(2).alias("k"))), lambda x: x.isNotNull())
    e = u.select("*", F.explode(parts).alias("x"))
    return e.select("protocol_name", (F.col("no") * 3 + F.col("x.k")).alias("pos"), "x.tag", "u_id", "who", "prev_id", F.when(F.col("x.tag") == "note", F.col("speaker_note_id")).alias("note_id"))


_E = _U + """,
l AS (SELECT *, lag(speaker_note_id) OVER w AS n0, lag(page_number) OVER w AS p0, row_number() OVER w AS no FROM u WINDOW w AS (PARTITION BY protocol_name ORDER BY u_idx, u_id)),
e AS (SELECT protocol_name, no * 3 + 2 AS pos, 'u' AS tag, u_id, who, prev_id, NULL AS note_id FROM l
  UNION ALL SELECT protocol_name, no * 3 + 1, 'note', u_id, who, prev_id, speaker_note_id FROM l WHERE speaker_note_id <> 'missing' AND n0 IS DISTINCT FROM speaker_note_id
  UNION ALL SELECT protocol_name, no * 3, 'pb', u_id, who, prev_id, NULL FROM l WHERE p0 IS NOT NULL AND p0 IS DISTINCT FROM page_number)"""


@query("WITH " + _E + " SELECT * FROM (SELECT protocol_name, CAST(pos AS BIGINT) AS pos, tag, CAST(1 + sum(CASE WHEN tag = 'pb' THEN 1 ELSE 0 END) OVER (PARTITION BY protocol_name ORDER BY pos) AS BIGINT) AS page_number FROM e)")
def page_numbering(spark: SparkSession, d: str) -> DataFrame:
    return _big(page_numbers(_elements(spark, d)).select("protocol_name", "pos", "tag", "page_number"), "pos", "page_number")


@query(
    "WITH " + _E + """,
i AS (SELECT *, sum(CASE WHEN tag = 'note' THEN 1 ELSE 0 END) OVER w AS isl, last_value(note_id IGNORE NULLS) OVER w AS note FROM e WINDOW w AS (PARTITION BY protocol_name ORDER BY pos ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, lag(who) OVER w AS w0, lag(u_id) OVER w AS u0 FROM i WHERE tag = 'u' WINDOW w AS (PARTITION BY protocol_name, isl ORDER BY pos)),
b AS (SELECT *, max(CASE WHEN u0 IS NOT NULL AND (w0 IS DISTINCT FROM who OR prev_id IS DISTINCT FROM u0) THEN 1 ELSE 0 END) OVER (PARTITION BY protocol_name, isl ORDER BY pos ROWS UNBOUNDED PRECEDING) AS broken FROM v)
SELECT protocol_name, u_id, CASE WHEN broken = 1 OR note IS NULL THEN 'missing' ELSE note END AS speaker_note_id FROM b"""
)
def speaker_note_attribution(spark: SparkSession, d: str) -> DataFrame:
    return attribute_notes(_elements(spark, d)).select("protocol_name", "u_id", "speaker_note_id")


# ------------------------------------------------------------------ periods, groups

_PERIODS = {
    "year": ("CAST(year AS VARCHAR)", "year"),
    "lustrum": ("CAST(year - year % 5 AS VARCHAR) || '-' || CAST(year - year % 5 + 4 AS VARCHAR)", "lustrum"),
    "decade": ("CAST(year - year % 10 AS VARCHAR) || '-' || CAST(year - year % 10 + 9 AS VARCHAR)", "decade"),
    "custom": ("CASE WHEN year BETWEEN 1920 AND 1945 THEN 'before' WHEN year BETWEEN 1946 AND 1970 THEN 'between' WHEN year BETWEEN 1960 AND 2030 THEN 'after' END", {"before": (1920, 1945), "between": (1946, 1970), "after": (1960, 2030)}),
}


def _temporal(key) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = table(spark, d, "protocol_segments").select("u_id", "protocol_name", "year", "n_tokens").dropDuplicates(["u_id"])
        return group_segments(s, key, with_text=False).select("period", "n_segments", "n_tokens")

    return run


for _name, (_sql, _key) in _PERIODS.items():
    QUERIES[f"temporal_{_name}"] = _temporal(_key)
    SQL[f"temporal_{_name}"] = f"WITH s AS (SELECT DISTINCT u_id, protocol_name, year, n_tokens FROM protocol_segments) SELECT coalesce({_sql}, protocol_name) AS period, CAST(count(*) AS BIGINT) AS n_segments, CAST(sum(coalesce(n_tokens, 0)) AS BIGINT) AS n_tokens FROM s GROUP BY 1"


@query("WITH s AS (SELECT DISTINCT u_id, year FROM protocol_segments) SELECT CAST(year AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS n FROM s WHERE year BETWEEN 1930 AND 1945 OR year = 1955 GROUP BY 1")
def year_range_filter(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").where(in_years("year", "1930-1940,1938-1945,1955")).select("u_id", "year").distinct()
    return _big(s.groupBy("year").agg(F.count("*").alias("n")), "year")


_POI = "poi AS (SELECT DISTINCT pid, person_id, gender_id, party_id, name FROM persons_of_interest)"
_KEYED = "WITH " + _POI + """, s AS (SELECT DISTINCT u_id, who, year, n_tokens FROM protocol_segments),
k AS (SELECT person_id, min(gender_id) AS gender_id, min(party_id) AS party_id FROM poi GROUP BY 1),
g AS (SELECT CAST(year - year % 10 AS VARCHAR) || '-' || CAST(year - year % 10 + 9 AS VARCHAR) AS period, coalesce(gender_id, 0) AS gender_id, coalesce(party_id, 0) AS party_id, n_tokens
  FROM s LEFT JOIN k ON s.who = k.person_id WHERE year IS NOT NULL)"""


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").select("u_id", "protocol_name", "who", "year", "n_tokens").dropDuplicates(["u_id"]).where("year IS NOT NULL")
    k = table(spark, d, "persons_of_interest").groupBy(F.col("person_id").alias("who")).agg(F.min("gender_id").alias("gender_id"), F.min("party_id").alias("party_id"))
    s = s.join(k, "who", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("gender_id", "party_id")})
    return group_segments(s, "decade", ["gender_id", "party_id"], with_text=False)


@query(_KEYED + " SELECT period, CAST(gender_id AS BIGINT) AS gender_id, CAST(party_id AS BIGINT) AS party_id, CAST(count(*) AS BIGINT) AS n_segments, CAST(sum(coalesce(n_tokens, 0)) AS BIGINT) AS n_tokens FROM g GROUP BY ALL")
def group_period_keys(spark: SparkSession, d: str) -> DataFrame:
    return _big(_keyed(spark, d).select("period", "gender_id", "party_id", "n_segments", "n_tokens"), "gender_id", "party_id")


@query(_KEYED + " SELECT DISTINCT period, CAST(gender_id AS VARCHAR) || '_' || CAST(party_id AS VARCHAR) AS group_name, md5(CAST(gender_id AS VARCHAR) || '_' || CAST(party_id AS VARCHAR)) AS group_hash FROM g")
def group_hash(spark: SparkSession, d: str) -> DataFrame:
    return named_groups(_keyed(spark, d), ["gender_id", "party_id"]).select("period", "group_name", "group_hash")


@query("WITH " + _U + " SELECT coalesce(CAST(year AS VARCHAR), protocol_name) AS period, chamber_abbrev, md5(string_agg(coalesce(data, ''), chr(10) ORDER BY u_id)) AS text_md5 FROM u GROUP BY 1, 2")
def group_text(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").select("u_id", "protocol_name", "chamber_abbrev", "year", "n_tokens", "data").dropDuplicates(["u_id"])
    return group_segments(s, "year", ["chamber_abbrev"], order=["u_id"]).select("period", "chamber_abbrev", F.md5("data").alias("text_md5"))


@query("SELECT CAST(dense_rank() OVER (ORDER BY u_id) - 1 AS BIGINT) AS document_id, u_id, protocol_name, CAST(year AS BIGINT) AS year FROM (SELECT DISTINCT u_id, protocol_name, year FROM protocol_segments)")
def segment_index(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").select("u_id", "protocol_name", "year").distinct()
    return _big(document_index(s, ["u_id"]), "document_id", "year")


# ------------------------------------------------------------------ words and tagged tokens

_WORDS = "WITH s AS (SELECT DISTINCT u_id, data FROM protocol_segments), w AS (SELECT unnest(regexp_extract_all(lower(data), '[\\p{L}\\p{N}_]+')) AS word FROM s) SELECT word, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "protocol_segments").select("u_id", "data").dropDuplicates(["u_id"]).select(F.explode(plain_words("data")).alias("word"))


@query(_WORDS)
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(_words(spark, d))


@query(_WORDS + " HAVING count(*) > 5")
def term_frequency_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(_words(spark, d), cut_off=5)


_STOPS = ", ".join(f"'{w}'" for w in STOPWORDS)


@query("WITH " + _T + f" SELECT document_id, CAST(tok_idx AS BIGINT) AS tok_idx, token, lemma, pos FROM t WHERE lower(token) NOT IN ({_STOPS})")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    return _big(filtered(token_table(spark, d), skip_stopwords=True), "tok_idx")


@query("WITH " + _T + " SELECT document_id, CAST(tok_idx AS BIGINT) AS tok_idx, lower(token) AS token, lemma, pos FROM t WHERE pos NOT IN ('MID', 'MAD', 'PAD')")
def punctuation_filter(spark: SparkSession, d: str) -> DataFrame:
    return _big(filtered(token_table(spark, d), skip_punctuation=True, lowercase=True), "tok_idx")


@query("WITH " + _T + " SELECT document_id, CAST(tok_idx AS BIGINT) AS tok_idx, lemma, pos FROM t")
def tagged_projection(spark: SparkSession, d: str) -> DataFrame:
    return _big(filtered(token_table(spark, d), skip_text=True), "tok_idx")


_V = _T + """,
a AS (SELECT token AS tk, document_id, 0 AS c, tok_idx FROM t UNION ALL SELECT lemma, document_id, 1, tok_idx FROM t),
f AS (SELECT tk, min((document_id, c, tok_idx)) AS first_at FROM a GROUP BY 1),
v AS (SELECT tk AS token, CAST(row_number() OVER (ORDER BY first_at) - 1 AS BIGINT) AS token_id FROM f)"""


@query("WITH " + _V + " SELECT token, token_id FROM v")
def vocabulary_ids(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary(token_table(spark, d))


@query("WITH " + _V + " SELECT t.document_id, CAST(t.tok_idx AS BIGINT) AS tok_idx, x.token_id, y.token_id AS lemma_id, CAST(CASE t.pos WHEN 'NN' THEN 10 WHEN 'PM' THEN 13 WHEN 'RG' THEN 17 WHEN 'MAD' THEN 22 WHEN 'MID' THEN 23 END AS BIGINT) AS pos_id FROM t JOIN v x ON x.token = t.token JOIN v y ON y.token = t.lemma")
def id_tagged_frame(spark: SparkSession, d: str) -> DataFrame:
    t = token_table(spark, d).drop("xpos")
    return _big(id_frame(t, vocabulary(t)), "tok_idx", "pos_id")


_GROUPS = ("Adjective", "Adverb", "Conjunction", "Delimiter", "Noun", "Numeral", "Other", "Preposition", "Pronoun", "Verb")
_OF = {"Delimiter": "pos IN ('MID', 'MAD')", "Noun": "pos IN ('NN', 'PM')", "Numeral": "pos = 'RG'"}


@query("WITH " + _T + " SELECT document_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE {_OF.get(g, 'false')}) AS BIGINT) AS \"{g}\"" for g in _GROUPS) + ", CAST(count(*) FILTER (WHERE pos NOT IN ('MID', 'MAD')) AS BIGINT) AS n_tokens FROM t GROUP BY 1")
def pos_group_counts(spark: SparkSession, d: str) -> DataFrame:
    return pos_counts(token_table(spark, d), ["document_id"])


@query("WITH " + _T + " SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT document_id, token FROM t)")
def document_incidence(spark: SparkSession, d: str) -> DataFrame:
    t = token_table(spark, d)
    return incidence(t, vocabulary(t)).agg(F.count("*").alias("n"))


@query("WITH " + _T + " SELECT pos, CAST(count(*) AS BIGINT) AS n, CASE WHEN pos IN ('MID', 'MAD') THEN 'Delimiter' WHEN pos = 'RG' THEN 'Numeral' ELSE 'Noun' END AS pos_group FROM t GROUP BY 1")
def pos_scheme_lookup(spark: SparkSession, d: str) -> DataFrame:
    return token_table(spark, d).groupBy("pos").agg(F.count("*").alias("n")).withColumn("pos_group", pos_group(F.col("pos")))


@query()
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").select("u_id", "data").dropDuplicates(["u_id"])
    return s.select("u_id", F.posexplode(tokens("data")).alias("tok_idx", "token"))


@query()
def sentence_tokens(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").select("u_id", "data").dropDuplicates(["u_id"])
    return s.select("u_id", F.posexplode(sentence_words("data")).alias("sent_no", "words"))


@query()
def plain_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").select("u_id", "data").dropDuplicates(["u_id"])
    return s.select("u_id", F.posexplode(sentences("data")).alias("sent_no", "sentence"))


_DASH = """p AS (SELECT u_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(data, '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10), '##PARAGRAPH##'), '-\\s*##PARAGRAPH##', '- ', 'g'), '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS t
  FROM (SELECT DISTINCT u_id, data FROM protocol_segments)),
f AS (SELECT DISTINCT unnest(regexp_extract_all(t, '[\\p{L}\\p{M}\\p{N}_]+- [\\p{L}\\p{M}\\p{N}_]+')) AS dashed FROM p),
q AS (SELECT dashed, replace(dashed, '- ', '') AS compound, replace(dashed, '- ', '-') AS joined, regexp_extract(dashed, '^(.*)- ', 1) AS first_part FROM f
  WHERE NOT regexp_matches(dashed, ' (än|eller|framför|inklusive|kontra|liksom|men|o|och|og|respektive|samt|såväl|snart|som|till|und|utan)$')),
tf AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(data), '[\\p{L}\\p{N}_]+')) AS word FROM (SELECT DISTINCT u_id, data FROM protocol_segments)) GROUP BY 1),
r AS (SELECT q.*, coalesce(a.n, 0) AS nc, coalesce(b.n, 0) AS nj, coalesce(c.n, 0) AS nf FROM q LEFT JOIN tf a ON a.word = lower(compound) LEFT JOIN tf b ON b.word = lower(joined) LEFT JOIN tf c ON c.word = first_part),
z AS (SELECT *, CASE WHEN regexp_matches(joined, '^([A-ZÅÄÖ]+-[a-zåäö]+|[A-ZÅÄÖ][a-zåäö]+-[A-ZÅÄÖ][a-zåäö]+|[0-9]+-[\\p{L}\\p{N}_]+|icke-[\\p{L}\\p{N}_]+)') THEN 'hyphenated' WHEN nc <> nj THEN 'frequency' WHEN nj > 0 THEN 'unresolved' WHEN nf = 0 THEN 'unknown parts' ELSE 'unresolved' END AS reason FROM r)
SELECT dashed, CASE reason WHEN 'hyphenated' THEN joined WHEN 'frequency' THEN CASE WHEN nc > nj THEN compound ELSE joined END WHEN 'unknown parts' THEN compound ELSE dashed END AS resolved, reason FROM z"""


@query("WITH " + _DASH)
def dehyphen_decisions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").select("u_id", "data").dropDuplicates(["u_id"])
    found = s.select(F.explode(dashed_words(prepared(F.col("data")))).alias("dashed"))
    return decide(found, term_counts(_words(spark, d)))


@query()
def dehyphenated_text(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").select("u_id", "data").dropDuplicates(["u_id"])
    return dehyphenate(s, "u_id", "data", term_counts(_words(spark, d)))


# ------------------------------------------------------------------ scalars


@query("SELECT DISTINCT u_id, sha1(data) AS checksum, substr(sha1(data), 1, 16) AS short_checksum FROM protocol_segments")
def text_checksum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "protocol_segments").select("u_id", checksum("data").alias("checksum"), short_checksum("data").alias("short_checksum")).distinct()


@query("SELECT DISTINCT protocol_name, CASE WHEN protocol_name LIKE '%-fk-%' THEN 'fk' WHEN protocol_name LIKE '%-ak-%' THEN 'ak' ELSE 'ek' END AS chamber FROM protocol_segments")
def chamber_from_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "protocol_segments").select("protocol_name").distinct().withColumn("chamber", chamber_of("protocol_name"))


@query(
    """WITH n AS (SELECT DISTINCT name, string_split(name, '-') AS p FROM protocol_segments), m AS (SELECT name, p[2] AS y, p[-1] AS l FROM n)
SELECT name, trim((CASE WHEN name LIKE '%-fk-%' THEN 'Första kammaren' WHEN name LIKE '%-ak-%' THEN 'Andra kammaren' ELSE '' END) || ' ' || (CASE WHEN length(y) IN (6, 8) THEN substr(y, 1, 4) || '/' || substr(y, 5) ELSE y END)
  || ':' || ltrim(regexp_extract(l, '^([^_]*)', 1), '0') || ' ' || regexp_extract(l, '_(.*)$', 1)) AS label FROM m"""
)
def protocol_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "protocol_segments").select("name").distinct().withColumn("label", protocol_label("name"))


@query("SELECT DISTINCT pid, trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(name, ''))), '[^a-z0-9_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-_') AS slug FROM persons_of_interest WHERE name IS NOT NULL")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "persons_of_interest").where("name IS NOT NULL").select("pid", slugify("name").alias("slug")).distinct()


@query("SELECT DISTINCT pid, regexp_replace(strip_accents(name), '[^a-zåäöA-ZÅÄÖ#0-9_]', '_', 'g') AS file_name FROM persons_of_interest WHERE name IS NOT NULL")
def sanitized_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "persons_of_interest").where("name IS NOT NULL").select("pid", sanitize("name").alias("file_name")).distinct()


@query("SELECT speaker_note_id, replace(replace(replace(replace(replace(speaker_note, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM speaker_notes")
def xml_escaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "speaker_notes").select("speaker_note_id", xml_escape("speaker_note").alias("escaped"))


@query("SELECT DISTINCT pid, printf('%03d', pid) AS code FROM persons_of_interest")
def zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "persons_of_interest").select("pid", zero_fill("pid").alias("code")).distinct()


@query("SELECT DISTINCT u_id, CASE WHEN regexp_matches(data, '[a-zåäöA-ZÅÄÖ]') THEN data WHEN data IS NOT NULL THEN '' END AS data FROM protocol_segments")
def letters_required(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "protocol_segments").select("u_id", require_letter("data").alias("data")).distinct()


_FIRST = "CASE length({0}) WHEN 4 THEN TRY_CAST({0} || '-01-01' AS DATE) WHEN 7 THEN TRY_CAST({0} || '-01' AS DATE) WHEN 10 THEN TRY_CAST({0} AS DATE) END"
_FLAG = "CASE length({0}) WHEN 4 THEN 'Y' WHEN 7 THEN 'M' WHEN 10 THEN 'D' ELSE 'X' END"


@query(
    f"SELECT DISTINCT person_id, strftime(recorded_at, '%Y-%m-%d %H:%M:%S') AS recorded_at, born, strftime({_FIRST.format('born')}, '%Y-%m-%d') AS born_date, {_FLAG.format('born')} AS born_flag, strftime(CAST(CASE length(dead) WHEN 4 THEN {_FIRST.format('dead')} + INTERVAL 1 YEAR - INTERVAL 1 DAY WHEN 7 THEN last_day({_FIRST.format('dead')}) ELSE {_FIRST.format('dead')} END AS DATE), '%Y-%m-%d') AS dead_date, {_FLAG.format('dead')} AS dead_flag FROM person"
)
def partial_dates(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, d, "person").select(
        "person_id", F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss").alias("recorded_at"), "born", text(partial_date("born")).alias("born_date"), partial_flag("born").alias("born_flag"), text(partial_date("dead", extend=True)).alias("dead_date"), partial_flag("dead").alias("dead_flag")
    ).distinct()


# ------------------------------------------------------------------ joins


@query("SELECT DISTINCT i.pid, p.person_id, p.gender FROM persons_of_interest i JOIN person p USING (person_id)")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "persons_of_interest").join(table(spark, d, "person").select("person_id", "gender"), "person_id").select("pid", "person_id", "gender").distinct()


@query("SELECT DISTINCT i.pid, coalesce(p.party, 'Okänt') AS party FROM persons_of_interest i LEFT JOIN party p USING (party_id)")
def join_left_default(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "persons_of_interest").select("pid", "party_id").distinct()
    return i.join(table(spark, d, "party"), "party_id", "left").select("pid", F.coalesce("party", F.lit("Okänt")).alias("party"))


@query("SELECT DISTINCT i.pid, p.party_abbrev FROM persons_of_interest i LEFT JOIN party p ON p.party_id = i.party_id AND p.sort_order = 2")
def join_composite(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "persons_of_interest").select("pid", "party_id").distinct()
    return i.join(table(spark, d, "party").where("sort_order = 2"), "party_id", "left").select("pid", "party_abbrev")


@query(
    "SELECT p.party, i.gender_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT person_party_id, person_id, party_id FROM person_party) h JOIN (SELECT DISTINCT person_id, gender_id FROM persons_of_interest) i USING (person_id) JOIN party p USING (party_id) GROUP BY 1, 2"
)
def join_star(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "person_party").select("person_party_id", "person_id", "party_id").distinct()
    i = table(spark, d, "persons_of_interest").select("person_id", "gender_id").distinct()
    return h.join(i, "person_id").join(table(spark, d, "party"), "party_id").groupBy("party", "gender_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT pid, person_id FROM persons_of_interest WHERE person_id IN (SELECT person_id FROM terms_of_office WHERE office_type_id = 2)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "terms_of_office").where("office_type_id = 2").select("person_id")
    return table(spark, d, "persons_of_interest").select("pid", "person_id").distinct().join(t, "person_id", "left_semi").select("pid", "person_id")


@query("SELECT DISTINCT pid, person_id FROM persons_of_interest i WHERE NOT EXISTS (SELECT 1 FROM terms_of_office t WHERE t.person_id = i.person_id)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "terms_of_office").select("person_id")
    return table(spark, d, "persons_of_interest").select("pid", "person_id").distinct().join(t, "person_id", "left_anti").select("pid", "person_id")


@query("SELECT DISTINCT i.pid, coalesce(p.party_abbrev, '?') AS party_abbrev, CASE i.gender_id WHEN 1 THEN 'man' WHEN 2 THEN 'woman' ELSE 'unknown' END AS gender FROM persons_of_interest i LEFT JOIN party p USING (party_id)")
def join_codecs(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "persons_of_interest").select("pid", "party_id", "gender_id").distinct()
    gender: Callable[[Column], Column] = lambda c: F.when(c == 1, "man").when(c == 2, "woman").otherwise("unknown")
    return apply_codecs(i, [Codec("party_id", "party_abbrev", table(spark, d, "party"), "party_id", "party_abbrev", default="?"), Codec("gender_id", "gender", function=gender)], drop=True)


_ANY = """WITH p AS (SELECT DISTINCT pid, person_id, wiki_id FROM persons_of_interest), k AS (SELECT b, k, min(pid) AS pid FROM (SELECT 'w' AS b, wiki_id AS k, pid FROM p UNION ALL SELECT 'p', person_id, pid FROM p UNION ALL SELECT 'i', CAST(pid AS VARCHAR), pid FROM p) GROUP BY 1, 2),
s AS (SELECT DISTINCT who FROM protocol_segments), r AS (SELECT s.who, coalesce(k.pid, 0) AS pid FROM s LEFT JOIN k ON k.k = s.who AND k.b = CASE WHEN regexp_matches(who, '^[0-9]+$') THEN 'i' WHEN who LIKE 'Q%' THEN 'w' ELSE 'p' END)"""


@query(_ANY + " SELECT who, pid FROM r")
def resolve_person_ids(spark: SparkSession, d: str) -> DataFrame:
    return any_person(table(spark, d, "protocol_segments").select("who").distinct(), "who", table(spark, d, "persons_of_interest"))


@query(_ANY + ", g AS (SELECT pid, min(gender_id) AS gender_id, min(party_id) AS party_id FROM persons_of_interest GROUP BY 1) SELECT r.who, r.pid, CAST(coalesce(g.gender_id, 0) AS BIGINT) AS gender_id, CAST(coalesce(g.party_id, 0) AS BIGINT) AS party_id FROM r LEFT JOIN g ON g.pid = r.pid")
def person_overload(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").select("who").distinct()
    return _big(overload_by_person(s, table(spark, d, "persons_of_interest")), "gender_id", "party_id")


_EV = "ev AS (SELECT DISTINCT who AS person_id, year FROM protocol_segments WHERE who IS NOT NULL AND year IS NOT NULL)"
_PP = "pp AS (SELECT person_id, party_id, start_year, end_year, row_number() OVER (PARTITION BY person_id ORDER BY person_party_id) AS rn FROM (SELECT DISTINCT person_party_id, person_id, party_id, start_year, end_year FROM person_party))"
_TO = "tt AS (SELECT person_id, office_type_id, start_year, end_year, row_number() OVER (PARTITION BY person_id ORDER BY terms_of_office_id) AS rn FROM (SELECT DISTINCT terms_of_office_id, person_id, office_type_id, start_year, end_year FROM terms_of_office))"
_PARTY_AT = "SELECT ev.person_id, ev.year, CAST(coalesce(arg_min(pp.party_id, (CASE WHEN start_year IS NULL OR end_year IS NULL THEN 1 ELSE 0 END, rn)), 0) AS BIGINT) AS party_id FROM ev LEFT JOIN pp ON pp.person_id = ev.person_id AND coalesce(start_year, 0) <= year AND year <= coalesce(end_year, 9999) GROUP BY 1, 2"
_OFFICE_AT = "SELECT ev.person_id, ev.year, CAST(coalesce(arg_min(office_type_id, rn) FILTER (WHERE coalesce(start_year, 0) <= year AND year <= coalesce(end_year, 9999)), arg_max(office_type_id, rn), 0) AS BIGINT) AS office_type_id FROM ev LEFT JOIN tt ON tt.person_id = ev.person_id GROUP BY 1, 2"


def _history(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "person_party").select("person_party_id", "person_id", "party_id", "start_year", "end_year").distinct()
    return with_sequence(h, ["person_id"], ["person_party_id"]).drop("person_party_id")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "terms_of_office").select("terms_of_office_id", "person_id", "office_type_id", "start_year", "end_year").distinct()
    return with_sequence(t, ["person_id"], ["terms_of_office_id"]).drop("terms_of_office_id")


def _who_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "protocol_segments").select(F.col("who").alias("person_id"), "year").distinct()


@query(f"WITH {_EV}, {_PP} {_PARTY_AT}")
def asof_party(spark: SparkSession, d: str) -> DataFrame:
    return _big(party_at(_who_years(spark, d), _history(spark, d)), "party_id")


@query(f"WITH {_EV}, {_TO} {_OFFICE_AT}")
def asof_office(spark: SparkSession, d: str) -> DataFrame:
    return _big(office_at(_who_years(spark, d), _terms(spark, d)), "office_type_id")


@query(
    f"WITH {_EV}, {_PP}, {_TO}, a AS ({_PARTY_AT}), b AS ({_OFFICE_AT}), i AS (SELECT DISTINCT person_id, gender_id, nullif(party_id, 0) AS fixed FROM persons_of_interest) "
    "SELECT i.person_id, a.year, i.gender_id, CAST(coalesce(i.fixed, a.party_id) AS BIGINT) AS party_id, b.office_type_id FROM i JOIN a ON a.person_id = i.person_id JOIN b ON b.person_id = a.person_id AND b.year = a.year"
)
def speaker_enrich(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").select("who", "year").distinct()
    i = table(spark, d, "persons_of_interest").select("person_id", "name", "gender_id", "party_id").distinct()
    return _big(speakers(s, i, _history(spark, d), _terms(spark, d)).drop("name"), "party_id", "office_type_id")


@query("SELECT who, CAST(count(DISTINCT u_id) AS BIGINT) AS n_segments FROM protocol_segments WHERE who IS NULL OR who NOT IN (SELECT person_id FROM persons_of_interest WHERE person_id IS NOT NULL) GROUP BY 1")
def speakers_unknown(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments").select("u_id", "who").distinct()
    return unknown_speakers(s, table(spark, d, "persons_of_interest"))


@query(
    "WITH u AS (SELECT DISTINCT u_id, speaker_note_id FROM protocol_segments WHERE who = 'unknown'), n AS (SELECT speaker_note_id, lower(regexp_extract(speaker_note, '[(\\[]([A-Za-zÅÄÖåäö]{2})\\.?[)\\]]', 1)) AS a FROM speaker_notes) "
    "SELECT u.u_id, p.party_id FROM u JOIN n USING (speaker_note_id) JOIN party p ON lower(p.party_abbrev) = n.a"
)
def unknown_party_by_note(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "protocol_segments").where("who = 'unknown'").select("u_id", "speaker_note_id").distinct()
    n = table(spark, d, "speaker_notes").select("speaker_note_id", F.lower(F.regexp_extract("speaker_note", r"[(\[]([A-Za-zÅÄÖåäö]{2})\.?[)\]]", 1)).alias("a"))
    p = table(spark, d, "party").select("party_id", F.lower("party_abbrev").alias("a"))
    return u.join(n, "speaker_note_id").join(p, "a").select("u_id", "party_id")


@query("WITH t AS (SELECT DISTINCT terms_of_office_id, person_id, start_year, end_year FROM terms_of_office WHERE start_year <= end_year) SELECT CAST(y AS BIGINT) AS year, CAST(count(DISTINCT person_id) AS BIGINT) AS n_persons FROM (SELECT person_id, unnest(range(start_year, end_year + 1)) AS y FROM t) GROUP BY 1")
def years_expand(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "terms_of_office").where("start_year <= end_year AND person_id IS NOT NULL").select("person_id", "start_year", "end_year").distinct()
    y = t.select("person_id", F.explode(F.sequence("start_year", "end_year")).alias("year")).distinct()
    return _big(y.groupBy("year").agg(F.count("*").alias("n_persons")), "year")


@query(
    "WITH t AS (SELECT *, lead(start_date) OVER (PARTITION BY person_id ORDER BY start_date, terms_of_office_id) AS nxt FROM (SELECT DISTINCT terms_of_office_id, person_id, start_date, end_date FROM terms_of_office WHERE start_date IS NOT NULL AND end_date IS NOT NULL)) "
    "SELECT terms_of_office_id, CAST(nxt - end_date AS BIGINT) AS days_to_next FROM t WHERE nxt IS NOT NULL"
)
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "terms_of_office").where("start_date IS NOT NULL AND end_date IS NOT NULL").select("terms_of_office_id", "person_id", "start_date", "end_date").distinct()
    nxt = F.lead("start_date").over(W.partitionBy("person_id").orderBy("start_date", "terms_of_office_id"))
    return _big(t.withColumn("nxt", nxt).where("nxt IS NOT NULL").select("terms_of_office_id", F.datediff("nxt", "end_date").alias("days_to_next")), "days_to_next")


# ------------------------------------------------------------------ code tables, aggregates, sets


@query("SELECT 0 AS place_id, 'unknown' AS place UNION ALL SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER), p FROM (SELECT DISTINCT gender AS p FROM person WHERE gender IS NOT NULL)")
def code_table_keys(spark: SparkSession, d: str) -> DataFrame:
    return code_table(table(spark, d, "person"), "gender", "place_id", "place")


@query("WITH m AS (SELECT max(party_id) AS m FROM party) SELECT CAST(m.m + row_number() OVER (ORDER BY g) AS INTEGER) AS role_id, g AS role FROM (SELECT DISTINCT gender AS g FROM person WHERE gender IS NOT NULL), m")
def role_offset_keys(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "party").agg(F.max("party_id")).first()[0] or 0
    roles = table(spark, d, "person").select(F.col("gender").alias("role")).where("role IS NOT NULL").distinct()
    return numbered(roles, "role_id", "role", offset=top).select("role_id", "role")


@query("SELECT DISTINCT district_id, sub_office_type_id FROM terms_of_office")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms_of_office").select("district_id", "sub_office_type_id").distinct()


@query("SELECT person_id, CAST(count(DISTINCT party_id) AS BIGINT) AS n_parties FROM person_party WHERE person_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT party_id) > 1")
def having_multi(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "person_party").where("person_id IS NOT NULL").groupBy("person_id").agg(F.count_distinct("party_id").alias("n_parties"))
    return p.where("n_parties > 1")


@query("SELECT person_id, max(CASE WHEN end_date IS NULL THEN party_id END) AS open_party, max(party_id) AS any_party FROM person_party GROUP BY 1")
def conditional_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person_party").groupBy("person_id").agg(F.max(F.when(F.col("end_date").isNull(), F.col("party_id"))).alias("open_party"), F.max("party_id").alias("any_party"))


@query("SELECT person_id, strftime(max(recorded_at), '%Y-%m-%d %H:%M:%S') AS last_recorded, strftime(max(start_date), '%Y-%m-%d') AS last_start FROM terms_of_office GROUP BY 1")
def group_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms_of_office").groupBy("person_id").agg(F.date_format(F.max("recorded_at"), "yyyy-MM-dd HH:mm:ss").alias("last_recorded"), F.date_format(F.max("start_date"), "yyyy-MM-dd").alias("last_start"))


@query("SELECT u_id, CAST(count(*) AS BIGINT) AS n_rows FROM protocol_segments GROUP BY 1 HAVING count(*) > 1")
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(table(spark, d, "protocol_segments"), ["u_id"])


@query("SELECT person_id, string_agg(CAST(party_id AS VARCHAR), ',' ORDER BY start_date NULLS FIRST, person_party_id) AS parties FROM (SELECT DISTINCT person_id, party_id, start_date, person_party_id FROM person_party WHERE party_id IS NOT NULL) GROUP BY 1")
def party_records(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "person_party").where("party_id IS NOT NULL").select("person_id", "start_date", "person_party_id", "party_id").distinct()
    r = records(h, "person_id")
    return r.select("person_id", F.array_join(F.transform("records", lambda x: x["party_id"].cast("string")), ",").alias("parties"))


@query("SELECT person_id FROM terms_of_office UNION SELECT person_id FROM person_party")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms_of_office").select("person_id").union(table(spark, d, "person_party").select("person_id")).distinct()


@query("SELECT 'term' AS kind, person_id FROM terms_of_office UNION ALL SELECT 'party', person_id FROM person_party")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terms_of_office").select(F.lit("term").alias("kind"), "person_id").union(table(spark, d, "person_party").select(F.lit("party"), "person_id"))


@query("SELECT person_id FROM persons_of_interest EXCEPT SELECT person_id FROM terms_of_office")
def except_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "persons_of_interest").select("person_id").subtract(table(spark, d, "terms_of_office").select("person_id"))


@query("SELECT person_id FROM persons_of_interest INTERSECT SELECT person_id FROM terms_of_office")
def intersect_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "persons_of_interest").select("person_id").intersect(table(spark, d, "terms_of_office").select("person_id"))


@query(
    "WITH n AS (SELECT person_id, max(gender) AS gender, max(born) AS born FROM person GROUP BY 1), o AS (SELECT DISTINCT pid, person_id, 'unknown' AS gender, CAST(year_of_birth AS VARCHAR) AS born FROM persons_of_interest) "
    "SELECT o.pid, o.person_id, CASE WHEN n.person_id IS NOT NULL THEN n.gender ELSE o.gender END AS gender, CASE WHEN n.person_id IS NOT NULL THEN n.born ELSE o.born END AS born FROM o LEFT JOIN n ON n.person_id = o.person_id"
)
def upsert_build(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "persons_of_interest").select("pid", "person_id", F.lit("unknown").alias("gender"), F.col("year_of_birth").cast("string").alias("born")).distinct()
    return upsert(old, table(spark, d, "person").select("person_id", "gender", "born"), "person_id", ["gender", "born"])


@query(
    "WITH h AS (SELECT person_id, count(DISTINCT party_id) AS n, max(party_id) AS p FROM person_party GROUP BY 1) SELECT DISTINCT i.pid, coalesce(h.n > 1, false) AS has_multiple_parties, CASE WHEN h.n = 1 THEN h.p ELSE i.party_id END AS party_id FROM persons_of_interest i LEFT JOIN h ON h.person_id = i.person_id"
)
def single_party_update(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "persons_of_interest").select("pid", "person_id", "party_id").distinct()
    return with_single_party(i, table(spark, d, "person_party").select("person_id", "party_id")).select("pid", "has_multiple_parties", "party_id")


@query("SELECT DISTINCT terms_of_office_id, strftime(CASE WHEN end_date < start_date THEN NULL ELSE end_date END, '%Y-%m-%d') AS end_date, coalesce(district_id, 0) AS district_id FROM terms_of_office")
def update_case(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "terms_of_office")
    return t.select("terms_of_office_id", F.date_format(F.when(F.col("end_date") < F.col("start_date"), None).otherwise(F.col("end_date")), "yyyy-MM-dd").alias("end_date"), F.coalesce("district_id", F.lit(0)).alias("district_id")).distinct()


@query("SELECT CAST(range AS INTEGER) AS year FROM range(1867, 2031)")
def year_series(spark: SparkSession, d: str) -> DataFrame:
    return years(spark)


# ------------------------------------------------------------------ quality, subsets, exports


@query("SELECT 'terms_of_office.person_id' AS name, CAST(sum(n) AS BIGINT) AS n_rows, string_agg(person_id, ', ' ORDER BY person_id) AS missing FROM (SELECT person_id, count(*) AS n FROM terms_of_office t WHERE person_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM persons_of_interest i WHERE i.person_id = t.person_id) GROUP BY 1) HAVING sum(n) > 0")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    return foreign_key_violations(table(spark, d, "terms_of_office"), "person_id", table(spark, d, "persons_of_interest"), "person_id", "terms_of_office.person_id")


@query("WITH w AS (SELECT DISTINCT who AS person_id FROM protocol_segments WHERE protocol_name LIKE '%-fk-%') SELECT DISTINCT terms_of_office_id, person_id FROM terms_of_office WHERE person_id IN (SELECT person_id FROM w WHERE person_id IS NOT NULL)")
def subset_of_chamber(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "protocol_segments").select("protocol_name", "who")
    p = u.where(F.col("protocol_name").contains("-fk-")).select("protocol_name")
    return corpus_subset({"terms": table(spark, d, "terms_of_office").select("terms_of_office_id", "person_id").distinct()}, u, p)["terms"].select("terms_of_office_id", "person_id")


@query("SELECT DISTINCT protocol_name FROM protocol_segments p WHERE NOT EXISTS (SELECT 1 FROM protocol_segments q WHERE q.protocol_name = p.protocol_name AND q.n_tokens > 120)")
def protocols_without_long_speech(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "protocol_segments")
    return empty_protocols(s.select("protocol_name").distinct(), s.where("n_tokens > 120"))


_ROWS = "string_agg(token || chr(9) || lemma || chr(9) || pos, chr(10) ORDER BY tok_idx) || chr(10)"


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    t = token_table(spark, d).groupBy(F.col("document_id").alias("u_id")).agg(F.sort_array(F.collect_list(F.struct("tok_idx", F.concat_ws("\t", "token", "lemma", "pos").alias("x")))).alias("r"))
    t = t.select("u_id", F.concat(F.lit("token\tlemma\tpos\n"), F.array_join(F.transform("r", lambda x: x["x"]), "\n"), F.lit("\n")).alias("annotation"))
    return utterances(spark, d).join(t, "u_id", "left").withColumn("date", F.col("year").cast("string"))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(
    "WITH " + _U + ", " + _T.split("FROM protocol_segments),\n", 1)[1] + f""",
an AS (SELECT document_id, {_ROWS} AS rows FROM t GROUP BY 1),
v AS (SELECT u.protocol_name, u.u_idx, u.u_id, u.year, '<utterance id="' || u.u_id || '" page_number="' || coalesce(CAST(page_number AS VARCHAR), '') || '" who="' || who || '">' || chr(10) || {_ESC.format("coalesce(rows, '')")} || '</utterance>' || chr(10) AS x FROM u LEFT JOIN an ON an.document_id = u.u_id)
SELECT protocol_name, '<protocol title="' || protocol_name || '" date="' || coalesce(CAST(min(year) AS VARCHAR), '') || '" chamber="' || (CASE WHEN protocol_name LIKE '%-fk-%' THEN 'fk' WHEN protocol_name LIKE '%-ak-%' THEN 'ak' ELSE 'ek' END) || '">' || chr(10) || string_agg(x, chr(10) ORDER BY u_idx, u_id) || chr(10) || '</protocol>' AS value FROM v GROUP BY protocol_name"""
)
def vrt_export(spark: SparkSession, d: str) -> DataFrame:
    return vrt(_annotated(spark, d), ("protocol", "utterance"))


@query()
def vrt_speeches(spark: SparkSession, d: str) -> DataFrame:
    return vrt(_annotated(spark, d), ("protocol", "speech", "utterance"))


@query()
def xml_export(spark: SparkSession, d: str) -> DataFrame:
    s = speeches(utterances(spark, d, "data"), "chain").withColumn("date", F.lit(None).cast("string"))
    return protocol_xml(s)


@query("WITH s AS (SELECT DISTINCT u_id, year FROM protocol_segments) SELECT u_id, coalesce(CAST(year - year % 5 AS VARCHAR) || '-' || CAST(year - year % 5 + 4 AS VARCHAR), 'none') AS period FROM s")
def period_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "protocol_segments").select("u_id", period("year", "lustrum", F.lit("none")).alias("period")).distinct()
