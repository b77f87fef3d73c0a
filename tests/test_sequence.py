"""Sequence merges, segments and attribution on hand-made protocols."""

import pytest
from pyspark.sql import functions as F

from plenumspark.operators import segment, sequence

SCHEMA = "protocol_name string, u_idx int, u_id string, who string, prev_id string, next_id string, speaker_note_id string, page_number int, year int, data string"


def rows(spark, items, name="prot-1958-fake"):
    return spark.createDataFrame([(name, i, u, w, p, n, note, 1, 1958, f"text {u}") for i, (u, w, p, n, note) in enumerate(items)], SCHEMA)


@pytest.fixture(scope="module")
def doc(spark):
    return rows(spark, [
        ("u-1", "olle", None, "u-2", "s-1"), ("u-2", "olle", "u-1", None, "s-1"), ("u-3", "kalle", None, None, "s-2"),
        ("u-4", "unknown", None, None, "missing"), ("u-5", "unknown", None, None, "missing"), ("u-6", "olle", None, None, "s-3"),
    ])


def groups(df, name):
    out: dict[int, list[str]] = {}
    for r in sequence.speech_numbers(df, name).orderBy("u_idx").collect():
        out.setdefault(r["speech_index"], []).append(r["u_id"])
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("who", [["u-1", "u-2", "u-6"], ["u-3"], ["u-4", "u-5"]]),
        ("who_sequence", [["u-1", "u-2"], ["u-3"], ["u-4", "u-5"], ["u-6"]]),
        ("speaker_note_id_sequence", [["u-1", "u-2"], ["u-3"], ["u-4", "u-5"], ["u-6"]]),
        ("who_speaker_note_id_sequence", [["u-1", "u-2"], ["u-3"], ["u-4", "u-5"], ["u-6"]]),
        ("chain", [["u-1", "u-2"], ["u-3"], ["u-4"], ["u-5"], ["u-6"]]),
        ("chain_consecutive_unknowns", [["u-1", "u-2"], ["u-3"], ["u-4", "u-5"], ["u-6"]]),
    ],
)
def test_strategies(doc, name, want):
    assert groups(doc, name) == want


def test_unknowns_of_different_notes_part(spark):
    df = rows(spark, [("u-1", "unknown", None, None, "s-1"), ("u-2", "unknown", None, None, "missing")])
    assert groups(df, "chain_consecutive_unknowns") == [["u-1"], ["u-2"]]


def test_orphans_and_links(spark):
    df = rows(spark, [("u-1", "a", "u-0", None, "s"), ("u-2", "a", None, None, "s"), ("u-3", "a", "u-1", None, "s")])
    assert groups(df, "chain") == [["u-2", "u-3"]]
    assert sequence.orphans_of_chain(df).first()["n_orphans"] == 1
    assert {r["u_id"] for r in sequence.broken_links(df).collect()} == {"u-1", "u-3"}


def test_mixed_chain_is_invalid(spark):
    df = rows(spark, [("u-1", "a", None, "u-2", "s"), ("u-2", "unknown", "u-1", None, "s")])
    assert sequence.invalid_speeches(df, "chain").first()["n_who"] == 2
    with pytest.raises(Exception, match="several speakers"):
        sequence.checked(df, "chain").collect()


def test_unknown_and_custom_strategies(doc):
    with pytest.raises(ValueError):
        sequence.strategy("undefined")
    sequence.register_strategy("all", lambda df: df.withColumn("group_no", F.lit(1)))
    assert len(groups(doc, "all")) == 1


def test_long_protocol_is_cut_into_chunks(spark):
    from plenumspark.operators.runs import number_runs

    df = spark.range(1000).select(F.lit("p").alias("g"), F.col("id").cast("int").alias("i"), F.col("id").cast("string").alias("t"), F.floor(F.col("id") / 7).alias("k"))
    out = number_runs(df, "g", "i", "t", "k", chunk=10).orderBy("i").collect()
    assert [r["run_no"] for r in out] == [i // 7 + 1 for i in range(1000)]
    nulls = df.withColumn("k", F.when(F.col("i") % 20 < 10, None).otherwise(F.col("k")))
    want, last = [], ("start",)
    for r in nulls.orderBy("i").collect():
        want.append((want[-1] if want else 0) + (r["k"] != last))
        last = r["k"]
    assert [r["run_no"] for r in number_runs(nulls, "g", "i", "t", "k", chunk=8).orderBy("i").collect()] == want


def test_sums_and_refinements(doc):
    counts = {n: sequence.speeches(doc, n).agg(F.sum("n_utterances")).first()[0] for n in ("who", "who_sequence", "chain")}
    assert set(counts.values()) == {6}
    assert len(groups(doc, "chain_consecutive_unknowns")) <= len(groups(doc, "chain"))


def test_speech_sizes_keep_numbers(doc):
    s = sequence.speeches(doc.withColumn("data", F.when(F.col("u_id") == "u-3", "").otherwise(F.col("data"))), "chain", skip_size=1)
    assert [r["speech_index"] for r in s.orderBy("speech_index").collect()] == [1, 3, 4, 5]


@pytest.mark.parametrize(("level", "names"), [("protocol", 1), ("who", 3), ("speech", 5), ("utterance", 6), ("paragraph", 6), ("sentence", 6)])
def test_levels(doc, level, names):
    s = segment.segments(doc, level)
    assert s.count() == names and s.columns == segment.COLUMNS


def test_paragraph_names(spark, doc):
    p = segment.segments(doc.where("u_id = 'u-1'").withColumn("data", F.lit("a\nb")), "paragraph").orderBy("name").collect()
    assert [(r["name"], r["id"], r["data"]) for r in p] == [("prot-1958-fake_001_001", "u-1@0", "a"), ("prot-1958-fake_001_002", "u-1@1", "b")]
    assert segment.segments(doc, "utterance", skip_size=8).count() == 0 and segment.segments(doc, "utterance", skip_size=7).count() == 6
    with pytest.raises(ValueError):
        segment.segments(doc, "word")


def test_notes_and_pages(spark):
    e = spark.createDataFrame(
        [
            ("p", 0, "u", "u0", "a", None, None), ("p", 1, "pb", None, None, None, None), ("p", 2, "note", None, None, None, "s1"), ("p", 3, "u", "u1", "a", None, None),
            ("p", 4, "u", "u2", "a", "u1", None), ("p", 5, "u", "u3", "b", None, None), ("p", 6, "u", "u4", "b", "u3", None), ("p", 7, "note", None, None, None, "s2"), ("p", 8, "u", "u5", "b", None, None),
        ],
        "protocol_name string, pos int, tag string, u_id string, who string, prev_id string, note_id string",
    )
    got = {r["u_id"]: r["speaker_note_id"] for r in segment.attribute_notes(e).collect()}
    assert got == {"u0": "missing", "u1": "s1", "u2": "s1", "u3": "missing", "u4": "missing", "u5": "s2"}
    assert [r["page_number"] for r in segment.page_numbers(e).orderBy("pos").collect()] == [1] + [2] * 8


def test_page_references(spark):
    e = spark.createDataFrame(
        [("p", 0, "pb", None, None), ("p", 1, "pb", "7", None), ("p", 2, "pb", "x", None), ("p", 3, "pb", None, "https://kb.se/a/b-012.jp2"), ("p", 4, "pb", "https://data.riksdagen.se/x.pdf#page=3", None)],
        "protocol_name string, pos int, tag string, n string, facs string",
    )
    got = [(r["source_id"], r["page_number"], r["reference"]) for r in segment.page_references(e).orderBy("pos").collect()]
    assert [g[:2] for g in got] == [(0, 0), (0, 7), (0, 8), (1, 12), (2, 3)]
    assert got[4][2] == "x.pdf"


def test_empty(spark, doc):
    none = doc.limit(0)
    for name in ("who", "who_sequence", "chain"):
        assert sequence.speeches(none, name).count() == 0
    for level in segment.LEVELS:
        assert segment.segments(none, level).count() == 0
