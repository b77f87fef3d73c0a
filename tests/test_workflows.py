"""Pipelines from documents to exports, and the command line."""

import os
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plenumspark import workflows
from plenumspark.__main__ import main, read_options
from plenumspark.sinks.writers import FRAME_TARGETS, write_tagged_archives, writer
from plenumspark.sources.files import read_tables
from plenumspark.sources.parlaclarin import read_elements, utterances

XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><front><div><docDate when="{year}-03-01"/></div></front><body><div>
<note type="speaker" xml:id="s-{year}">Herr A:</note><u xml:id="u-{year}-1" who="a" next="u-{year}-2"><seg>Ett binde-
streck här.</seg></u><u xml:id="u-{year}-2" who="a" prev="u-{year}-1"><seg>  Två ord.</seg></u><u xml:id="u-{year}-3" who="b"><seg>Tre.</seg></u></div></body></text></TEI>"""


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    for year in (1957, 1958, 1961):
        (d / f"prot-{year}--ak--001.xml").write_text(XML.format(year=year), encoding="utf-8")
    return str(d)


@pytest.fixture(scope="module")
def metadata(spark):
    return {
        "persons_of_interest": spark.createDataFrame([("a", "Aa", 1, None), ("b", "Bb", 2, 3)], "person_id string, name string, gender_id int, party_id int"),
        "person_party": spark.createDataFrame([("a", 7, 1950, 1960, 1)], "person_id string, party_id int, start_year int, end_year int, rn int"),
        "terms_of_office": spark.createDataFrame([("a", 1, 1950, 1960, 1)], "person_id string, office_type_id int, start_year int, end_year int, rn int"),
    }


def test_text(spark, source, metadata, tmp_path):
    tf = spark.createDataFrame([("bindestreck", 5)], "word string, n long")
    s = workflows.text_segments(spark, source, metadata=metadata, frequencies=tf, preprocess=["dedent"]).orderBy("name").collect()
    assert len(s) == 6 and s[0]["data"] == "Ett bindestreck här. Två ord." and (s[0]["party_id"], s[0]["office_type_id"], s[1]["party_id"]) == (7, 1, 3)
    assert s[4]["party_id"] == 0
    n = workflows.extract_text(spark, source, str(tmp_path / "t"), temporal="decade", keys=["gender_id"], metadata=metadata)
    assert n == 4 and (tmp_path / "t" / "1950-1959_1.txt").exists()
    assert workflows.extract_text(spark, source, str(tmp_path / "z"), target_type="checkpoint-per-group", years="1957-1958") == 4
    with pytest.raises(ValueError):
        workflows.preprocessed(spark.createDataFrame([("a",)], "data string"), ["nothing"])


def test_tagged(spark, source, tmp_path):
    u = utterances(read_elements(spark, source)).withColumn("annotation", F.lit("token\tlemma\tpos\nEtt\tett\tRG\nord\tord\tNN\n.\t.\tMAD\n"))
    assert write_tagged_archives(u, str(tmp_path / "a")) == 3
    got = workflows.extract_tagged(spark, str(tmp_path / "a"), str(tmp_path / "o"), skip_punctuation=True)
    assert got == {"documents": 6, "tokens": 18}
    assert {r["token"] for r in spark.read.parquet(str(tmp_path / "o" / "token2id")).collect()} == {"ett", "ord"}
    workflows.export_vrt(spark, str(tmp_path / "a"), str(tmp_path / "v"), years="1957")
    assert os.listdir(tmp_path / "v")


@pytest.mark.parametrize(
    ("target", "kind"),
    [(t, "parquet") for t in FRAME_TARGETS] + [("single-id-tagged-frame-per-group", "feather"), ("single-tagged-frame", "lzma"), ("single-tagged-frame-per-group", "zip"), ("single-id-tagged-frame-per-group", "gzip")],
)
def test_frame_targets(spark, source, metadata, tmp_path, target, kind):
    """Every target and kind of file holds the same tokens; groups are folders, each with its part of the index."""
    u = utterances(read_elements(spark, source)).withColumn("annotation", F.lit("token\tlemma\tpos\nEtt\tett\tRG\nord\tord\tNN\n"))
    write_tagged_archives(u, str(tmp_path / "a"))
    got = workflows.extract_tagged(spark, str(tmp_path / "a"), str(tmp_path / "o"), target_type=target, keys=["gender_id"], metadata=metadata, kind=kind, temporal="decade")
    assert got["documents"] == 6 and got["tokens"] == 2 * u.count()
    frames = tmp_path / "o" / "frames"
    parts = [p for p in frames.rglob("*") if p.is_file() and p.name.startswith("part-")]
    if kind in ("feather", "lzma", "zip"):
        read = [pd.read_feather(p) if kind == "feather" else pd.read_csv(p, sep="\t") for p in parts]
        rows = sum(map(len, read))
        columns = set(read[0].columns)
    else:
        df = spark.read.parquet(str(frames)) if kind == "parquet" else spark.read.csv(str(frames), sep="\t", header=True)
        rows, columns = df.count(), set(df.columns)
    assert rows == got["tokens"] and (("token_id" in columns) == ("-id-" in target)) and (("token" in columns) == ("-id-" not in target))
    grouped = target.endswith("per-group")
    assert all(("period=" in str(p) and "gender_id=" in str(p)) == grouped for p in parts)
    assert (tmp_path / "o" / "document_index_by_group").exists() == grouped and (tmp_path / "o" / "token2id").exists() == ("-id-" in target)


@pytest.mark.parametrize(("level", "documents"), [("protocol", 3), ("who", None), ("utterance", None)])
def test_frame_levels(spark, source, tmp_path, level, documents):
    u = utterances(read_elements(spark, source)).withColumn("annotation", F.lit("token\tlemma\tpos\nEtt\tett\tRG\n"))
    write_tagged_archives(u, str(tmp_path / "a"))
    got = workflows.extract_tagged(spark, str(tmp_path / "a"), str(tmp_path / "o"), level=level)
    want = {"who": u.select("protocol_name", "who").distinct().count(), "utterance": u.count()}.get(level, documents)
    assert got == {"documents": want, "tokens": u.count()}
    with pytest.raises(ValueError):
        workflows.extract_tagged(spark, str(tmp_path / "a"), str(tmp_path / "o"), level="other")


def test_sorted_speeches(spark, tmp_path):
    items = spark.createDataFrame([("b_001", "Två ord.", "i-2", "Bo Ek"), ("a_001", "Ett ord till", "i-1", None), ("a_002", None, None, None)], "name string, data string, who string, speaker string")
    assert writer("sorted-speeches-in-zip")(items, str(tmp_path / "s.zip")) == 3
    with zipfile.ZipFile(tmp_path / "s.zip") as z:
        names = z.namelist()
        index = z.read("document_index.csv").decode().splitlines()
    assert names == ["a_001_i-1.txt", "a_002_.txt", "b_001_bo-ek_i-2.txt", "document_index.csv"] or names[:-1] == sorted(names[:-1])
    at = index[0].split("\t").index("n_tokens")
    assert [r.split("\t")[at] for r in index[1:]] == ["3", "0", "2"]


def test_options_and_tables(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"level": "who", "a.b": 1, "a": {"c": 2}}')
    assert read_options(str(tmp_path / "o.json"), {"PLENUM_A__B": "[3]", "PLENUM_LEVEL": "speech", "HOME": "x"})["level"] == "speech"
    assert read_options(str(tmp_path / "o.json"), {})["level"] == "who"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.csv").write_text("a,b\n1,x\n")
    with zipfile.ZipFile(tmp_path / "t" / "more.zip", "w") as z:
        z.writestr("d/two.csv", "a,b\n2,y\n3,z\n")
    got = read_tables(spark, str(tmp_path / "t"))
    assert {n: sorted(map(tuple, df.collect())) for n, df in got.items()} == {"one": [("1", "x")], "two": [("2", "y"), ("3", "z")]}


def test_metadata_index_and_terms(spark, source, metadata, tmp_path):
    workflows.extract_speech_index(spark, source, str(tmp_path / "s"), metadata=metadata)
    assert spark.read.parquet(str(tmp_path / "s.parquet")).count() == 6
    workflows.build_corpus_index(spark, source, str(tmp_path / "i"))
    assert spark.read.csv(str(tmp_path / "i" / "utterances"), sep="\t", header=True).count() == 9
    done = spark.createDataFrame([], "protocol_name string, checksum string")
    assert workflows.tag_changed(spark, source, done, lambda: str.upper, years="1957").count() == 3
    u = utterances(read_elements(spark, source))
    p = spark.createDataFrame([("prot-1957--ak--001",)], "protocol_name string")
    files = spark.createDataFrame([("prot-1957--ak--001", "x"), ("prot-1958--ak--001", "y")], "name string, path string")
    workflows.subset_corpus({"person_party": metadata["person_party"]}, u, p, files, str(tmp_path / "sub"))
    assert spark.read.parquet(str(tmp_path / "sub" / "files")).count() == 1


def test_command_line(spark, source, tmp_path):
    (tmp_path / "o.json").write_text('{"cut_off": 0}')
    main(["terms", source, str(tmp_path / "w"), "--options", str(tmp_path / "o.json"), "--set", "cut_off=2"])
    assert {r["word"] for r in spark.read.parquet(str(tmp_path / "w")).collect()} == {"ett", "binde", "streck", "här", "två", "ord", "tre"}
