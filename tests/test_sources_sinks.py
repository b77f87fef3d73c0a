"""Documents in, exports out."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from plenumspark.sinks import markup, writers
from plenumspark.sources import files, parlaclarin

XML = """<?xml version="1.0" encoding="utf-8"?>
<teiCorpus xmlns="http://www.tei-c.org/ns/1.0"><teiHeader/><TEI><teiHeader/><text>
<front><div type="preface"><head>prot_1958_ak_7</head><docDate when="1958-03-01">1958</docDate></div></front>
<body><div>
<pb n="https://data.riksdagen.se/x.pdf#page=1"/>
<note type="speaker" xml:id="s-1">Herr OLLE
  (s):</note>
<u xml:id="u-1" who="olle" next="u-2"><seg>  Hej
   du </seg><seg>Två &amp; tre</seg></u>
<note>annat</note>
<u xml:id="u-2" who="olle" prev="u-1"><seg>mer</seg></u>
<pb/>
<u xml:id="u-3"><seg>okänd</seg></u>
</div></body></text></TEI></teiCorpus>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "1958").mkdir()
    (d / "1958" / "prot-1958--ak--007.xml").write_text(XML, encoding="utf-8")
    (d / "1958" / "prot-1959--ak--001.xml").write_text(XML.replace("u-", "v-"), encoding="utf-8")
    (d / "1958" / "prot-1959--ak--002.xml").write_text("<broken", encoding="utf-8")
    (d / "1958" / "prot-1959--ak--003.xml").write_text("", encoding="utf-8")
    return d


def test_documents(spark, folder):
    e = parlaclarin.read_elements(spark, str(folder), years="1958")
    u = parlaclarin.utterances(e).orderBy("u_idx").collect()
    assert [(r["u_id"], r["who"], r["prev_id"], r["page_number"], r["speaker_note_id"]) for r in u] == [("u-1", "olle", None, 2, "s-1"), ("u-2", "olle", "u-1", 2, "s-1"), ("u-3", "unknown", None, 3, "missing")]
    assert u[0]["paragraphs"] == ["Hej\ndu", "Två & tre"] and u[0]["year"] == 1958
    p = parlaclarin.protocols(e).first()
    assert (p["protocol_name"], p["document_name"], p["date"], p["chamber_abbrev"]) == ("prot-1958-ak-007", "prot-1958--ak--007", "1958-03-01", "ak")
    assert parlaclarin.speaker_notes(e).first()["speaker_note"] == "Herr OLLE (s):"


def test_corpus_index(spark, folder):
    t = parlaclarin.corpus_index(parlaclarin.read_elements(spark, str(folder)))
    assert {k: v.count() for k, v in t.items()} == {"protocols": 2, "utterances": 6, "speaker_notes": 1, "page_references": 4, "source_references": 2, "speeches": 4, "empty_protocols": 0}


def test_listing(spark, folder):
    i = files.source_index(spark, str(folder), "*.xml")
    assert i.count() == 3 and files.source_index(spark, str(folder), "*.xml", years="1959").count() == 2
    assert files.protocol_files(spark, str(folder)).count() == 3
    assert {r["subfolder"] for r in i.collect()} == {"1958"}


def test_manifest(spark, tmp_path):
    docs = spark.createDataFrame([("ak", "1958", "prot-1.xml"), ("ak", "1958", "prot-2.xml")], "chamber string, folder string, document string")
    (tmp_path / "prot-ak.xml").write_text(parlaclarin.manifest_lines(docs).first()["value"])
    m = parlaclarin.read_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, m.collect())) == [("ak", "1958/prot-1.xml"), ("ak", "1958/prot-2.xml")]
    assert parlaclarin.chamber_index(m).first()["protocols"] == ["prot-1", "prot-2"]
    (tmp_path / "prot-zz.xml").write_text('<xi:include href="a.xml"/>')
    with pytest.raises(Exception, match="unknown chamber"):
        parlaclarin.read_manifest(spark, str(tmp_path)).collect()


def test_archives_round_trip(spark, folder, tmp_path):
    u = parlaclarin.utterances(parlaclarin.read_elements(spark, str(folder), years="1958")).withColumn("annotation", F.lit("token\tpos\na\tNN\n"))
    assert writers.write_tagged_archives(u, str(tmp_path)) == 1
    (tmp_path / "bad.zip").write_text("no archive")
    back = files.read_tagged(spark, str(tmp_path)).orderBy("u_idx").collect()
    assert [r["u_id"] for r in back] == ["u-1", "u-2", "u-3"] and back[0]["paragraphs"] == ["Hej\ndu", "Två & tre"] and back[0]["date"] == "1958-03-01"


def test_delimited_utterances(spark, tmp_path):
    (tmp_path / "u.csv").write_text('u_id\twho\tprev_id\tnext_id\tparagraphs\tannotation\tpage_number\tspeaker_note_id\nu-1\tolle\t\t\t"a \\"b\\"@#@c"\t\t4\ts-1\n')
    r = files.read_utterance_csv(spark, str(tmp_path / "u.csv")).first()
    assert r["paragraphs"] == ['a "b"', "c"] and r["page_number"] == 4
    (tmp_path / "p.txt").write_text("prot-1\nprot-*\n\n")
    assert sorted(x["pattern"] for x in files.read_patterns(spark, str(tmp_path / "p.txt")).collect()) == ["prot-*", "prot-1.zip"]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("1950-1954", "a.txt", "En"), ("1950-1954", "b.txt", None), ("1960-1964", "c.txt", "Tre")], "period string, filename string, data string")


def test_writers(spark, items, tmp_path):
    assert writers.write_folder(items, str(tmp_path / "f"), lower=True, packed=True) == 3
    assert gzip.decompress((tmp_path / "f" / "a.txt.gz").read_bytes()) == b"en"
    assert writers.write_zip(items, str(tmp_path / "x.zip")) == 3
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.namelist() == ["a.txt", "b.txt", "c.txt", "document_index.csv"] and z.read("c.txt") == b"Tre"
    assert writers.write_zip_per_period(items, str(tmp_path / "p")) == 3
    with zipfile.ZipFile(tmp_path / "p" / "1950" / "1950-1954.zip") as z:
        assert len(z.namelist()) == 3
    writers.write_partitioned(items, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).where("period = '1960-1964'").count() == 1
    writers.write_index(writers.document_index(items, ["filename"]), str(tmp_path / "i"))
    assert [r["document_id"] for r in spark.read.parquet(str(tmp_path / "i.parquet")).orderBy("filename").collect()] == [0, 1, 2]
    counts = spark.createDataFrame([("a", 1), ("b", 3)], "word string, n long")
    writers.write_word_counts(counts, str(tmp_path / "w"), 1)
    assert files.read_word_counts(spark, str(tmp_path / "w")).count() == 1
    with pytest.raises(ValueError):
        writers.writer("nowhere")
    with pytest.raises(ValueError):
        writers.compression("rar")


def test_file_names(spark):
    df = spark.createDataFrame([("1950", "?", "Kvinna")], "p string, a string, b string")
    assert df.select(writers.item_filename(F.col("p"), [F.col("a"), F.col("b")])).first()[0] == "1950_unknown_Kvinna.txt"
    assert df.select(writers.speech_filename(F.col("p"), [F.col("b")], F.lit("Ove Öst"), F.lit("i-1"))).first()[0] == "1950_kvinna_ove-öst_i-1".replace("_ove", "_ove")


def test_vertical_text(spark):
    u = spark.createDataFrame(
        [("prot-1", 0, "u-1", "a", None, None, "s", 1, "1958", "token\tpos\n<x>\tNN\n"), ("prot-1", 1, "u-2", "a", "u-1", None, "s", 1, "1958", None)],
        "protocol_name string, u_idx int, u_id string, who string, prev_id string, next_id string, speaker_note_id string, page_number int, date string, annotation string",
    )
    v = markup.vrt(u).first()["value"]
    assert v.startswith('<protocol title="prot-1" date="1958" chamber="ek">\n<speech id="u-1" title="prot-1_001"') and "&lt;x&gt;\tNN\n</utterance>" in v and v.endswith("</speech>\n</protocol>")
    with pytest.raises(NotImplementedError):
        markup.vrt(u, ("sentence",))


def test_protocol_markup(spark):
    s = spark.createDataFrame([("p", 1, "u-1", "a", "1958", "x & y"), ("q", 1, "u-2", "a", "1958", "")], "protocol_name string, speech_index int, speech_id string, who string, date string, text string")
    x = {r["protocol_name"]: r["value"] for r in markup.protocol_xml(s).collect()}
    assert "x &amp; y" in x["p"] and x["q"] == ""
    assert "<![CDATA[x & y]]>" in markup.protocol_xml(s, cdata=True).where("protocol_name = 'p'").first()["value"]
    assert markup.protocol_text(s).where("protocol_name = 'p'").first()["value"].startswith('### <protocol name="p"')
