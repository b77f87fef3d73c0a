"""Scalar functions against truth tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plenumspark.functions import dates, dehyphen, pos, text, tokenize


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return rows.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "first", "last", "flag"),
    [
        ("2020", dt.date(2020, 1, 1), dt.date(2020, 12, 31), "Y"),
        (None, None, None, "X"),
        ("2023-02", dt.date(2023, 2, 1), dt.date(2023, 2, 28), "M"),
        ("2023-03-24", dt.date(2023, 3, 24), dt.date(2023, 3, 24), "D"),
        ("2023-13-99", None, None, "D"),
        ("abcd", None, None, "Y"),
    ],
)
def test_partial_dates(spark, given, first, last, flag):
    df = spark.createDataFrame([(given,)], "d string").select(dates.partial_date("d"), dates.partial_date("d", extend=True), dates.partial_flag("d"))
    assert tuple(df.first()) == (first, last, flag)


def test_years():
    assert dates.parse_years("1920-1938, 1930-1940,1955") == [(1920, 1940), (1955, 1955)]
    assert dates.parse_years("-5--3") == [(-5, -3)]
    with pytest.raises(ValueError):
        dates.parse_years("1-2-3")


@pytest.mark.parametrize(("key", "want"), [("year", "1957"), ("lustrum", "1955-1959"), ("decade", "1950-1959"), ({"a": (1900, 1956), "b": (1957, 1960)}, "b"), ("1920-1938,1950-1960", "1950-1960"), ("1920-1938", "none")])
def test_periods(spark, key, want):
    assert one(spark, dates.period("y", key, F.lit("none")), y=1957) == want


def test_period_errors_and_nulls(spark):
    with pytest.raises(ValueError):
        dates.period("y", "century")
    df = spark.createDataFrame([(None,)], "y int").select(dates.period("y", "decade", F.lit("none")).alias("p"))
    assert df.first()["p"] == "none"


@pytest.mark.parametrize(("name", "chamber"), [("prot-1945--ak--011", "ak"), ("prot-1945--fk--016_099.xml", "fk"), ("prot-19992000--089", "ek")])
def test_chamber(spark, name, chamber):
    assert one(spark, text.chamber_of("n"), n=name) == chamber


@pytest.mark.parametrize(
    ("name", "label"),
    [("prot-1955--fk--022_003", "Första kammaren 1955:22 003"), ("prot-197879--014", "1978/79:14"), ("prot-19992000--089_001.xml", "1999/2000:89 001"), ("nothing", "nothing")],
)
def test_labels(spark, name, label):
    assert one(spark, text.protocol_label("n"), n=name) == label
    assert spark.createDataFrame([(None,)], "n string").select(text.protocol_label("n")).first()[0] == ""


def test_strings(spark):
    assert one(spark, text.dedent("t"), t="\tapa\n\n  \tapa \t\n") == "apa\n\napa\n"
    assert one(spark, text.slugify("t"), t=" Åsa  Öberg_-x! ") == "asa-oberg_-x"
    assert one(spark, text.slugify("t", True), t="Åsa Öberg") == "åsa-öberg"
    assert one(spark, text.xml_escape("t"), t="a<b & 'c\"") == "a&lt;b &amp; &apos;c&quot;"
    assert one(spark, text.xml_unescape(text.xml_escape("t")), t="&lt; <&>") == "&lt; <&>"
    assert one(spark, text.sanitize("t"), t="Åke 1#") == "Ake_1#"
    assert one(spark, text.zero_fill("n"), n=1234) == "1234"
    assert one(spark, text.require_letter("t"), t="12 3") == ""
    assert one(spark, text.short_checksum(text.join_paragraphs(F.split("t", "@#@"))), t="X@#@Y@#@C") == "6060d006e0494206"
    assert one(spark, text.base_name("t"), t="/a/b/prot-1.x.zip") == "prot-1.x"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Jag heter Ove. Vad heter du?", ["Jag", "heter", "Ove", ".", "Vad", "heter", "du", "?"]),
        ("Det är t.ex.", ["Det", "är", "t.ex."]),
        ("kl. 3,5 (ca)", ["kl.", "3,5", "(", "ca", ")"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, given, want):
    df = spark.createDataFrame([(given,)], "t string").select(tokenize.tokens("t").alias("x"), tokenize.token_spans("t").alias("s"))
    row = df.first()
    assert row["x"] == want
    assert [given[s["start"] : s["end"]] for s in row["s"]] == want


def test_tokens_of_a_very_long_text():
    long = "ord " * 200_000
    assert len(tokenize.words(long)) == 200_000


def test_simple_sentences():
    t = "Jag heter Ove. Det är t.ex. Kalle. Slut"
    assert [t[a:b] for a, b in tokenize.simple_sentences(t)] == ["Jag heter Ove.", "Det är t.ex. Kalle.", "Slut"]
    assert list(tokenize.simple_sentences(" \n")) == []


@pytest.mark.parametrize(
    ("given", "frequencies", "want"),
    [
        ("binde-\nstreck", {"bindestreck": 2, "binde-streck": 1}, "bindestreck"),
        ("binde-\nstreck", {"bindestreck": 1, "binde-streck": 2}, "binde-streck"),
        ("IKEA-\nmöbler", {}, "IKEA-möbler"),
        ("10-\n\ntal", {}, "10-tal"),
        ("sjuk- och hälsovård", {}, "sjuk- och hälsovård"),
        ("a-\nb", {"ab": 1, "a-b": 1}, "a- b"),
        ("ett\n\n\n\ntvå", {}, "ett\n\ntvå"),
    ],
)
def test_dehyphenation(spark, given, frequencies, want):
    tf = spark.createDataFrame(list(frequencies.items()), "word string, n long")
    df = spark.createDataFrame([(1, given), (2, None)], "id int, t string")
    assert dict(map(tuple, dehyphen.dehyphenate(df, "id", "t", tf).collect())) == {1: want, 2: None}


def test_paragraph_merges(spark):
    tf = spark.createDataFrame([], "word string, n long")
    df = spark.createDataFrame([(1, "ett\n\ntvå. \n\nTre")], "id int, t string")
    out = [dehyphen.dehyphenate(df, "id", "t", tf, how=h).first()["t"] for h in (dehyphen.KEEP, dehyphen.MERGE_WORDS, dehyphen.MERGE_ALL)]
    assert out[0].split() == ["ett", "två.", "Tre"] and out[0].count("\n\n") == 2
    assert out[1].startswith("ett två") and out[1].count("\n\n") == 1
    assert "\n\n" not in out[2]


def test_pos_schemes(spark):
    assert [len(pos.scheme(n)) for n in ("SUC", "Universal", "PennTree")] == [25, 20, 53]
    assert one(spark, pos.pos_id(F.col("t")), t="nn") == 10
    assert one(spark, pos.pos_id(F.col("t")), t="??") == pos.UNKNOWN
    assert one(spark, pos.pos_group(F.col("t"), "PennTree"), t=":") == "Delimiter"
    assert pos.all_but(["Delimiter", "|NN|PM|", "VB"]) == [t for t in pos.scheme("SUC") if t not in ("MAD", "MID", "PAD", "NN", "PM", "VB")]
    with pytest.raises(ValueError):
        pos.scheme("none")
    assert pos.scheme_table(spark).count() == 25


def test_tokenizer_rules(spark, tmp_path):
    """A lexicon's tokens stay whole, a configuration file sets the rules, and tokenizers are registered by name."""
    cut = lambda rules, t: [t[a:b] for a, b in rules.spans(t)]
    assert cut(tokenize.Rules(["c/o", "AB:s"]), "c/o AB:s C/O") == ["c/o", "AB:s", "C/O"] and cut(tokenize.RULES, "c/o") == ["c", "/", "o"]
    (tmp_path / "rules").write_text("# tecken\nstart: (\nwithin: )\nend: .\nmulti: -{2,}\nnumber: \\d+,\\d+\nmisc_tag: <\\w+>\n\nabbreviations:\nt.ex\n", encoding="utf-8")
    (tmp_path / "words").write_text("c/o\n", encoding="utf-8")
    rules = tokenize.Rules.load(str(tmp_path / "rules"), str(tmp_path / "words"))
    assert cut(rules, "(c/o) <b>x 3,5 t.ex. ja--nej.") == ["(", "c/o", ")", "<b>", "x", "3,5", "t.ex.", "ja", "--", "nej", "."]
    with pytest.raises(ValueError, match="unknown option"):
        (tmp_path / "bad").write_text("other: 1\n")
        tokenize.Rules.load(str(tmp_path / "bad"))
    tokenize.register_tokenizer("letters", lambda t: [(i, i + 1) for i in range(len(t or ""))])
    row = spark.createDataFrame([("ab",), (None,)], "t string").select(tokenize.tokens("t", "letters").alias("x"), tokenize.pretokenize("t").alias("y")).collect()
    assert [tuple(r) for r in row] == [(["a", "b"], "ab"), ([], "")]
    with pytest.raises(ValueError, match="unknown tokenizer"):
        tokenize.tokens("t", "none")


@pytest.mark.parametrize(
    ("given", "want"),
    [("http://a.se/x#y, a.b@c.se", ["http://a.se/x#y", ",", "a.b@c.se"]), ("ja :) och >:-( :@", ["ja", ":)", "och", ">:-(", ":@"]), ("slut . . . ja", ["slut", ". . .", "ja"]), ("i U.S.A. nu", ["i", "U.S.A.", "nu"]), ("T.ex.", ["T.ex", "."])],
)
def test_special_tokens(given, want):
    assert tokenize.words(given) == want


def test_letters_without_decomposition(spark):
    df = spark.createDataFrame([("Straße Ærø Łódź é",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(text.sanitize("t")).collect()] == ["Strasse_AEro_Lodz_e", "plain", None]
    assert [r[0] for r in df.select(text.slugify("t", True)).collect()] == ["straße-ærø-łódź-é", "plain", None]
