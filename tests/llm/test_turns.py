"""Speaker turns: the line parser, labels, settled speakers and runs."""

import random

import pytest

from plenumspark.llm import turns
from plenumspark.llm.transcript import Label, has_speech, parse_label, speech, transcript_turns


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("[kl. 9.15] eh Jag (applåder från läktaren) yrkar hm, bifall.", "Jag yrkar bifall."),
        ("Vi minns (det var år 1956!) att", "Vi minns (det var år 1956!) att"),
        ("01:02:03 {t=12} <49:50> (00.57.26) 2h51m23s", ""),
        ("((harkling)) *hostar* – skratt – [paus] <sorl> Öööh … {buller}", "{}".format("")),
        ("kl. 18.05 och prop. 1957:112", "kl. 18.05 och prop. 1957:112"),
        ("en\n[skratt]\ntvå", "en\ntvå"),
        ("(hörs ej)", ""),
        ("(Appladcr)", ""),
        (None, ""),
        (" \n ", ""),
    ],
)
def test_speech(given, want):
    got = speech(given)
    assert got == want or (want == "" and not any(c.isalnum() for c in got))
    assert has_speech(given) == any(c.isalnum() for c in want)


def test_very_long_speech():
    long = "[paus] eh ord " * 100_000
    assert speech(long).split() == ["ord"] * 100_000


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Herr BRÄNNGREN (Fb):", Label("bränngren", "", "", "fb")),
        ("SÄVGREN, Ragnborg i Östervik (gl.): (forts.)", Label("sävgren", "ragnborg", "östervik", "gl")),
        ("Hr D A L H A G E.", Label("dalhage", "", "", "")),
        ("Anf. 71 RAGNVALD HEDSTAM, rv replik –", Label("hedstam", "ragnvald", "", "rv")),
        ("T. Hagelmark i Granfors:", Label("hagelmark", "t", "granfors", "")),
        ("{t=12293} HERR VIKMYR i Hasseltuna [Fb] :", Label("vikmyr", "", "hasseltuna", "fb")),
        ("Herr Dalgren, ls", Label("dalgren", "", "", "ls")),
        ("En röst:", None), ("Någon:", None), ("(Ej uppfattat namn):", None), ("Ledamot på bänk 14:", None), ("", None), (None, None), ("...", None),
    ],
)
def test_labels(given, want):
    assert parse_label(given) == want


SEGMENTS = "protocol_name string, name string, u_id string, who string, speaker_note_id string, data string"


def build(spark, items, name="p"):
    return spark.createDataFrame([(name, f"{name}_{i:03d}", f"u{i}", w, n, d) for i, (w, n, d) in enumerate(items, 1)], SEGMENTS)


@pytest.fixture(scope="module")
def notes(spark):
    rows = [("n1", "Herr VIK i Norr (fb):"), ("n2", "hr. Vik i Söder:"), ("n3", "Fru LÖV:"), ("n4", "Herr Vik i Norr"), ("n5", "Herr Vik:"), ("n6", "En röst:"), ("n7", "Ann Löv:"), ("n8", None), ("n3", "Fru LÖV:")]
    return spark.createDataFrame(rows, "speaker_note_id string, speaker_note string")


@pytest.fixture(scope="module")
def person(spark):
    return spark.createDataFrame([("a", "Q1"), ("b", None), ("c", "Q3")], "person_id string, wiki_id string")


def got(df):
    return [(r["turn_no"], r["first_u_id"], r["last_u_id"], r["speaker_id"]) for r in df.orderBy("protocol_name", "turn_no").collect()]


def test_turns(spark, notes, person):
    s = build(spark, [
        (" Q1", "n1", "Ja."), ("a", "n1", "[paus]"), ("unknown", "n4", "Nej."), ("b", "n2", "Så."), (None, "n5", "Vem?"), ("", "n5", "Vem?"), ("unknown", "n6", "Hej."),
        ("unknown", "missing", "Hej."), ("unknown", "missing", "Hej."), ("unknown", "n3", "Hej."), ("c", "n7", "Hej."), ("unknown", None, "x"), ("unknown", "n8", "x"), ("d-9", "n9", None), ("d-9", "n9", "Hej."),
    ])
    t = turns.speaker_turns(s.unionByName(s.limit(3)), notes, person)
    assert got(t) == [
        (1, "u1", "u3", "a"), (2, "u4", "u4", "b"), (3, "u5", "u6", "unknown"), (4, "u7", "u7", "unknown"), (5, "u8", "u9", "unknown"), (6, "u10", "u11", "c"), (7, "u12", "u12", "unknown"), (8, "u13", "u13", "unknown"), (9, "u15", "u15", "d-9"),
    ]
    texts = turns.speaker_turns(s, notes, person, with_text=True)
    assert texts.where("turn_no = 1").first()["text"] == "Ja.\nNej."


def test_clashing_columns_and_empty_tables(spark, notes, person):
    s = build(spark, [("a", "n1", "Ja.")])
    more = s.selectExpr("*", "1 AS family", "2 AS speaker", "3 AS place", "4 AS turn_no", "5 AS named")
    assert got(turns.speaker_turns(more, notes, person)) == [(1, "u1", "u1", "a")]
    assert turns.speaker_turns(s.limit(0), notes, person).count() == 0
    assert got(turns.speaker_turns(s, notes.limit(0), person.limit(0))) == [(1, "u1", "u1", "a")]


def test_long_protocol(spark, notes, person):
    """A protocol longer than a chunk, against a plain loop."""
    rng = random.Random(1)
    items, who = [], "a"
    for _ in range(9000):
        who = rng.choice([who, who, who, "a", "b", "unknown"])
        items.append((who, "missing", rng.choice(["Ja.", "Ja.", "eh …"])))
    s = build(spark, items)
    want, last = [], None
    for i, (w, _, d) in enumerate(items, 1):
        if d == "Ja.":
            if w == last:
                want[-1][2] = f"u{i}"
            else:
                want.append([len(want) + 1, f"u{i}", f"u{i}", w])
            last = w
    assert got(turns.speaker_turns(s, notes, person)) == [tuple(w) for w in want]


CAPTIONS = {
    "srt": ("1\n00:00:01,000 --> 00:00:04,000\nAnna Berg: Herr talman!\n\n2\n00:00:05,000 --> 00:00:06,500\neh jag yrkar\nbifall. [applåder]\n\n3\n00:00:07,000 --> 00:00:08,000\nTALMANNEN: Tack.\n", [("Anna Berg", "Herr talman!\njag yrkar\nbifall."), ("TALMANNEN", "Tack.")]),
    "vtt": ("WEBVTT - Kammaren\n\nNOTE ingen text\nalls\n\nSTYLE\n::cue {}\n\nintro\n00:01.000 --> 00:04.000 align:start\n<v Anna Berg>Herr <i>talman</i>!</v>\n\n00:05.000 --> 00:06.000\n<v.loud Bo Ek>Nej, <00:05.500>nej!\n", [("Anna Berg", "Herr talman!"), ("Bo Ek", "Nej, nej!")]),
    "lines": ("[00:12:01] Anna Berg: Herr talman!\n[00:12:05] Jag yrkar: bifall.\n12:07 Bo Ek: Nej.\n\n>> ANNA BERG: Jo.\n- Bo Ek: Hm.\n- Bo Ek: Jaha.", [("Anna Berg", "Herr talman!"), ("Jag yrkar", "bifall."), ("Bo Ek", "Nej."), ("ANNA BERG", "Jo."), ("Bo Ek", "Jaha.")]),
    "uneven labels": ("Herr BERG i Ås: Ja.\nHerr Berg i Ås: Och nej.\nhan gick: hem", [("Herr BERG i Ås", "Ja.\nOch nej.\nhan gick: hem")]),
    "no cue": ("WEBVTT\n\nbara text\n\n00:01.000 --> 00:02.000\nslut", [(None, "bara text\nslut")]),
    "plain": ("en rad\n\ntvå", [(None, "en rad\ntvå")]), "empty": ("", []), "blank": (" \n", []),
}


@pytest.mark.parametrize("layout", CAPTIONS)
def test_layouts(layout):
    text, want = CAPTIONS[layout]
    assert [tuple(t) for t in transcript_turns(text)] == want


def test_captions_leave_speech_alone():
    text = "7\n00:00:01,000 --> 00:00:04,000\n[applåder]\n\n8\n00:00:05,000 --> 00:00:06,000\neh\n"
    assert speech(text) == "" and not has_speech(text) and not has_speech(None)
    assert speech("1\n00:00:01,000 --> 00:00:04,000\nVi är 12\n") == "Vi är 12"


def test_long_marks():
    sound = "applåder " + "från läktarna i kammaren och salen " * 9
    assert speech(f"Ja ({sound}) nej [{'en lång anmärkning ' * 20}] *{'hostar ' * 30}* – {sound}– ja") == "Ja nej ja"
    assert speech(f"Det (som {'vi ' * 60}minns) var") == f"Det (som {'vi ' * 60}minns) var"
    assert speech("a [b\n\nc] d") == "a [b\nc] d" and has_speech("– eh –") is False and speech("Han – eh och hon – gick") == "Han – och hon – gick"
