"""Scanned pages: line kinds, broken words, misread characters, repair."""

import random

import pytest

from plenumspark.llm import pages
from plenumspark.llm.pages import BODY, BREAK, HEADER, NUMBER
from plenumspark.llm.queries import QUERIES


def kinds(text):
    return pages.label_lines(text.split("\n"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Detta är en vanlig rad i texten\nsom går vidare.", [BODY, BODY]),
        ("Detta är en vanlig rad i texten\nOm skolfrågan\n– 12 –\nsom går vidare.", [BODY, HEADER, NUMBER, BODY]),
        ("Nr 5 Lördagen den 1 februari 1940\nDetta är en vanlig rad.", [HEADER, BODY]),
        ("LÖRDAGEN DEN 1 FEBRUARI\n319.\nDetta är en vanlig rad.", [HEADER, NUMBER, BODY]),
        ("Andra karnmaren protokoll 1948. Nr 1\n\nText.", [HEADER, BREAK, BODY]),
        ("Det har minskat sedan\n1939.", [BODY, BODY]),
        ("enligt mom. 3 st.\n1.", [BODY, BODY]),
        ("Sid. 12\nText och mera text.", [NUMBER, BODY]),
        ("Om detta är sant, så är det bra.", [BODY]),
        ("Ang. livsmcdelslagen (f0rts.)\nText och mera.", [HEADER, BODY]),
        ("", [BREAK]),
        ("12 *\n[13]\n1 4 2", [NUMBER, NUMBER, NUMBER]),
    ],
)
def test_kinds(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize(
    ("text", "split"),
    [
        ("en skogsförord-\nningen här", [0]), ("en skogsförord¬ \nningen här", [0]), ("en sjuk-\noch hälsovård", []), ("en sjuk- \n[paus] och hälsovård", []),
        ("en skogsförord‐\nOm skolan\n12.\nningen här", [0]), ("slut-", []), ("FK-\nreglerna", [0]), ("ett – \ntvå", []),
    ],
)
def test_split(text, split):
    assert pages.parse_page(text).split == split


@pytest.mark.parametrize(
    ("read", "printed", "at"),
    [("galler", "gäller", [1]), ("rniljoner", "miljoner", [0, 1]), ("konsumentema", "konsumenterna", [10]), ("kr0nor", "kronor", [2]), ("fislcet", "fisket", [3, 4]), ("överviigt", "övervägt", [5, 6]), ("propodonen", "propotionen", [5]), ("gäller", "galler", None), ("bil", "bol", None)],
)
def test_misread(read, printed, at):
    assert pages.misread_at(read, printed) == at
    if at:
        assert set(pages.skeletons(read)) & set(pages.skeletons(printed))


WORDS = "riksdagen beslutade enligt planen att vattenstyrelsen gäller även kommunerna miljoner kronor förändra skyndsamt".split()


@pytest.fixture(scope="module")
def segments(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", " ".join(rng.choice(WORDS) for _ in range(30)) + ".") for i in range(60)]
    rows += [
        ("a", "riksdagen beslutade galler kr0nor\nOm vattenstyrelsen\n12.\nenligt plan-\nen kommunema."), ("b", None), ("c", ""), ("d", " \n\n "), (None, "12 *"),
        ("e", "riksdagen år 19O5 vattenst-\nyrelscn här\n\nNästa stycke 1905."), ("a", "riksdagen beslutade galler kr0nor\nOm vattenstyrelsen\n12.\nenligt plan-\nen kommunema."),
    ]
    return spark.createDataFrame(rows, "u_id string, data string").selectExpr("*", "1 AS word", "2 AS n", "3 AS line_no")


def test_defects(segments):
    got = sorted((r["u_id"] or "", r["line_no"], r["defect"]) for r in pages.line_defects(segments).collect())
    assert got == [("", 1, "furniture")][:0] + [("a", 1, "glyph"), ("a", 2, "furniture"), ("a", 3, "furniture"), ("a", 4, "split"), ("a", 5, "glyph"), ("e", 1, "glyph"), ("e", 1, "split"), ("e", 2, "glyph")]


def test_paragraphs(segments):
    got = {(r["u_id"], r["paragraph_no"]): r["text"] for r in pages.paragraphs(segments).where("u_id IN ('a', 'c', 'd', 'e')").collect()}
    assert got == {("a", 1): "riksdagen beslutade gäller kronor enligt planen kommunerna.", ("e", 1): "riksdagen år 19O5 vattenstyrelsen här", ("e", 2): "Nästa stycke 1905."}


def test_empty(segments):
    assert pages.line_defects(segments.limit(0)).count() == 0 and pages.paragraphs(segments.limit(0)).count() == 0


def test_very_long_text():
    text = "\n".join(["ett ord till"] * 50_000 + ["– 12 –"] * 2 + ["slut"])
    page = pages.parse_page(text)
    assert page.kinds.count(NUMBER) == 2 and len(page.words) == 50_001


def test_paragraphs_query_mends_years_and_words_with_digits(spark, segments, tmp_path):
    more = spark.createDataFrame([("y", "åren l942, 1g89, 2OlS och 19Z8"), ("z", "mötet i Ljusdal\nLju5dal 18.\nx1zq"), ("v", "1942 2bis 4g")], "u_id string, data string")
    segments.select("u_id", "data").unionByName(more).write.parquet(f"{tmp_path}/protocol_segments.parquet")
    got = {(r["u_id"], r["paragraph_no"]): r["text"] for r in QUERIES["p4_paragraphs"](spark, str(tmp_path)).where("u_id IN ('e', 'v', 'y', 'z')").collect()}
    assert got == {
        ("e", 1): "riksdagen år 1905 vattenstyrelsen här", ("e", 2): "Nästa stycke 1905.", ("y", 1): "åren 1942, 1989, 2015 och 1928",
        ("z", 1): "mötet i Ljusdal Ljusdal 18. x1zq", ("v", 1): "1942 2bis 4g",
    }


HEADERS = ["Riksdagens protokoll {}/88:12", "Wednesday {} March 1987", "Séance du {} mai"]


def test_headers_of_any_wording_are_learned_from_other_pages(spark):
    """No list knows these headers; that they part sentences on many pages shows them. A short line that closes sentences, as often repeated, stays."""
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choice(WORDS) for _ in range(7))
    rows = [(f"p{i}", f"Herr talman\n{sentence()} och\n{HEADERS[i % 3].format(i)}\n{sentence()}.\n\nHerr talman\n{sentence()}.") for i in range(90)]
    df = spark.createDataFrame(rows, "u_id string, data string")
    got = {(r["u_id"], r["line_no"]) for r in pages.line_defects(df).where("defect = 'furniture'").collect()}
    assert got == {(u, 3) for u, _ in rows}
    texts = [r["text"] for r in pages.paragraphs(df).collect()]
    assert not any("protokoll" in t or "March" in t or "Séance" in t for t in texts) and sum(t.startswith("Herr talman ") for t in texts) == 180


def test_long_and_single_line_furniture():
    long = "Ang. " + "arbetsmarknadspolitiska" * 4 + " (forts.)"
    assert kinds(f"Detta är en rad\n{long}\nsom går vidare.") == [BODY, HEADER, BODY]
    assert kinds("Andra kammaren protokoll 1948. Nr 1") == [HEADER] and kinds("12 *") == [BODY]


def test_long_marks_beside_a_break():
    mark = "[" + "sorl från läktaren " * 5 + "]"
    assert pages.parse_page(f"en skogsförord- {mark}\nningen här").split == [0]


def test_paragraphs_are_whole_and_repaired(spark):
    """Planted errors in known texts: the paragraphs must be the texts again."""
    rng = random.Random(8)
    truth, rows = {}, []
    for i in range(60):
        words = [rng.choice(WORDS) for _ in range(24)]
        truth[f"q{i}"] = " ".join(words) + " år 1912 regering."
        spoilt = [w.replace("m", "rn", 1) if w == "miljoner" and k == 3 else w for k, w in enumerate(words)]
        lines = [" ".join(spoilt[k : k + 6]) for k in range(0, 24, 6)]
        lines[1:1] = ["– 12 –"]
        last = "år 19l2 rege8ring." if i == 7 else "år 1912 rege-\nring." if i % 2 else "år 1912 regering."
        rows.append((f"q{i}", "\n".join(lines + [last])))
    got = {r["u_id"]: r["text"] for r in pages.paragraphs(spark.createDataFrame(rows + rows[:5], "u_id string, data string"), mend_years=True).collect()}
    assert got == truth
