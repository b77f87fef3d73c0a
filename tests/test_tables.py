"""Warehouse, code tables, point-in-time lookups, tagged frames, groups and checks."""

import pytest
from pyspark.sql import functions as F

from plenumspark.operators import asof, codecs, grouping, quality, tagged, warehouse


def test_party_at(spark):
    party = spark.createDataFrame([("a", 8, 1950, 1952, 1), ("a", 1, 1952, 1953, 2), ("a", 10, 1955, 1956, 3), ("b", 8, 1923, 1926, 1), ("b", 1, None, None, 2), ("b", 10, None, None, 3)], "person_id string, party_id int, start_year int, end_year int, rn int")
    events = spark.createDataFrame([("a", y) for y in (1950, 1952, 1953, 1954, 1955, 1956)] + [("b", y) for y in (1923, 1922, 1990)] + [("c", 1950), (None, 1950), ("a", None)], "person_id string, year int")
    got = {(r["person_id"], r["year"]): r["party_id"] for r in asof.party_at(events, party).collect()}
    assert got == {("a", 1950): 8, ("a", 1952): 8, ("a", 1953): 1, ("a", 1954): 0, ("a", 1955): 10, ("a", 1956): 10, ("b", 1923): 8, ("b", 1922): 1, ("b", 1990): 1, ("c", 1950): 0}
    fixed = spark.createDataFrame([("a", 5), ("b", 0)], "person_id string, party_id int")
    assert {r["party_id"] for r in asof.party_at(events, party, fixed=fixed).where("person_id = 'a'").collect()} == {5}
    assert asof.party_at(events.limit(0), party).count() == 0


def test_office_at(spark):
    terms = spark.createDataFrame([("a", 1, 1950, 1952, 1), ("a", 2, 1951, 1955, 2)], "person_id string, office_type_id int, start_year int, end_year int, rn int")
    events = spark.createDataFrame([("a", 1951), ("a", 1954), ("a", 1990), ("b", 1950)], "person_id string, year int")
    got = {(r["person_id"], r["year"]): r["office_type_id"] for r in asof.office_at(events, terms).collect()}
    assert got == {("a", 1951): 1, ("a", 1954): 2, ("a", 1990): 2, ("b", 1950): 0}


@pytest.fixture(scope="module")
def raw(spark):
    df = spark.createDataFrame
    return {
        "utterances": df([("p1",), ("p2",), ("unknown",), (None,)], "person_id string"),
        "person": df([("p1", "1900-01-02", "1980", "man"), ("p2", None, None, "woman"), ("p3", "1950", None, "man"), ("unknown", None, None, "unknown")], "person_id string, born string, dead string, gender string"),
        "name": df([("p1", "Ole", False), ("p1", "Olle", True), ("p2", "Åsa", False)], "person_id string, name string, primary_name boolean"),
        "wiki_id": df([("p1", "Q1")], "person_id string, wiki_id string"),
        "member_of_parliament": df([("p1", "1930-01-01", "D", "1940-12-31", "Y", "andrakammarledamot", "Norra"), ("p1", "1930-01-01", "D", "1940-12-31", "Y", "andrakammarledamot", "Norra"), ("p2", None, "X", None, "X", None, None)], "person_id string, start string, start_flag string, end string, end_flag string, role string, district string"),
        "minister": df([("p2", "1950-01-01", "D", None, "X", "statsminister", "Gov I")], "person_id string, start string, start_flag string, end string, end_flag string, role string, government string"),
        "speaker": df([("p1", "1935", "Y", "1936", "Y", "andra kammarens talman i andra kammaren")], "person_id string, start string, start_flag string, end string, end_flag string, role string"),
        "government": df([("Gov I", "1949-01-01", None)], "government string, start string, end string"),
        "location_specifier": df([("p1", "Luleå"), ("p2", None)], "person_id string, location string"),
        "known_parties": df([("S-partiet", "S", "Socialen", 1), ("M-partiet", "M", "Moderaten", 2)], "source_party string, abbreviation string, party string, sort_order int"),
        "party_affiliation": df([("p1", "S-partiet", "1930", "Y", "1935", "Y"), ("p1", "M-partiet", "1936", "Y", None, "X"), ("p2", "S-partiet", None, "X", None, "X"), ("p3", "S-partiet", None, "X", None, "X")], "person_id string, party string, start string, start_flag string, end string, end_flag string"),
    }


def test_warehouse(raw):
    w = warehouse.build(raw)
    assert {k: v.count() for k, v in w.items()} == {
        "years": 164, "gender": 3, "chamber": 4, "office_type": 4, "district": 2, "location": 2, "government": 1, "sub_office_type": 8, "person_name": 2, "person_location": 1,
        "terms_of_office": 4, "minister_government": 1, "party": 3, "person_party": 4, "persons_of_interest": 3,
    }
    p = {r["person_id"]: r for r in w["persons_of_interest"].collect()}
    assert p["unknown"]["pid"] == 0 and (p["p1"]["name"], p["p1"]["gender_id"], p["p1"]["year_of_birth"], p["p1"]["year_of_death"], p["p1"]["wiki_id"]) == ("Olle", 1, 1900, 1980, "Q1")
    assert p["p1"]["has_multiple_parties"] and p["p1"]["party_id"] is None and p["p2"]["party_id"] == 1
    t = w["terms_of_office"].collect()
    assert sorted((r["office_type_id"], r["sub_office_type_id"]) for r in t) == [(1, 0), (1, 2), (2, 7), (3, 6)] or sorted((r["office_type_id"], r["sub_office_type_id"]) for r in t) == [(1, 0), (1, 2), (2, 6), (3, 7)]
    assert {r["party_color"] for r in w["party"].collect()} == {"#000000", "#E8112d", "#52BDEC"}


def test_conform_and_version(spark):
    raw = spark.createDataFrame([("1", "2020-02", "True", "a"), ("1", "2019", "False", "b"), ("x", None, None, "c")], "id string, day string, flag string, o string")
    spec = warehouse.Spec({"key": "int", "day": "date", "day_flag": "string", "day0": "string", "flag": "boolean", "again": "string"}, drop_duplicates=("id",), rename={"id": "key"}, copy={"o": "again"}, partial_dates={"day": True}, order="o")
    got = [tuple(r) for r in warehouse.conform(raw, spec).orderBy("again").collect()]
    assert [(g[0], str(g[1]), g[2], g[3], g[4], g[5]) for g in got] == [(1, "2020-02-29", "M", "2020-02", True, "a"), (None, "None", "X", None, None, "c")]
    v = warehouse.version_table(spark, "1.0")
    warehouse.check_version(v, "1.0")
    with pytest.raises(ValueError):
        warehouse.check_version(v, "2.0")


def test_codecs(spark):
    df = spark.createDataFrame([(1, 9), (2, None)], "party_id int, gender_id int")
    t = spark.createDataFrame([(1, "S"), (1, "T")], "party_id int, abbrev string")
    out = codecs.apply_codecs(df, [codecs.Codec("party_id", "abbrev", t, "party_id", "abbrev", default="?"), codecs.Codec("gender_id", "g", function=lambda c: F.coalesce(c, F.lit(0))), codecs.Codec("none", "x", t, "a", "b")])
    assert sorted(tuple(r) for r in out.select("party_id", "abbrev", "g").collect()) == [(1, "S", 9), (2, "?", 0)]
    assert codecs.decode_value([codecs.Codec("party_id", "abbrev", t, "party_id", "abbrev")], "party_id", 1) == "S"
    assert codecs.decode_value([], "party_id", 1, "?") == "?"


def test_person_references(spark):
    persons = spark.createDataFrame([(0, "unknown", None, 0, 0), (7, "i-1", "Q5", 1, 2)], "pid long, person_id string, wiki_id string, gender_id int, party_id int")
    df = spark.createDataFrame([("7",), ("Q5",), ("i-1",), ("i-2",), (None,)], "who string")
    assert {r["who"]: r["pid"] for r in codecs.any_person(df, "who", persons).collect()} == {"7": 7, "Q5": 7, "i-1": 7, "i-2": 0, None: 0}
    assert {r["who"]: (r["gender_id"], r["party_id"]) for r in codecs.overload_by_person(df.withColumn("party_id", F.lit(99)), persons).collect()}["Q5"] == (1, 2)


def test_tagged_frames(spark):
    f = spark.createDataFrame([("d1", "lemma\ttoken\tpos\nvara\tÄr\tVB\n\n.\t.\tMAD\n"), ("d2", None), ("d3", "")], "document_id string, annotation string")
    t = tagged.token_rows(f, ["document_id"])
    assert [tuple(r) for r in t.orderBy("tok_idx").collect()] == [("d1", 0, "Är", "vara", "VB", None), ("d1", 1, ".", ".", "MAD", None)]
    assert tagged.filtered(t, skip_punctuation=True, lowercase=True).first()["token"] == "är"
    assert tagged.filtered(t, skip_stopwords=True).count() == 1
    with pytest.raises(ValueError):
        tagged.filtered(t, skip_text=True, skip_lemma=True)
    v = tagged.vocabulary(t)
    assert [tuple(r) for r in v.orderBy("token_id").collect()] == [("Är", 0), (".", 1), ("vara", 2)]
    ids = tagged.id_frame(t.drop("xpos"), v).orderBy("tok_idx").collect()
    assert [(r["token_id"], r["lemma_id"], r["pos_id"]) for r in ids] == [(0, 2, 21), (1, 1, 22)]
    c = tagged.pos_counts(t.unionByName(t.limit(1).withColumn("pos", F.lit("??"))), ["document_id"]).first()
    assert (c["Verb"], c["Delimiter"], c["Noun"], c["n_tokens"]) == (1, 1, 0, 2)
    assert tagged.vocabulary(t.limit(0)).count() == 0


def test_merged_frames(spark):
    df = spark.createDataFrame([(["header\nA\nB", "header", "header\nE\nF"],), ([],)], "f array<string>")
    got = [r[0] for r in df.select(tagged.merged_frames(F.col("f"))).collect()]
    assert got == ["header\nA\nB\nE\nF", ""]
    assert df.sparkSession.createDataFrame([("a\nb\n",), (None,)], "x string").select(tagged.n_token_lines(F.col("x")).alias("n")).collect()[0]["n"] == 2


def test_term_counts(spark):
    df = spark.createDataFrame([(w,) for w in "a a b c c d e f a e".split()] + [(None,)], "word string")
    assert dict(map(tuple, tagged.term_counts(df).collect())) == {"a": 3, "b": 1, "c": 2, "d": 1, "e": 2, "f": 1}
    assert dict(map(tuple, tagged.term_counts(df, cut_off=1).collect())) == {"a": 3, "c": 2, "e": 2}


def test_groups(spark):
    s = spark.createDataFrame([("p1", "p1_1", "1", 1957, "a", 3, "x"), ("p2", "p2_1", "2", 1958, "a", None, "y"), ("p1", "p1_2", "3", 1957, "b", 1, None), ("p3", "p3_1", "4", None, "a", 1, "z")], "protocol_name string, name string, id string, year int, who string, n_tokens int, data string")
    g = {(r["period"], r["who"]): r for r in grouping.group_segments(s, "lustrum", ["who"]).collect()}
    assert g[("1955-1959", "a")]["data"] == "x\ny" and g[("1955-1959", "a")]["n_tokens"] == 3 and g[("1955-1959", "b")]["data"] == "" and ("p3", "a") in g
    n = grouping.named_groups(grouping.group_segments(s, "year", ["who"]), ["who"]).first()
    assert len(n["group_hash"]) == 32
    with pytest.raises(ValueError):
        grouping.group_segments(s, "year", ["nobody"])
    assert grouping.group_segments(s.limit(0), "year", ["who"]).count() == 0
    r = grouping.records(s.select("who", "id"), "who").orderBy("who").first()
    assert [x["id"] for x in r["records"]] == ["1", "2", "4"]
    with_ = grouping.with_properties(s, [s.select("id", F.lit(1).alias("party_id")), s.select("id", F.lit(2).alias("party_id")).limit(0)], ["id"], ["party_id", "who"])
    assert {x["party_id"] for x in with_.collect()} == {1}
    with pytest.raises(ValueError):
        grouping.with_properties(s, [], ["id"], ["missing"])


def test_quality(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1,)], "k int")
    r = quality.foreign_key_violations(a, "k", b, "k", "a.k").first()
    assert (r["n_rows"], r["missing"]) == (2, "2")
    assert quality.duplicates(a, ["k", "v"]).first()["n_rows"] == 2
    assert quality.column_differences({"t": ["a", "b"], "u": []}, {"t": ["a", "c"]}) == {"left": {"t": ["b"], "u": []}, "right": {"t": ["c"]}}
    assert quality.subset_by_keys({"a": a}, {"k": b})["a"].count() == 1
    l = spark.createDataFrame([("x", "X")], "old string, new string")  # noqa: E741
    assert sorted(x["v"] for x in quality.replace_keys(a, l, "v", "old", "new").collect()) == ["X", "y", "y", "z"]
    old = spark.createDataFrame([("p", "1")], "protocol_name string, checksum string")
    new = spark.createDataFrame([("p", "2"), ("q", "1")], "protocol_name string, checksum string")
    assert quality.changed_checksums(old, new).count() == 2


def test_streaming(spark, tmp_path):
    from plenumspark.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "prot-1.xml").write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><u xmlns:xml="http://www.w3.org/XML/1998/namespace" xml:id="u-1" who="a"><seg>ett två ett</seg></u></div></body></text></TEI>')
    seen = []
    q = ingest.run_batches(ingest.stream_elements(spark, str(tmp_path / "in")), lambda df, i: seen.extend(r["u_id"] for r in df.collect()), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert seen == ["u-1"]
    t = spark.createDataFrame([("ett två ett",)], "data string")
    assert dict(map(tuple, ingest.running_word_counts(t).collect())) == {"ett": 2, "två": 1}
    tagged_ = ingest.tag(spark.createDataFrame([("u", "a b"), ("v", " ")], "u_id string, data string"), lambda: str.upper).collect()
    assert {r["u_id"]: r["annotation"] for r in tagged_} == {"u": "A B", "v": ""}
