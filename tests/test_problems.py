"""The general training-data operators against plain Python, with nulls, ties, repeated rows and a hot key."""

import datetime as dt
import json
import random

import brute
import pytest
from pyspark.sql import functions as F

from plenumspark.operators import asof, drift, intervals, orphans, persons


def day(n):
    return dt.date(1950, 1, 1) + dt.timedelta(days=n)


def moment(n):
    return dt.datetime(1950, 1, 1) + dt.timedelta(hours=n)


@pytest.mark.parametrize("seed", [1, 2])
def test_known_at(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 4 + ["a", "b", "c", None]
    attrs = []
    for i in range(300):
        s = rng.choice([None, *range(0, 4000, 50)]) if i % 20 == 0 else rng.randrange(0, 4000)
        e = None if rng.random() < 0.3 else (s or 0) + rng.randrange(-50, 900)
        attrs.append((rng.choice(keys), None if s is None else day(s), None if e is None else day(e), None if i % 31 == 0 else moment(rng.randrange(0, 4000 * 24)), i, f"x{i}"))
    attrs += attrs[:20]
    events = [(rng.choice(keys), None if i % 17 == 0 else moment(rng.randrange(0, 4200 * 24) if i % 3 else 24 * rng.randrange(0, 4200))) for i in range(400)]
    a = spark.createDataFrame(attrs, "who string, start date, end date, known timestamp, key long, entity string")
    e = spark.createDataFrame(events, "person string, t timestamp").withColumn("bucket", F.lit(1)).withColumn("row_key", F.lit("clash"))
    got = {(r["entity"], r["event_micros"]): r["row_key"] for r in asof.known_at(e, a, event_entity="person", event_time="t", entity="who", start="start", end="end", known="known", row_key="key", bucket_days=365).collect()}
    want = {}
    zero = dt.datetime(1970, 1, 1)
    for who, t in set(events):
        if who is None or t is None:
            continue
        fit = [(s, k, i) for w, s, x, k, i, _ in attrs if w == who and s is not None and k is not None and dt.datetime.combine(s, dt.time()) <= t and k <= t and (x is None or t < dt.datetime.combine(x, dt.time()) + dt.timedelta(days=1))]
        if fit:
            want[(who, (t - zero) // dt.timedelta(microseconds=1))] = max(fit)[2]
    assert got == want
    assert asof.known_at(e.limit(0), a, event_entity="person", event_time="t", entity="who", start="start", end="end", known="known", row_key="key").count() == 0
    assert asof.known_at(e, a.limit(0), event_entity="person", event_time="t", entity="who", start="start", end="end", known="known", row_key="key").count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_orphans(spark, seed):
    rng = random.Random(seed)
    times = [rng.randrange(0, 80_000) for _ in range(60)]
    parents = [(rng.choice(["hot", "hot", "a", "b", "c", None]), None if i % 23 == 0 else moment(t), None if rng.random() < 0.4 else moment(t + rng.randrange(-10, 9000))) for i, t in enumerate(times)]
    children = [("t", i, rng.choice(["hot", "hot", "hot", "a", "b", "x", None]), None if i % 29 == 0 else moment(rng.randrange(0, 90_000))) for i in range(300)]
    children += children[:30] + [("t", 1000, "hot", parents[1][1]), ("t", 1001, "a", None), ("t", 1002, "zz", None)]
    p = spark.createDataFrame(parents, "key string, recorded_at timestamp, deleted_at timestamp").withColumn("shard", F.lit("clash"))
    c = spark.createDataFrame(children, "child_table string, child_key long, ref string, at timestamp").withColumn("kind", F.lit("clash"))
    got = sorted((r["child_key"], r["period"], r["reason"]) for r in orphans.orphans(c, p).collect())
    want = []
    for _, k, ref, at in set(children):
        if ref is None:
            continue
        rows = [(a, b) for key, a, b in parents if key == ref and a is not None]
        if not rows:
            want.append((k, at.year if at else None, "missing"))
        elif at is not None and not any(a <= at and (b is None or b > at) for a, b in rows):
            want.append((k, at.year, "late" if all(a > at for a, _ in rows) else "deleted"))
    assert got == sorted(want, key=lambda x: (x[0], x[1] or 0, x[2]))
    assert orphans.orphans(c.limit(0), p).count() == 0
    assert {r["reason"] for r in orphans.orphans(c, p.limit(0)).collect()} == {"missing"}


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_periods_and_gaps(spark, seed):
    rng = random.Random(seed)
    top = 64**4 - 1
    spans = []
    for i in range(200):
        a = rng.choice([rng.randrange(0, 300), rng.randrange(0, 20_000), rng.randrange(0, 500_000)])
        b = rng.choice([a, a + rng.randrange(-2, 70), a + rng.randrange(0, 5000), a + rng.randrange(0, 300_000), top])
        if b == top and rng.random() < 0.8:
            b = a + 1
        spans.append((rng.choice(["hot", "hot", "a", "b", "c", None]), None if i % 37 == 0 else a, None if i % 41 == 0 else b))
    spans += spans[:20] + [("one", 0, 0), ("all", 0, top), ("adjoining", 5, 63), ("adjoining", 64, 127), ("adjoining", 129, 200), ("word", 64, 127), ("bad", 9, 3)]
    df = spark.createDataFrame(spans, "entity string, first long, last long").withColumn("level", F.lit("clash"))
    got = sorted(tuple(r) for r in intervals.periods_and_gaps(df).collect())
    want = []
    for k in {s[0] for s in spans} - {None}:
        own = sorted((a, b) for e, a, b in spans if e == k and a is not None and b is not None and a <= b <= top)
        merged = []
        for a, b in own:
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(k, "period", a, b) for a, b in merged] + [(k, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])]
    assert got == sorted(want)
    assert intervals.periods_and_gaps(df.limit(0)).count() == 0


def test_days(spark):
    df = spark.createDataFrame([(dt.date(1, 1, 1),), (dt.date(1969, 12, 31),), (dt.date(9999, 12, 31),)], "d date")
    rows = df.select(intervals.day_unit(F.col("d")).alias("u"), intervals.unit_day(intervals.day_unit(F.col("d"))).alias("t")).collect()
    assert [r["t"] for r in rows] == ["0001-01-01", "1969-12-31", "9999-12-31"] and rows[0]["u"] == 0 and rows[2]["u"] < 64**4


RECORDS = "series_no long, file_no int, file_id long, table_name string, record_key string, payload string"


def test_schema_changes(spark):
    rng = random.Random(8)
    rows = []
    for s in range(6):
        fields = {f"f{i}": rng.choice(["i", "s", "f", "z", "b", "a", "o"]) for i in range(6)}
        for no in range(5):
            if no:
                f = rng.choice(sorted(fields))
                kind = rng.choice(["rename", "drop", "add", "retype", "none"])
                if kind == "rename":
                    fields[f"r{s}{no}"] = fields.pop(f)
                elif kind == "drop":
                    fields.pop(f)
                elif kind == "add":
                    fields[f"n{s}{no}"] = "s"
                elif kind == "retype":
                    fields[f] = rng.choice(["i", "s", "f", "z", "b", "a", "o"])
            for k in range(12):
                v = {"i": k, "s": f"v{k}", "f": k + 0.5, "z": float(k), "b": bool(k % 2), "a": [k], "o": {"x": k}}
                o = {n: (None if rng.random() < 0.1 else v[t]) for n, t in fields.items() if rng.random() < 0.95}
                rows.append((s, no, s * 10 + no, "t", f"k{k}", json.dumps(o)))
    rows += rows[:9] + [(9, 0, 90, "t", "k", None), (9, 1, 91, "t", "k", "{}"), (9, 2, 92, "t", "k", '{"a": 1}')]
    df = spark.createDataFrame(rows, RECORDS).withColumn("field", F.lit("clash"))
    got = sorted(tuple(r) for r in drift.schema_changes(df).collect())
    assert got == brute.schema_changes([(s, n, f, k, p) for s, n, f, _, k, p in rows])
    assert drift.schema_changes(df.limit(0)).count() == 0


def test_union_table(spark):
    rows = [
        (1, 1, 11, "t", "a", '{"id": 1, "old": "x", "file_no": "c"}'), (1, 1, 11, "t", "b", '{"id": 2, "old": "y"}'),
        (1, 2, 12, "t", "a", '{"id": 1.5, "new": "x"}'), (1, 2, 12, "t", "b", '{"id": 2, "new": "y"}'), (2, 1, 21, "u", "a", '{"z": 1}'),
    ]
    t = drift.union_table(spark.createDataFrame(rows, RECORDS), "t")
    assert t.dtypes[4:] == [("file_no_", "string"), ("id", "double"), ("old", "string")]
    assert sorted((r["file_id"], r["record_key"], r["id"], r["old"]) for r in t.collect()) == [(11, "a", 1.0, "x"), (11, "b", 2.0, "y"), (12, "a", 1.5, "x"), (12, "b", 2.0, "y")]
    assert drift.union_table(spark.createDataFrame(rows, RECORDS), "none").count() == 0


def test_union_table_with_names_that_differ_in_case(spark):
    rows = [
        (1, 1, 11, "t", "a", '{"person_id": "x", "FILE_ID": 7}'), (1, 2, 12, "t", "a", '{"person_id": "x", "PERSON_ID": 3, "FILE_ID": 7}'),
        (1, 3, 13, "t", "a", '{"Person_Id": "x", "PERSON_ID": 4, "person_id": 1.5}'), (1, 3, 13, "t", None, None),
    ]
    t = drift.union_table(spark.createDataFrame(rows, RECORDS), "t")
    assert sorted(t.columns) == ["FILE_ID_", "PERSON_ID_2", "Person_Id_3", "file_id", "file_no", "person_id", "record_key", "series_no"]
    got = {(r["file_id"], r["record_key"]): (r["person_id"], r["PERSON_ID_2"], r["FILE_ID_"]) for r in t.collect()}
    assert got == {(11, "a"): ("x", None, 7), (12, "a"): ("x", 3, 7), (13, "a"): ("1.5", 4, None), (13, None): (None, None, None)}
    assert drift.column_names(["a", "A", "a_2", "file_no"]) == ["a", "A_2", "a_2_2", "file_no_"]


def test_a_line_of_renames_keeps_its_name_when_the_name_is_taken_again(spark):
    rows = [(1, 1, 11, "t", "a", '{"x": 1}'), (1, 2, 12, "t", "a", '{"y": 1}'), (1, 3, 13, "t", "a", '{"y": 1, "x": true}')]
    t = drift.union_table(spark.createDataFrame(rows, RECORDS), "t")
    assert sorted((r["file_id"], r["x"], r["x_2"]) for r in t.collect()) == [(11, 1, None), (12, 1, None), (13, 1, True)]


def test_many_renamed_fields_at_once(spark):
    old, new = {f"o{i}": f"v{i}" for i in range(300)}, {f"n{i}": f"v{i}" for i in range(300)}
    rows = [(1, 1, 11, "t", k, json.dumps(old)) for k in "abc"] + [(1, 2, 12, "t", k, json.dumps(new)) for k in "abc"]
    got = drift.schema_changes(spark.createDataFrame(rows, RECORDS)).collect()
    assert sorted(tuple(r) for r in got) == sorted((12, "renamed", f"o{i}", f"n{i}") for i in range(300))


def test_references(spark):
    person = spark.createDataFrame([("i-1", "Q1"), ("i-1", "Q1"), ("i-2", None), (None, "Q9")], "person_id string, wiki_id string")
    given = [("i-1", "i-1"), ("  i-1 \n", "i-1"), ("Q1", "i-1"), ("\tQ1 ", "i-1"), ("I-1", "I-1"), ("Q9", "Q9"), ("UnKnown ", None), ("　", None), ("", None), (None, None), ("i 1", "i 1")]
    df = spark.createDataFrame([(g, i) for i, (g, _) in enumerate(given)], "ref string, wiki_key int")
    got = {r["wiki_key"]: r["out"] for r in persons.resolve(df, "ref", person, "out").collect()}
    assert got == {i: w for i, (_, w) in enumerate(given)}
    assert persons.resolve(df.limit(0), "ref", person).count() == 0 and persons.resolve(df, "ref", person.limit(0)).count() == len(given)


def test_periods_on_a_long_time_line(spark):
    """Units far beyond 2**24 and below 0, as milliseconds are."""
    ms = 1_700_000_000_000
    rows = [("a", ms, ms + 10), ("a", ms + 11, ms + 20), ("a", ms + 10**9, ms + 2 * 10**9), ("b", -500, -3), ("b", -2, 4), ("b", 10, 1 << 60)]
    got = sorted(map(tuple, intervals.periods_and_gaps(spark.createDataFrame(rows, "entity string, first long, last long")).collect()))
    assert got == [("a", "gap", ms + 21, ms + 10**9 - 1), ("a", "period", ms, ms + 20), ("a", "period", ms + 10**9, ms + 2 * 10**9), ("b", "gap", 5, 9), ("b", "period", -500, 4), ("b", "period", 10, 1 << 60)]
    with pytest.raises(Exception, match="units beyond"):
        intervals.periods_and_gaps(spark.createDataFrame([("a", 0, (1 << 62))], "entity string, first long, last long")).collect()
