"""Schemas that drift between files: headers, a type-promotion lattice, ordered differences, one union table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plenumspark.session import bounded_broadcast, checkpointed

#: JSON types as bits of a set. The lattice's join: whole and fractional give fractional, any other mixture gives string.
TYPES = {"whole": 1, "fractional": 2, "boolean": 4, "string": 8, "array": 16, "object": 32}
SPARK_TYPE = {"whole": "bigint", "fractional": "double", "boolean": "boolean"}


def _bit(v: Column) -> Column:
    """The type bit of a variant, 0 for null. A short decimal without a fraction was written as one (9.0): whole numbers are BIGINT up to 19 digits."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), 0).when(s == "STRING", TYPES["string"]).when(s == "BOOLEAN", TYPES["boolean"])
        .when(s.startswith("ARRAY"), TYPES["array"]).when(s.startswith("OBJECT"), TYPES["object"])
        .when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | s.rlike(r"^DECIMAL\((19|[23]\d),\s*0\)$"), TYPES["whole"]).otherwise(TYPES["fractional"])
    )


def _text(v: Column) -> Column:
    """A JSON value as it would be written, numbers in full and with the fraction they had; null for null."""
    s = F.schema_of_variant(v)
    t = v.try_cast("string")
    return F.when(s != "VOID", F.when((_bit(v) == TYPES["fractional"]) & ~t.rlike("[.E]"), F.concat(t, F.lit(".0"))).otherwise(t))


def promoted(bits: Column) -> Column:
    """The lattice's join of a set of types; null for the empty set."""
    out = F.when(bits == 0, None)
    for name, bit in TYPES.items():
        out = out.when(bits == bit, name)
    return out.when(bits == TYPES["whole"] | TYPES["fractional"], "fractional").otherwise("string")


def headers(records: DataFrame) -> DataFrame:
    """(series_no, file_no, file_id, table_name, field, bits): every file's fields and the set of their types.

    Read in parallel from the records; the aggregate combines before the shuffle, so a huge file costs
    no more than its fields. A payload that is null or no JSON object has no fields.
    """
    fields = records.select("series_no", "file_no", "file_id", "table_name", F.explode(F.from_json("payload", "map<string,variant>")).alias("field", "v"))
    return fields.groupBy("series_no", "file_no", "file_id", "table_name", "field").agg(F.bit_or(_bit(F.col("v"))).alias("bits"))


def _files(records: DataFrame) -> DataFrame:
    """(series_no, file_id, prev_id): each file with the one before it in its series."""
    files = records.select("series_no", "file_no", "file_id").distinct()
    return files.select("series_no", "file_id", F.lag("file_id").over(W.partitionBy("series_no").orderBy("file_no", "file_id")).alias("prev_id"))


def _compared(records: DataFrame, both: DataFrame, share: float) -> DataFrame:
    """(file_id, old, new, n, same): gone and new fields that hold the same text in at least `share` of the record keys in both files where either is not null.

    A record sends its values of its own file's new fields and of the next file's gone ones to that file and
    key: fields add up there and are never crossed. Values that are equal bring their fields together; what
    could still reach `share` by its count of values alone is then counted exactly.
    """
    fields = lambda absent: F.sort_array(F.collect_list(F.when(F.col(absent).isNull(), F.col("field"))))
    wanted = both.groupBy("file_id", "prev_id").agg(fields("now").alias("olds"), fields("before").alias("news")).where("size(olds) > 0 AND size(news) > 0")
    to = lambda source, now, c: F.struct(F.col(source).alias("source"), F.struct("file_id", F.lit(now).alias("is_now"), F.col(c).alias("fields")).alias("to"))
    targets = wanted.select(F.explode(F.array(to("file_id", True, "news"), to("prev_id", False, "olds"))).alias("x")).select("x.*").groupBy("source").agg(F.collect_list("to").alias("tos"))
    parsed = records.select(F.col("file_id").alias("source"), "record_key", F.from_json("payload", "map<string,string>").alias("m")).join(bounded_broadcast(targets, 2_000), "source")
    held = lambda to: F.filter(F.transform(to["fields"], lambda f: F.struct(f.alias("f"), F.element_at("m", f).alias("v"))), lambda x: x["v"].isNotNull())
    sent = parsed.select("record_key", F.explode("tos").alias("to"), "m").select("to.file_id", "record_key", "to.is_now", held(F.col("to")).alias("values"))
    side = lambda now: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("is_now") == now, F.col("values")))))
    pairs = checkpointed(
        sent.groupBy("file_id", "record_key").agg(side(False).alias("o"), side(True).alias("w"), F.bool_and("is_now").alias("only_now"), F.bool_or("is_now").alias("now"))
        .where("now AND NOT only_now").select("file_id", "record_key", "o", "w")
    )
    counts = lambda c, out: pairs.select("file_id", F.explode(F.array_distinct(F.transform(c, lambda x: x["f"]))).alias(out)).groupBy("file_id", out).agg(F.count("*").alias(f"n_{out}"))
    tagged = lambda c, now: F.transform(c, lambda x: F.struct(x["v"].alias("v"), x["f"].alias("f"), F.lit(now).alias("is_now")))
    names = lambda now: F.collect_set(F.when(F.col("z.is_now") == now, F.col("z.f")))
    equal = (
        pairs.select("file_id", "record_key", F.explode(F.concat(tagged("o", False), tagged("w", True))).alias("z"))
        .groupBy("file_id", "record_key", "z.v").agg(names(False).alias("o"), names(True).alias("w")).where("size(o) > 0 AND size(w) > 0")
        .select("file_id", "record_key", F.explode("o").alias("old"), "w").select("file_id", "record_key", "old", F.explode("w").alias("new")).distinct()
        .groupBy("file_id", "old", "new").agg(F.count("*").alias("same"))
    )
    near = equal.join(counts("o", "old"), ["file_id", "old"]).join(counts("w", "new"), ["file_id", "new"]).where(F.col("same") >= F.greatest("n_old", "n_new") * F.lit(share))
    near = checkpointed(near)
    has = lambda c, f: F.exists(c, lambda x: x["f"] == f)
    together = (
        pairs.join(bounded_broadcast(near.groupBy("file_id").agg(F.collect_list(F.struct("old", "new")).alias("pairs")), 2_000), "file_id")
        .select("file_id", F.explode(F.filter("pairs", lambda p: has("o", p["old"]) & has("w", p["new"]))).alias("p"))
        .groupBy("file_id", "p.old", "p.new").agg(F.count("*").alias("n_both"))
    )
    counted = near.join(together, ["file_id", "old", "new"]).select("file_id", "old", "new", "same", (F.col("n_old") + F.col("n_new") - F.col("n_both")).alias("n"))
    return counted.where(F.col("same") >= F.col("n") * F.lit(share))


def _changes(records: DataFrame, h: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(changes, renames) of files whose headers `h` are given; renames are file_id, old, new."""
    # Tables of files and fields are small and used several times: each is kept once, so that no plan holds them twice.
    files = checkpointed(_files(records).where("prev_id IS NOT NULL"))
    h = h.select("file_id", "field", "bits")
    now = files.join(h, "file_id").select("file_id", "prev_id", "field", F.col("bits").alias("now"))
    before = files.join(h.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "prev_id", "field", F.col("bits").alias("before"))
    both = checkpointed(now.join(before, ["file_id", "prev_id", "field"], "full"))
    gone = both.where("now IS NULL").select("file_id", F.col("field").alias("old"))
    come = both.where("before IS NULL").select("file_id", F.col("field").alias("new"))
    matched = _compared(records, both, share)
    best = lambda side, other: F.row_number().over(W.partitionBy("file_id", side).orderBy((F.col("same") / F.col("n")).desc(), F.col("n").desc(), other))
    renamed = checkpointed(matched.withColumn("a", best("old", "new")).withColumn("b", best("new", "old")).where("a = 1 AND b = 1").select("file_id", "old", "new"))
    row = lambda df, kind, field, new: df.select("file_id", F.lit(kind).alias("change_kind"), F.col(field).alias("field_name"), new.alias("new_name"))
    retyped = both.withColumn("p", promoted(F.col("before"))).withColumn("q", promoted(F.col("now"))).where("now IS NOT NULL AND before IS NOT NULL AND p <> q")
    changes = (
        row(renamed, "renamed", "old", F.col("new"))
        .unionByName(row(gone.join(renamed, ["file_id", "old"], "left_anti"), "removed", "old", F.lit("")))
        .unionByName(row(come.join(renamed, ["file_id", "new"], "left_anti"), "added", "new", F.lit("")))
        .unionByName(row(retyped, "retyped", "field", F.lit("")))
    )
    return changes, renamed


def schema_changes(records: DataFrame, share: float = 0.8) -> DataFrame:
    """(file_id, change_kind, field_name, new_name): each file's fields against those of the file before it in its series.

    A field that is gone is `renamed` to one that has come if, among the record keys in both files where
    either is not null, at least `share` hold the same value as text; of several such pairs each field
    takes its best (share, then count, then name). Otherwise `removed` or `added`. `retyped`: in both files
    with another promoted type; a field with nulls only has no type. A series' first file reports nothing.

    Repeated rows count once; a key with several records holds all their values. Null payloads are records
    without fields. Values of gone and new fields alone are compared, and only in files that have both.
    """
    return _changes(records, checkpointed(headers(records)), share)[0]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each file's fields with the name their line of renames began under; rows sorted by series and file. State: the fields of two files.

    A field that comes back or is new under a name another line still bears gets the name with a number.
    """
    series = file = None
    before: dict[str, str] = {}
    fields: list[tuple[str, str | None]] = []
    columns = ["file_id", "field", "name"]

    def closed() -> list[tuple[int, str, str]]:
        nonlocal before
        now: dict[str, str] = {}
        for field, old in fields:
            line = before.get(old if old is not None else field)
            if line is not None:
                now[field] = line
        taken = set(now.values())
        for field, _ in fields:
            if field not in now:
                name, n = field, 1
                while name in taken:
                    n += 1
                    name = f"{field}_{n}"
                now[field] = name
                taken.add(name)
        before = now
        return [(file, field, name) for field, name in now.items()]

    for pdf in batches:
        out: list[tuple[int, str, str]] = []
        for s, f, field, old in zip(pdf["series_no"].tolist(), pdf["file_id"].tolist(), pdf["field"].tolist(), pdf["old"].tolist()):
            if (s, f) != (series, file):
                out += closed() if fields else []
                fields = []
                if s != series:
                    before = {}
                series, file = s, f
            fields.append((field, old if isinstance(old, str) else None))
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(closed() if fields else [], columns=columns)


KEYS = ("series_no", "file_no", "file_id", "record_key")


def column_names(names: list[str], taken: tuple[str, ...] = KEYS) -> list[str]:
    """A column name for each field name, in their order. Column names are not told apart by letter case: a second one gets a number, one like a key column a `_`."""
    used = {k.lower() for k in taken}
    out = []
    for name in names:
        column = f"{name}_" if name.lower() in used and name.lower() in taken else name
        n = 1
        while column.lower() in used:
            n += 1
            column = f"{name}_{n}"
        used.add(column.lower())
        out.append(column)
    return out


def _unified(records: DataFrame, table_name: str, share: float) -> tuple[DataFrame, DataFrame, list[tuple[str, str | None, str]]]:
    """(records of the table, (file_id, field, name) of its files, [(name, type, column)] of the union schema)."""
    mine = records.where(F.col("table_name") == table_name).select("series_no", "file_no", "file_id", "table_name", "record_key", "payload").distinct()
    h = checkpointed(headers(mine))
    renames = _changes(mine, h, share)[1].select("file_id", F.col("new").alias("field"), "old")
    lines = checkpointed(
        h.select("series_no", "file_no", "file_id", "field").join(renames, ["file_id", "field"], "left")
        .repartition("series_no").sortWithinPartitions("series_no", "file_no", "file_id", "field")
        .select("series_no", "file_id", "field", "old").mapInPandas(_fold, "file_id long, field string, name string")
    )
    fields = h.join(lines, ["file_id", "field"]).groupBy("name").agg(promoted(F.bit_or("bits")).alias("type"), F.min(F.struct("file_no", "series_no")).alias("since")).collect()
    ordered = sorted(fields, key=lambda r: (r["since"], r["name"]))
    schema = [(r["name"], r["type"], c) for r, c in zip(ordered, column_names([r["name"] for r in ordered]))]
    return mine, lines, schema


def union_schema(records: DataFrame, table_name: str, share: float = 0.8) -> DataFrame:
    """(table_name, column_name, field_name, type): the columns of `union_table`, the field each began as, and the lattice's type.

    Columns whose names differ in letter case alone are told apart by a number in order of the files they
    began in. A field with nulls only is a string.
    """
    schema = _unified(records, table_name, share)[2]
    rows = [(table_name, c, name, t or "string") for name, t, c in schema]
    return records.sparkSession.createDataFrame(rows, "table_name string, column_name string, field_name string, type string")


def union_table(records: DataFrame, table_name: str, share: float = 0.8) -> DataFrame:
    """One consistent table of all files of `table_name`: file keys and the union of the fields under one name and type each.

    Renamed fields keep the name their line began under (see `union_schema` for the columns' names); types
    are the lattice's join over all files. Only field names (the union schema) reach the driver. Repeated rows
    count once. A value that does not fit stays null; no file of that name gives the key columns alone.
    """
    mine, lines, schema = _unified(records, table_name, share)
    names = lines.groupBy("file_id").agg(F.map_from_entries(F.collect_set(F.struct("name", "field"))).alias("names"))
    rows = mine.join(names, "file_id", "left").withColumn("m", F.transform_values(F.from_json("payload", "map<string,variant>"), lambda _, v: _text(v)))
    value = lambda c: F.element_at("m", F.element_at("names", F.lit(c)))
    return rows.select(*KEYS, *[value(name).try_cast(SPARK_TYPE.get(t, "string")).alias(c) for name, t, c in sorted(schema, key=lambda x: x[2])])


def union_values(records: DataFrame, table_name: str, share: float = 0.8) -> DataFrame:
    """(table_name, file_id, record_key, column_name, value, number): the values of `union_table` that are not null, one row each; fractional ones as numbers, others as text."""
    t = union_table(records, table_name, share)
    cell = lambda c, kind: F.struct(F.lit(c).alias("column_name"), (F.lit(None) if kind == "double" else F.col(f"`{c}`")).cast("string").alias("value"), (F.col(f"`{c}`") if kind == "double" else F.lit(None)).cast("double").alias("number"))
    cells = [cell(c, kind) for c, kind in t.dtypes if c not in KEYS] or [F.struct(F.lit("").alias("column_name"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("number"))]
    held = F.filter(F.array(*cells), lambda x: x["value"].isNotNull() | x["number"].isNotNull())
    return t.select(F.lit(table_name).alias("table_name"), "file_id", "record_key", F.explode(held).alias("x")).select("table_name", "file_id", "record_key", "x.column_name", "x.value", "x.number")
