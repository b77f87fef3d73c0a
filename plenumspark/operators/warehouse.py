"""The metadata warehouse: raw tables to code tables, persons, terms of office and party history.

Each builder is a function of DataFrames; `build` runs them in order. Surrogate keys follow a total order:
by a window for code tables of a few thousand rows, by range partitions for persons, terms and histories.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plenumspark.functions.dates import partial_date, partial_flag
from plenumspark.operators.numbering import number_rows

# Code tables, and the colours of parties by abbreviation.
FIRST_YEAR, LAST_YEAR = 1867, 2030
GENDERS = [(0, "Okänt", "?", "unknown"), (1, "Man", "M", "man"), (2, "Kvinna", "K", "woman")]
CHAMBERS = [(0, "", ""), (1, "Första kammaren", "FK"), (2, "Andra kammaren", "AK"), (3, "Sveriges riksdag", "EK")]
OFFICES = [(0, "unknown"), (1, "Ledamot"), (2, "Minister"), (3, "Talman")]
SUB_OFFICES = [
    (0, 0, "unknown", None, None),
    (1, 1, "Ledamot av första kammaren", 1, "förstakammarledamot"),
    (2, 1, "Ledamot av andra kammaren", 2, "andrakammarledamot"),
    (3, 1, "ledamot av Sveriges riksdag", 3, "ledamot av Sveriges riksdag"),
    (4, 2, "minister (ospecificerad)", None, None),
    (5, 3, "talman (ospecificerad)", None, None),
]
NO_PARTY = (0, "Okänt", "[-]", "#000000", 5)
COLOURS = {
    "C": "#009933", "Kd": "#000077", "Sp": "#FF112d", "L": "#006AB3", "Mp": "#83CF39", "M": "#52BDEC", "Nyd": "#007700",
    "S": "#E8112d", "Sd": "#DDDD00", "V": "#DA291C",
}


@dataclass(frozen=True)
class Spec:
    """How a raw table becomes a typed one. Steps in this order: computed columns, duplicates, renames, copies, booleans."""

    types: dict[str, str]
    compute: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)
    drop_duplicates: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)
    copy: dict[str, str] = field(default_factory=dict)
    partial_dates: dict[str, bool] = field(default_factory=dict)
    order: str | None = None


def conform(raw: DataFrame, spec: Spec) -> DataFrame:
    """`raw` by its spec. Of duplicates the first in `order` stays; values that don't fit their type are null.

    partial_dates: column -> whether a partial date is extended to its last day; keeps the text as <column>0
    and the precision as <column>_flag.
    """
    df = raw
    for name, how in spec.compute.items():
        df = df.withColumn(name, how(df))
    for name, extend in spec.partial_dates.items():
        df = df.withColumn(f"{name}0", F.col(name)).withColumn(f"{name}_flag", partial_flag(f"{name}0")).withColumn(name, partial_date(f"{name}0", extend))
    if spec.drop_duplicates:
        w = W.partitionBy(*spec.drop_duplicates).orderBy(spec.order or F.lit(0), *[c for c in sorted(df.columns) if c != spec.order])
        df = df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    for old, new in spec.rename.items():
        df = df.withColumnRenamed(old, new)
    for old, new in spec.copy.items():
        df = df.withColumn(new, F.col(old))
    return df.select(*[_typed(F.col(c), t).alias(c) for c, t in spec.types.items()])


def _typed(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.when(F.lower(c.cast("string")).isin("true", "1", "t", "yes"), True).when(c.isNotNull(), False)
    return c.try_cast(kind)


def numbered(df: DataFrame, out: str, *order: str, offset: int | Column = 0) -> DataFrame:
    """`df` with surrogate keys from 1 + offset in the given total order."""
    return df.withColumn(out, (F.row_number().over(W.orderBy(*order)) + offset).cast("int"))


def years(spark: SparkSession, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def genders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GENDERS, "gender_id int, gender string, gender_abbrev string, gender_source string")


def chambers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHAMBERS, "chamber_id int, chamber string, chamber_abbrev string")


def office_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OFFICES, "office_type_id int, office string")


def code_table(values: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """(key, name): the distinct values numbered from 1 in order, and 0 for `unknown`."""
    distinct = values.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()
    zero = values.sparkSession.createDataFrame([(0, "unknown")], f"{key} int, {name} string")
    return zero.unionByName(numbered(distinct, key, name).select(key, name))


def governments(raw: DataFrame) -> DataFrame:
    g = raw.select("government", F.col("start").try_cast("date").alias("start_date"), F.col("end").try_cast("date").alias("end_date"))
    return numbered(g, "government_id", "start_date", "government").select("government_id", "government", "start_date", "end_date")


def sub_office_types(ministers: DataFrame, speakers: DataFrame) -> DataFrame:
    """The fixed types, then the roles of ministers and of speakers, numbered on after each other."""
    schema = "sub_office_type_id int, office_type_id int, description string, chamber_id int, identifier string"
    fixed = ministers.sparkSession.createDataFrame(SUB_OFFICES, schema)
    chamber = F.when(F.col("role").contains("första kammaren"), 1).when(F.col("role").contains("andra kammaren"), 2).otherwise(3)
    roles = lambda df: df.select("role").where("role IS NOT NULL").distinct()
    kinds = roles(ministers).select(F.lit(2).alias("office_type_id"), "role", F.lit(None).cast("int").alias("chamber_id")).unionByName(roles(speakers).select(F.lit(3).alias("office_type_id"), "role", chamber.alias("chamber_id")))
    named = numbered(kinds, "sub_office_type_id", "office_type_id", "role", offset=max(x[0] for x in SUB_OFFICES))
    return fixed.unionByName(named.select("sub_office_type_id", "office_type_id", F.col("role").alias("description"), "chamber_id", F.col("role").alias("identifier")))


def person_names(names: DataFrame) -> DataFrame:
    """(person_id, name): the primary name, else the last in order."""
    return names.groupBy("person_id").agg(F.coalesce(F.max(F.when(F.col("primary_name"), F.col("name"))), F.max("name")).alias("name"))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`old` with the columns of the rows in `new` that have its key; of several such rows the largest values. Other rows stay."""
    n = new.groupBy(F.col(key).alias("__k")).agg(F.lit(True).alias("__hit"), *[F.max(c).alias(f"__{c}") for c in columns])
    j = old.join(n, old[key] == n["__k"], "left")
    return j.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(old[c]).alias(c) if c in columns else old[c] for c in old.columns])


def persons_of_interest(used: DataFrame, person: DataFrame, names: DataFrame, wiki: DataFrame) -> DataFrame:
    """Persons that occur in the corpus (used: person_id), with what the register knows of them; `unknown` has pid 0."""
    spark = used.sparkSession
    base = used.select("person_id").where("person_id IS NOT NULL").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    base = base.select("person_id", F.lit(0).alias("gender_id"), none("int").alias("party_id"), F.lit("").alias("name"), none("int").alias("year_of_birth"), none("int").alias("year_of_death"), F.lit(False).alias("has_multiple_parties"), F.lit("unknown").alias("wiki_id"))
    g = person.join(F.broadcast(genders(spark)), person["gender"] == F.col("gender_source")).select("person_id", F.col("gender_id"))
    base = upsert(base, g, "person_id", ["gender_id"])
    born = person.select("person_id", F.substring("born", 1, 4).try_cast("int").alias("year_of_birth"), F.substring("dead", 1, 4).try_cast("int").alias("year_of_death"))
    base = upsert(base, born, "person_id", ["year_of_birth", "year_of_death"])
    base = upsert(base, person_names(names), "person_id", ["name"])
    base = upsert(base, wiki, "person_id", ["wiki_id"])
    return with_pid(base)


def with_pid(persons: DataFrame) -> DataFrame:
    """Persons numbered from 0 with `unknown` first."""
    p = persons.withColumn("__u", F.col("person_id") != "unknown")
    return number_rows(p, ["__u", "person_id"], "pid").drop("__u")


def person_locations(persons: DataFrame, specifiers: DataFrame, locations: DataFrame) -> DataFrame:
    """(person_location_id, person_id, location_id)."""
    j = persons.select("person_id").join(specifiers, "person_id").join(locations.withColumnRenamed("location_name", "location"), "location").select("person_id", "location_id")
    return number_rows(j, ["person_id", "location_id"], "person_location_id", 1).select("person_location_id", "person_id", "location_id")


def terms_of_office(persons: DataFrame, members: DataFrame, ministers: DataFrame, speakers: DataFrame, districts: DataFrame, government: DataFrame, sub_types: DataFrame) -> DataFrame:
    """The distinct terms of members, ministers and speakers with their sub-types; ids in a total order.

    The raw tables have person_id, start, start_flag, end, end_flag, role and, by kind, district or government.
    """
    year = lambda c: F.substring(F.col(c).cast("string"), 1, 4).try_cast("int")
    none = F.lit(None).cast("int")
    p = persons.select("person_id").distinct()

    def kind(raw: DataFrame, office: int, district: Column, government_id: Column) -> DataFrame:
        t = sub_types.where(F.col("identifier").isNotNull() if office == 1 else (F.col("office_type_id") == office)).select(F.col("identifier").alias("role"), "sub_office_type_id").dropDuplicates(["role"])
        j = raw.join(p, "person_id").join(t, "role", "left")
        return j.select(
            "person_id", F.lit(office).alias("office_type_id"), F.coalesce("sub_office_type_id", F.lit(0)).alias("sub_office_type_id"), district.alias("district_id"),
            F.col("start").alias("start_date"), "start_flag", F.col("end").alias("end_date"), "end_flag", year("start").alias("start_year"), year("end").alias("end_year"), government_id.alias("government_id"),
        )

    m = kind(members.join(districts.select("district", "district_id"), "district", "left"), 1, F.coalesce("district_id", F.lit(0)), none)
    g = kind(ministers.join(government.select("government", "government_id"), "government"), 2, none, F.col("government_id"))
    s = kind(speakers, 3, none, none)
    out = m.unionByName(g).unionByName(s).distinct()
    return number_rows(out, out.columns, "terms_of_office_id", 1).select(F.col("terms_of_office_id").cast("int").alias("terms_of_office_id"), *out.columns)


def minister_governments(terms: DataFrame) -> DataFrame:
    m = terms.where("office_type_id = 2").select("terms_of_office_id", "government_id")
    return number_rows(m, ["government_id", "terms_of_office_id"], "minister_government_id", 1).select("minister_government_id", "terms_of_office_id", "government_id")


def parties(raw: DataFrame) -> DataFrame:
    """(party_id, party, party_abbrev, party_color, sort_order) of the distinct parties, and 0 for none."""
    schema = "party_id int, party string, party_abbrev string, party_color string, sort_order int"
    p = raw.groupBy("party").agg(F.max("abbreviation").alias("party_abbrev"), F.max("sort_order").cast("int").alias("sort_order"))
    colours = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    p = numbered(p, "party_id", "sort_order", "party").withColumn("party_color", F.coalesce(F.element_at(colours, F.col("party_abbrev")), F.lit("#000000")))
    return raw.sparkSession.createDataFrame([NO_PARTY], schema).unionByName(p.select("party_id", "party", "party_abbrev", "party_color", "sort_order"))


def person_parties(persons: DataFrame, affiliations: DataFrame, known: DataFrame, party: DataFrame) -> DataFrame:
    """The party history of persons; row 0 is `unknown`. known: source_party, party."""
    year = lambda c: F.substring(F.col(c).cast("string"), 1, 4).try_cast("int")
    a = (
        affiliations.withColumnRenamed("party", "source_party").join(persons.select("person_id").distinct(), "person_id")
        .join(known.select("source_party", "party").distinct(), "source_party").join(party.select("party", "party_id"), "party")
        .select("person_id", F.lit(2).alias("source_id"), "party_id", F.col("start").alias("start_date"), "start_flag", F.col("end").alias("end_date"), "end_flag", year("start").alias("start_year"), year("end").alias("end_year"))
    )
    rows = number_rows(a, a.columns, "person_party_id", 1).select(F.col("person_party_id").cast("int").alias("person_party_id"), *a.columns)
    zero = rows.sparkSession.createDataFrame([(0, "unknown", 1, 0, "X", "X")], "person_party_id int, person_id string, source_id int, party_id int, start_flag string, end_flag string")
    rows = rows.unionByName(zero, allowMissingColumns=True)
    several = rows.groupBy("person_id").agg((F.count_distinct("party_id") > 1).alias("has_multiple_parties"))
    return rows.join(several, "person_id")


def with_single_party(persons: DataFrame, history: DataFrame) -> DataFrame:
    """Persons with has_multiple_parties, and party_id of those with one party."""
    h = history.groupBy("person_id").agg(F.count_distinct("party_id").alias("__n"), F.max("party_id").alias("__party"))
    j = persons.join(h, "person_id", "left")
    return j.withColumn("has_multiple_parties", F.coalesce(F.col("__n") > 1, F.lit(False))).withColumn("party_id", F.when(F.col("__n") == 1, F.col("__party")).otherwise(F.col("party_id"))).drop("__n", "__party")


def build(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of the warehouse from the raw ones.

    raw: utterances (person_id), person, name, wiki_id, member_of_parliament, minister, speaker, government,
    location_specifier, known_parties, party_affiliation.
    """
    spark = raw["person"].sparkSession
    out = {"years": years(spark), "gender": genders(spark), "chamber": chambers(spark), "office_type": office_types(spark)}
    out["district"] = code_table(raw["member_of_parliament"], "district", "district_id", "district")
    out["location"] = code_table(raw["location_specifier"], "location", "location_id", "location_name")
    out["government"] = governments(raw["government"])
    out["sub_office_type"] = sub_office_types(raw["minister"], raw["speaker"])
    out["person_name"] = person_names(raw["name"])
    persons = persons_of_interest(raw["utterances"], raw["person"], raw["name"], raw["wiki_id"])
    out["person_location"] = person_locations(persons, raw["location_specifier"], out["location"])
    out["terms_of_office"] = terms_of_office(persons, raw["member_of_parliament"], raw["minister"], raw["speaker"], out["district"], out["government"], out["sub_office_type"])
    out["minister_government"] = minister_governments(out["terms_of_office"])
    out["party"] = parties(raw["known_parties"])
    out["person_party"] = person_parties(persons, raw["party_affiliation"], raw["known_parties"], out["party"])
    out["persons_of_interest"] = with_single_party(persons, out["person_party"])
    return out


def version_table(spark: SparkSession, version: str) -> DataFrame:
    return spark.createDataFrame([(version,)], "version string")


def check_version(table: DataFrame, version: str) -> None:
    found = table.first()
    if found is None or found["version"] != version:
        raise ValueError(f"expected version {version}, found {found['version'] if found else 'none'}")
