"""Part-of-speech schemes: tags, their numbers in order, and their groups (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (tag, group) in the order of the tags' numbers.
_TAGS = {
    "SUC": [
        ("AB", "Adverb"), ("DT", "Pronoun"), ("HA", "Adverb"), ("HD", "Pronoun"), ("HP", "Pronoun"), ("HS", "Pronoun"), ("IE", "Adverb"),
        ("IN", "Adverb"), ("JJ", "Adjective"), ("KN", "Conjunction"), ("NN", "Noun"), ("PC", "Verb"), ("PL", "Adverb"), ("PM", "Noun"),
        ("PN", "Pronoun"), ("PP", "Preposition"), ("PS", "Pronoun"), ("RG", "Numeral"), ("RO", "Numeral"), ("SN", "Conjunction"), ("UO", "Other"),
        ("VB", "Verb"), ("MAD", "Delimiter"), ("MID", "Delimiter"), ("PAD", "Delimiter"),
    ],
    "Universal": [
        ("ADJ", "Adjective"), ("ADP", "Preposition"), ("ADV", "Adverb"), ("AUX", "Other"), ("CONJ", "Conjunction"), ("CCONJ", "Conjunction"),
        ("DET", "Pronoun"), ("INTJ", "Adverb"), ("NOUN", "Noun"), ("NUM", "Numeral"), ("PART", "Adverb"), ("PRON", "Pronoun"), ("PROPN", "Noun"),
        ("PUNCT", "Delimiter"), ("SCONJ", "Conjunction"), ("SYM", "Other"), ("VERB", "Verb"), ("X", "Other"), ("EOL", "Delimiter"),
        ("SPACE", "Delimiter"),
    ],
    "PennTree": [
        ("$", "Other"), ("``", "Delimiter"), ("''", "Delimiter"), (",", "Delimiter"), ("-LRB-", "Delimiter"), ("-RRB-", "Delimiter"),
        (".", "Delimiter"), (":", "Delimiter"), ("ADD", "Other"), ("AFX", "Adjective"), ("CC", "Conjunction"), ("CD", "Numeral"), ("DT", "Pronoun"),
        ("EX", "Pronoun"), ("FW", "Other"), ("GW", "Other"), ("HYPH", "Delimiter"), ("IN", "Preposition"), ("JJ", "Adjective"), ("JJR", "Adjective"),
        ("JJS", "Adjective"), ("LS", "Other"), ("MD", "Verb"), ("NFP", "Delimiter"), ("NIL", "Other"), ("NN", "Noun"), ("NNP", "Noun"),
        ("NNPS", "Noun"), ("NNS", "Noun"), ("PDT", "Pronoun"), ("POS", "Adverb"), ("PRP", "Pronoun"), ("PRP$", "Pronoun"), ("RB", "Adverb"),
        ("RBR", "Adverb"), ("RBS", "Adverb"), ("RP", "Adverb"), ("SP", "Delimiter"), ("SYM", "Other"), ("TO", "Adverb"), ("UH", "Adverb"),
        ("VB", "Verb"), ("VBD", "Verb"), ("VBG", "Verb"), ("VBN", "Verb"), ("VBP", "Verb"), ("VBZ", "Verb"), ("WDT", "Pronoun"), ("WP", "Pronoun"),
        ("WP$", "Pronoun"), ("WRB", "Adverb"), ("XX", "Other"), ("_SP", "Delimiter"),
    ],
}
#: scheme -> {tag: (number, group)}
SCHEMES = {name: {tag: (i, group) for i, (tag, group) in enumerate(tags)} for name, tags in _TAGS.items()}
#: The number of a tag that the scheme doesn't have; 0 is a tag's.
UNKNOWN = -1


def scheme(name: str) -> dict[str, tuple[int, str]]:
    if name not in SCHEMES:
        raise ValueError(f"unknown scheme: {name}; known: {', '.join(SCHEMES)}")
    return SCHEMES[name]


def scheme_table(spark: SparkSession, name: str = "SUC") -> DataFrame:
    """(pos_id, tag, tag_group): a code table of a few dozen rows."""
    return spark.createDataFrame([(i, tag, group) for tag, (i, group) in scheme(name).items()], "pos_id int, tag string, tag_group string")


def _lookup(c: Column, values: dict[str, object], otherwise: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), otherwise)


def pos_id(tag: Column, name: str = "SUC") -> Column:
    """The number of a tag in either letter case, UNKNOWN for others."""
    return _lookup(F.upper(tag), {t.upper(): i for t, (i, _) in scheme(name).items()}, F.lit(UNKNOWN))


def pos_group(tag: Column, name: str = "SUC") -> Column:
    """The group of a tag in either letter case, null for unknown tags."""
    return _lookup(F.upper(tag), {t.upper(): g for t, (_, g) in scheme(name).items()}, F.lit(None).cast("string"))


def all_but(names: list[str] | str, name: str = "SUC") -> list[str]:
    """The tags of the scheme without those named, as tags, groups or "|tag|tag|"."""
    out: set[str] = set()
    for x in [names] if isinstance(names, str) else names:
        out |= {t for t, (_, g) in scheme(name).items() if g == x} or (set(x.strip("|").split("|")) if "|" in x else {x})
    return [t for t in scheme(name) if t not in out]
