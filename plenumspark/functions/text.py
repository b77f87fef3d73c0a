"""String functions of the engine as Column expressions; Python only where Unicode normalisation has no built-in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Between the paragraphs of a serialised utterance (a fixed value of the exchange format).
PARAGRAPH_MARK = "@#@"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without surrounding Unicode white space; null stays null."""
    return F.regexp_replace(_c(x), r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+\z", "")


def dedent(x: Column | str) -> Column:
    """Every line stripped; a trailing line break stays."""
    return F.array_join(F.transform(F.split(_c(x), "\n"), strip), "\n")


def require_letter(x: Column | str) -> Column:
    """'' for a text without a letter of the Swedish alphabet; null stays null."""
    return F.when(_c(x).rlike("[a-zåäöA-ZÅÄÖ]"), _c(x)).when(_c(x).isNotNull(), "")


def join_paragraphs(x: Column | str) -> Column:
    """The text of an utterance: its non-empty paragraphs, one a line, stripped."""
    return strip(F.array_join(F.filter(_c(x), lambda p: p != ""), "\n"))


def encode_paragraphs(x: Column | str) -> Column:
    return F.array_join(_c(x), PARAGRAPH_MARK)


def decode_paragraphs(x: Column | str) -> Column:
    return F.split(_c(x), PARAGRAPH_MARK)


def xml_escape(x: Column | str) -> Column:
    out = _c(x)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def xml_unescape(x: Column | str) -> Column:
    out = _c(x)
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def checksum(x: Column | str) -> Column:
    """SHA-1 of a text, hexadecimal."""
    return F.sha1(_c(x))


def short_checksum(x: Column | str) -> Column:
    return F.substring(F.sha1(_c(x)), 1, 16)


def zero_fill(x: Column | str, width: int = 3) -> Column:
    """A number with at least `width` digits; longer ones are not cut."""
    return F.format_string(f"%0{width}d", _c(x).cast("long"))


@F.pandas_udf(T.StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def _decomposed(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKD")


def _normalized(x: Column, form: Callable[[Column], Column]) -> Column:
    """A Unicode normal form. ASCII texts have it and reach the worker as nulls."""
    other = x.rlike(r"[^\x00-\x7f]")
    return F.when(other, form(F.when(other, x))).otherwise(x)


def slugify(x: Column | str, allow_unicode: bool = False) -> Column:
    """Lower case, words joined by single hyphens; ASCII unless `allow_unicode`."""
    low = F.lower(_normalized(_c(x), _composed if allow_unicode else _decomposed))
    words = F.regexp_replace(low, r"(?U)[^\w\s-]|[\p{Mn}\p{Pc}&&[^_]]" if allow_unicode else r"[^a-z0-9_\s\x1c-\x1f-]", "")
    return F.regexp_replace(F.regexp_replace(words, r"(?U)[\s\x1c-\x1f-]+", "-"), "^[-_]+|[-_]+$", "")


# Letters that have no decomposition and their ASCII spelling.
_SPELLED = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ı": "i"}


def without_accents(x: Column | str) -> Column:
    """Letters without their marks; those that can't be taken apart are spelled in ASCII."""
    plain = F.regexp_replace(_normalized(_c(x), _decomposed), r"\p{M}+", "")
    for letter, ascii_ in _SPELLED.items():
        plain = F.replace(plain, F.lit(letter), F.lit(ascii_))
    return plain


def sanitize(x: Column | str, remove_accents: bool = True) -> Column:
    """A file name: every character but letters, digits, # and _ becomes _."""
    out = without_accents(x) if remove_accents else _c(x)
    return F.regexp_replace(out, "[^a-zåäöA-ZÅÄÖ#0-9_]", "_")


def chamber_of(name: Column | str) -> Column:
    """fk, ak or ek by the name of a protocol; null stays null."""
    n = _c(name)
    return F.when(n.contains("-fk-"), "fk").when(n.contains("-ak-"), "ak").when(n.isNotNull(), "ek")


def protocol_label(name: Column | str, number: Column | None = None, chamber: Column | None = None) -> Column:
    """A readable label, "Första kammaren 1955:22 003": chamber, year(s), protocol without zeros, speech.

    A number after `_` in the name wins over `number`. A name of fewer than two parts is its own label,
    null gives ''.
    """
    n = F.regexp_replace(_c(name), r"\.xml$", "")
    parts = F.split(n, "-")
    last = F.element_at(parts, -1)
    speech = F.when(last.contains("_"), F.regexp_extract(last, "_(.*)$", 1)).otherwise(zero_fill(number) if number is not None else F.lit(""))
    year = F.get(parts, F.lit(1))
    year = F.when(F.length(year).isin(6, 8), F.concat(F.substring(year, 1, 4), F.lit("/"), F.substring(year, 5, 4))).otherwise(year)
    ch = chamber if chamber is not None else chamber_of(n)
    house = F.when(ch == "fk", "Första kammaren").when(ch == "ak", "Andra kammaren").otherwise("")
    label = F.concat(house, F.lit(" "), year, F.lit(":"), F.regexp_replace(F.regexp_extract(last, "^([^_]*)", 1), "^0+", ""), F.lit(" "), F.coalesce(speech, F.lit("")))
    return F.when(_c(name).isNull(), "").when(F.size(parts) < 2, n).otherwise(strip(label))


def base_name(path: Column | str) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"\.[^.]*$", "")


def replace_extension(path: Column | str, extension: str) -> Column:
    return F.concat(F.regexp_replace(_c(path), r"\.[^./]*$", ""), F.lit("." + extension.lstrip(".")))
