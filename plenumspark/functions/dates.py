"""Partial dates, years of protocols, year ranges and periods."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def partial_flag(x: Column | str) -> Column:
    """Y, M or D by how much of a date is given, X for none."""
    n = F.length(_c(x))
    return F.when(n == 4, "Y").when(n == 7, "M").when(n == 10, "D").otherwise("X")


def partial_date(x: Column | str, extend: bool = False) -> Column:
    """The date of `yyyy`, `yyyy-mm` or `yyyy-mm-dd`: the first day of what is given, or the last if `extend`; null if it is none."""
    s, n = _c(x), F.length(_c(x))
    first = F.when(n == 4, F.concat(s, F.lit("-01-01"))).when(n == 7, F.concat(s, F.lit("-01"))).when(n == 10, s).try_cast("date")
    if not extend:
        return first
    return F.when(n == 4, F.date_sub(F.add_months(first, 12), 1)).when(n == 7, F.last_day(first)).otherwise(first)


def year_of_protocol(name: Column | str) -> Column:
    """The first four digits after `prot-`; null if the name has none."""
    return F.regexp_extract(_c(name), r"^prot-(\d{4})", 1).try_cast("int")


def year_of_date(date: Column | str) -> Column:
    """The four digits a date begins with, whether it is complete or not."""
    return F.regexp_extract(_c(date), r"^(\d{4})", 1).try_cast("int")


def parse_years(text: str) -> list[tuple[int, int]]:
    """Ranges of "1920-1938,1955" in order, overlapping and adjoining ones joined. Negative years are allowed."""
    spans = []
    for part in text.replace(" ", "").split(","):
        if not part:
            continue
        m = re.fullmatch(r"(-?\d+)(?:-(-?\d+))?", part)
        if not m:
            raise ValueError(f"no range of years: {part}")
        a, b = int(m.group(1)), int(m.group(2) or m.group(1))
        spans.append((min(a, b), max(a, b)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def in_years(year: Column | str, text: str) -> Column:
    """A filter that reaches the scan: whether the year is in the ranges of `text`."""
    out = F.lit(False)
    for a, b in parse_years(text):
        out = out | _c(year).between(a, b)
    return out


def truncated_year(year: Column | str, key: str) -> Column:
    """The first year of the lustrum or decade, or the year."""
    step = {"lustrum": 5, "decade": 10}.get(key)
    return _c(year) - F.pmod(_c(year), F.lit(step)) if step else _c(year)


def period(year: Column | str, key: str | Mapping[str, tuple[int, int]] | None, default: Column | None = None) -> Column:
    """The label of a year's period.

    key: `year`, `lustrum` ("1950-1954"), `decade` ("1950-1959"), named periods {name: (from, to)} or
    ranges "1920-1938,1955" (the first that holds the year wins); otherwise `default`. A null year, or one
    in no period, has `default` or null.
    """
    y = _c(year)
    fallback = default if default is not None else F.lit(None).cast("string")
    if isinstance(key, Mapping):
        out = None
        for name, (a, b) in key.items():
            hit = y.between(a, b)
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        return out.otherwise(fallback) if out is not None else fallback
    if key == "year":
        return F.coalesce(y.cast("string"), fallback)
    if key in ("lustrum", "decade"):
        low = truncated_year(y, key)
        return F.coalesce(F.concat(low.cast("string"), F.lit("-"), (low + (4 if key == "lustrum" else 9)).cast("string")), fallback)
    if isinstance(key, str) and re.search(r"\d", key):
        return period(y, {(f"{a}-{b}" if a != b else f"{a}"): (a, b) for a, b in parse_years(key)}, default)
    if key in (None, "protocol", "none", "document"):
        return fallback
    raise ValueError(f"unknown period: {key}")
