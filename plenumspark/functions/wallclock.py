"""Wall-clock time as microseconds since 1970, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_micros(c: Column) -> Column:
    """Microseconds of a date, timestamp without zone or (in the session's zone) timestamp."""
    t = c.cast("timestamp_ntz")
    seconds = (F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * 1_000_000
    return F.unix_date(t.cast("date")).cast("long") * 86_400_000_000 + seconds + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")
