"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bits of a word, as a power of two, and levels of the bitmap: with 10 levels of 64 no run of the time line is longer than a few words of the last.
BITS, LEVELS = 6, 10
#: Units reach from -LIMIT to LIMIT.
LIMIT = 1 << 61
WORD = 1 << BITS


def _bits_of(level: int) -> tuple[Column, Column]:
    """The bits of a level that lie wholly within first..last, half open."""
    unit = 1 << (BITS * level)
    return F.shiftright(F.col("first") + (unit - 1), BITS * level), F.shiftright(F.col("last") + 1, BITS * level)


def _run(level: int, a: Column, b: Column) -> Column:
    return F.when(a < b, F.struct(F.lit(level).alias("level"), a.alias("a"), b.alias("b")))


def run_bitmap(spans: DataFrame) -> DataFrame:
    """(entity, level, word, bits): the union of all spans as a compressed run bitmap.

    `spans` has entity and the units first..last, both included, first <= last. A bit of
    level l stands for 64**l units; a span sets single units at its ends and whole words above them, at
    most two words a level, however long it is. Words are united by a bitwise-or aggregate that combines
    before the shuffle, so an entity with many rows costs no more than its distinct words.
    """
    # At level l the span is the half-open run [lo, hi) of bits; where whole words lie in it, they go up a level.
    parts = []
    for level in range(LEVELS):
        lo, hi = _bits_of(level)
        if level == LEVELS - 1:
            head, tail = _run(level, lo, hi), None
        else:
            up_lo, up_hi = _bits_of(level + 1)
            whole = up_lo < up_hi
            head = _run(level, lo, F.when(whole, F.shiftleft(up_lo, BITS)).otherwise(hi))
            tail = F.when(whole, _run(level, F.shiftleft(up_hi, BITS), hi))
        parts += [x for x in (head, tail) if x is not None]
    runs = spans.select("entity", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("r")).select("entity", "r.level", "r.a", "r.b")
    # A run of one level may cross a word's edge once (or several times at the last level).
    words = runs.select("entity", "level", "a", "b", F.explode(F.sequence(F.shiftright("a", BITS), F.shiftright(F.col("b") - 1, BITS))).alias("word"))
    x = F.greatest(F.col("a") - F.col("word") * WORD, F.lit(0)).cast("int")
    y = F.least(F.col("b") - 1 - F.col("word") * WORD, F.lit(WORD - 1)).cast("int")
    masked = words.withColumn("x", x).withColumn("y", y).withColumn("bits", F.expr(f"shiftleft(shiftrightunsigned(-1L, {WORD - 1} - (y - x)), x)"))
    return masked.groupBy("entity", "level", "word").agg(F.bit_or("bits").alias("bits"))


def set_runs(bitmap: DataFrame) -> DataFrame:
    """(entity, first, last): the set runs of the bitmap's words, in units, not yet joined across words."""
    at = lambda bits: F.expr(f"filter(sequence(0, {WORD - 1}), i -> (shiftrightunsigned({bits}, i) & 1L) = 1)")
    w = bitmap.withColumn("starts", F.expr("bits & ~shiftleft(bits, 1)")).withColumn("ends", F.expr("bits & ~shiftrightunsigned(bits, 1)"))
    # Most words are one run, whose place is a bit count; only words of several runs are gone through bit by bit.
    single = F.expr(f"transform(array(CASE WHEN starts < 0 THEN {WORD - 1} ELSE bit_count(starts - 1) END), s -> struct(s AS s, s + bit_count(bits) - 1 AS e))")
    several = F.arrays_zip(at("starts").alias("s"), at("ends").alias("e"))
    w = w.withColumn("z", F.explode(F.when(F.expr("bit_count(starts) = 1"), single).otherwise(several)))
    unit = F.expr(f"shiftleft(1L, {BITS} * level)")
    return w.select("entity", ((F.col("word") * WORD + F.col("z.s")) * unit).alias("first"), ((F.col("word") * WORD + F.col("z.e") + 1) * unit - 1).alias("last"))


def periods_and_gaps(spans: DataFrame) -> DataFrame:
    """(entity, span_kind, first, last): continuous periods of the united spans and the gaps between them.

    Spans that overlap, nest or follow without a free unit are one period. What one window partition
    holds is an entity's distinct runs, bounded by the time line and not by its rows. Null entities or
    ends and reversed spans count for nothing; empty input gives no rows. Units beyond LIMIT fail the query.
    """
    within = F.when(F.greatest(F.abs("first"), F.abs("last")) > LIMIT, F.raise_error(F.lit(f"units beyond {LIMIT}"))).otherwise(F.lit(True))
    ok = spans.where("entity IS NOT NULL AND first IS NOT NULL AND last IS NOT NULL AND first <= last").where(within).select("entity", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).distinct()
    runs = set_runs(run_bitmap(ok))
    order = W.partitionBy("entity").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
    numbered = marked.withColumn("no", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    periods = numbered.groupBy("entity", "no").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    following = F.lead("first").over(W.partitionBy("entity").orderBy("no"))
    both = periods.withColumn("following", following).withColumn(
        "x", F.expr("filter(array(struct('period' AS span_kind, first AS first, last AS last), if(following IS NULL, NULL, struct('gap' AS span_kind, last + 1 AS first, following - 1 AS last))), v -> v IS NOT NULL)"),
    )
    return both.select("entity", F.explode("x").alias("x")).select("entity", "x.span_kind", "x.first", "x.last")


#: Days are counted from 0001-01-01 on, so that every date of the calendar is a unit of the bitmap.
DAY_ZERO = 719_162


def day_unit(date: Column) -> Column:
    return (F.unix_date(date) + DAY_ZERO).cast("long")


def unit_day(unit: Column) -> Column:
    return F.date_format(F.date_from_unix_date((unit - DAY_ZERO).cast("int")), "yyyy-MM-dd")
