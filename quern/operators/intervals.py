"""Overlapping and gapped intervals per entity, merged into periods and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.dates import is_blank, parse_date

#: Day number of an end that is open; later than any calendar day.
OPEN = 2**31 - 1


def day_number(date: Column) -> Column:
    """Days since 1970-01-01 of a DATE column."""
    return F.unix_date(date)


def usable_intervals(rows: DataFrame, start_col: str, end_col: str) -> DataFrame:
    """``rows`` with __start and __end (day numbers, end exclusive), unusable rows left out.

    Left out: a start that is NULL, empty or no date, an end that is text but no
    date, an end not after the start. A NULL or blank end is open.
    """
    start, end = parse_date(F.col(start_col)), parse_date(F.col(end_col))
    return (
        rows.withColumn("__start", day_number(start))
        .withColumn("__end", F.when(is_blank(F.col(end_col)), F.lit(OPEN)).otherwise(day_number(end)))
        .where("__start IS NOT NULL AND __end > __start")
    )


def periods_and_gaps(rows: DataFrame, entity: str, start_col: str, end_col: str) -> DataFrame:
    """(entity, kind, start_date, end_date): PERIOD and GAP rows, dates as yyyy-MM-dd, an open end empty.

    Touching intervals make one period. Per entity and start day only the latest
    end is kept before anything is sorted, so that an entity with any number of
    rows, redelivered ones included, brings at most one row per calendar day to its
    window. Rows with a NULL entity are left out; so are those that
    ``usable_intervals`` leaves out.
    """
    daily = usable_intervals(rows.where(F.col(entity).isNotNull()).select(entity, start_col, end_col), start_col, end_col).groupBy(entity, "__start").agg(F.max("__end").alias("__end"))
    by_start = Window.partitionBy(entity).orderBy("__start")
    before = F.max("__end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("__start") > before), 1).otherwise(0)
    islands = daily.withColumn("__opens", opens).withColumn("__island", F.sum("__opens").over(by_start))
    periods = islands.groupBy(entity, "__island").agg(F.min("__start").alias("__from"), F.max("__end").alias("__to"))
    follows = F.lead("__from").over(Window.partitionBy(entity).orderBy("__island"))
    marked = periods.withColumn("__next", follows)
    both = F.array(
        F.struct(F.lit("PERIOD").alias("kind"), F.col("__from").alias("a"), F.col("__to").alias("b")),
        F.struct(F.lit("GAP").alias("kind"), F.col("__to").alias("a"), F.col("__next").alias("b")),
    )
    out = marked.select(entity, F.explode(both).alias("x")).where("x.b IS NOT NULL")
    text = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    return out.select(entity, "x.kind", text("x.a").alias("start_date"), F.when(F.col("x.b") == OPEN, "").otherwise(text("x.b")).alias("end_date"))


def closed_versions(rows: DataFrame, entity: str) -> DataFrame:
    """(entity, __start, __end, version): versions in order of time, each closed where the next one begins.

    ``rows``: entity, __start, __end, version. Of versions that begin together the one
    that lasts longest, then the greatest, counts; so an entity brings at most one row
    per calendar day to its window. Rows with a NULL entity are left out.
    """
    daily = rows.where(F.col(entity).isNotNull()).groupBy(entity, "__start").agg(F.max(F.struct("__end", "version")).alias("v")).select(entity, "__start", "v.__end", "v.version")
    after = F.lead("__start").over(Window.partitionBy(entity).orderBy("__start"))
    return daily.withColumn("__end", F.least(F.col("__end"), after))


def conflicts(rows: DataFrame, entity: str, value: str) -> DataFrame:
    """(entity, __start, __end, n): longest stretches of time in which an entity has n values at once, more than one.

    ``rows``: entity, value, __start, __end. Intervals of equal value may overlap
    without conflict. Begins and ends are summed by day, so the sweep of an entity
    takes at most one row per calendar day, however many rows it has.
    """
    daily = rows.where(F.col(entity).isNotNull() & F.col(value).isNotNull()).groupBy(entity, value, "__start").agg(F.max("__end").alias("__end"))
    per_value = Window.partitionBy(entity, value).orderBy("__start")
    reached = F.max("__end").over(per_value.rowsBetween(Window.unboundedPreceding, -1))
    # of a value only the part that lies beyond its own earlier intervals counts
    own = daily.withColumn("__from", F.greatest("__start", reached)).where("__end > __from")
    steps = own.select(entity, F.explode(F.array(F.struct(F.col("__from").alias("day"), F.lit(1).alias("step")), F.struct(F.col("__end").alias("day"), F.lit(-1).alias("step")))).alias("x"))
    by_day = steps.groupBy(entity, F.col("x.day").alias("__start")).agg(F.sum("x.step").alias("step")).where("step <> 0")
    order = Window.partitionBy(entity).orderBy("__start")
    return by_day.withColumn("n", F.sum("step").over(order)).withColumn("__end", F.lead("__start").over(order)).where("n > 1").select(entity, "__start", "__end", "n")
