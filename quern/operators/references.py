"""References to records that do not exist, checked against the time of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.sharded import last_value, running

#: Microsecond after every timestamp: the end of a run that is still live.
FOREVER = 2**63 - 1


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, as an integer."""
    return F.unix_micros(ts.cast("timestamp"))


def live_rows(parents: DataFrame, key: str, from_col: str, to_col: str) -> DataFrame:
    """(key, first, end): the integer microseconds [first, end) at which a row of a key is live.

    A row is live in [from, to), for ever where ``to`` is NULL. Rows with a NULL or
    empty key, a NULL ``from`` or an end not after it add nothing.
    """
    rows = parents.select(F.col(key).alias("key"), micros(F.col(from_col)).alias("first"), F.coalesce(micros(F.col(to_col)), F.lit(FOREVER)).alias("end"))
    return rows.where("key <> '' AND end > first")


def compressed(rows: DataFrame) -> DataFrame:
    """(key, first, end): the rows of ``live_rows`` that begin a contiguous run or carry one further.

    Of rows that begin together the latest end counts; a row that ends within what
    began before it adds nothing and is dropped. What is live at a moment can then be
    told from the last row that begins at or before it. A key with any number of rows
    is cut into shards, see ``sharded``.
    """
    starts = rows.groupBy("key", "first").agg(F.max("end").alias("end"))
    marked = running(starts, ["key"], ["first"], {}, {}, tops={"reached": "end"})
    return marked.where("reached IS NULL OR end > reached").select("key", "first", "end")


def live_runs(parents: DataFrame, key: str, from_col: str, to_col: str) -> DataFrame:
    """The contiguous runs of the microseconds at which each key is live, see ``live_rows`` and ``compressed``."""
    return compressed(live_rows(parents, key, from_col, to_col))


def orphans(references: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of ``references`` (key, at, ...) whose key is not live at ``at``.

    Sorted by (key, microsecond), every reference is matched as-of to the run that
    starts at or before it; it is an orphan when there is none (missing, or arrives
    later) or when it lies beyond the run's end (deleted). References with a NULL or
    empty key refer to nothing, those without a time cannot be judged: neither is
    reported. A key with a third of all references is cut into shards, see
    ``sharded``.
    """
    wanted = references.where("key <> '' AND at IS NOT NULL")
    payload = F.struct(*[F.col(c) for c in references.columns if c not in ("key", "at")])
    events = wanted.select("key", "at", F.lit(1).alias("side"), F.lit(None).cast("long").alias("end"), payload.alias("ref"))
    starts = runs.select("key", F.col("first").alias("at"), F.lit(0).alias("side"), "end", F.lit(None).cast(events.schema["ref"].dataType).alias("ref"))
    merged = events.unionByName(starts).withColumn("tie", F.xxhash64("ref"))
    matched = last_value(merged, ["key"], ["at", "side", "tie"], "end", "run_end")
    return matched.where("side = 1 AND (run_end IS NULL OR at >= run_end)").select("key", "at", "ref.*")


def reference_rows(rows: DataFrame, table: str, row_key: str, ref: str, at: str) -> DataFrame:
    """One table's references in the common form (key, at, table_name, ref_month, row_key), each once."""
    return rows.select(
        F.col(ref).alias("key"), micros(F.col(at)).alias("at"), F.lit(table).alias("table_name"), F.date_format(F.col(at), "yyyy-MM").alias("ref_month"), F.col(row_key).alias("row_key")
    ).distinct()
