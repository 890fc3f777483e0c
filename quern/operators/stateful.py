"""State over ordered events in batch form: rate windows, idempotent requests, budgets, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.sharded import prefix_sum, previous_value


def rolling_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, second, n, n_window): events of each second and of the ``seconds`` that end with it.

    Events are counted per key and second before the window. With s before e, a count
    over (e - seconds, e] is a difference of two prefix sums, so a key with any number
    of seconds is cut into shards instead of sorted in one task.
    """
    second = F.unix_timestamp(F.col(ts).cast("timestamp"))
    daily = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(key), second.alias("second")).agg(F.count(F.lit(1)).alias("n"))
    # every second also asks what had been counted when its window began
    asks = daily.select(key, (F.col("second") - seconds + 1).alias("at"), F.lit(0).alias("kind"), F.col("second").alias("for"), F.lit(0).cast("long").alias("n"))
    rows = daily.select(key, F.col("second").alias("at"), F.lit(1).alias("kind"), F.col("second").alias("for"), "n").unionByName(asks)
    summed = prefix_sum(rows, [key], ["at", "kind", "for"], "n", "before")
    both = summed.groupBy(key, F.col("for").alias("second")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == 1, F.col("before") + F.col("n")).otherwise(-F.col("before"))).alias("n_window"))
    return both


def idempotent(events: DataFrame, key: list[str], fingerprint: str, order: list[str]) -> DataFrame:
    """(key..., n_new, n_repeated, n_conflict): the first request of a key is new, later ones repeat it or conflict.

    Only the first fingerprint of a key has to be known, which is an aggregate.
    """
    first = events.groupBy(*key).agg(F.min_by(fingerprint, F.struct(*order)).alias("__first"), F.count(F.lit(1)).alias("__n")).select(*[F.col(k).alias(f"k_{k}") for k in key], "__first", "__n")
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    per = events.groupBy(*key, fingerprint).agg(F.count(F.lit(1)).alias("__m")).join(first, on)
    same = F.col(fingerprint).eqNullSafe(F.col("__first"))
    return per.groupBy(*key).agg(F.lit(1).alias("n_new"), (F.sum(F.when(same, F.col("__m")).otherwise(0)) - 1).alias("n_repeated"), F.sum(F.when(same, 0).otherwise(F.col("__m"))).alias("n_conflict"))


def budgets(events: DataFrame, key: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """``events`` with ``spent`` (cost of the key's rows before this one) and ``allowed``: spent plus cost within the budget."""
    summed = prefix_sum(events, [key], order, cost, "spent")
    return summed.withColumn("allowed", F.col("spent") + F.coalesce(F.col(cost), F.lit(0)) <= budget)


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session_start, session_end, n): events of a key less than ``gap_seconds`` apart; Spark's session window."""
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__ts", F.col(ts).cast("timestamp"))
    windowed = rows.groupBy(key, F.session_window("__ts", f"{gap_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def changes(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, n_values, first_value, last_value): how a key's value went over time, first and last by time."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("n_values"), F.min_by(value, F.struct(ts, value)).alias("first_value"), F.max_by(value, F.struct(ts, value)).alias("last_value"))


def last_seen(events: DataFrame, key: str, ts: str) -> DataFrame:
    """The last event of each key by time, all columns; of equal times the greatest row."""
    row = F.struct(ts, *[c for c in events.columns if c != ts])
    return events.groupBy(key).agg(F.max(row).alias("__row")).select("__row.*")




def conversation(events: DataFrame, key: str, order: list[str], topic: str, turns: int = 20) -> DataFrame:
    """(key, topic, n_turns, n_changes): a conversation folded: last topic, turns since it began, changes of topic.

    Turns without a topic are left out; more than ``turns`` are not counted. End
    ``order`` in a unique column. The turn before is found in shards, what follows
    are aggregates, so a key with any number of turns is never in one task.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(topic).isNotNull()).select(key, *order, topic)
    marked = previous_value(rows, [key], order, topic, "__before")
    changed = F.col("__before").isNull() | (F.col("__before") != F.col(topic))
    place = F.struct(*order)
    ends = marked.groupBy(key).agg(F.max(F.when(changed, place)).alias("__from"), F.max_by(topic, place).alias("__topic"), (F.count_if(changed) - 1).alias("n_changes")).withColumnRenamed(key, "__key")
    since = rows.join(ends, F.col(key) == F.col("__key")).where(place >= F.col("__from"))
    return since.groupBy(key).agg(F.first("__topic").alias("topic"), F.least(F.count(F.lit(1)), F.lit(turns)).alias("n_turns"), F.first("n_changes").alias("n_changes"))
