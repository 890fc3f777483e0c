"""The stateful operators as Structured Streaming jobs over a stream of events.

Tumbling and session windows with a watermark are extensions of our own; the
registry, the rate window and the conversation state are the batch operators of
``operators.stateful`` in streaming form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, window_start, n) per tumbling window; events later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    counted = timed.groupBy(F.window("__ts", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), "n")


def rate_exceeded(events: DataFrame, ts: str, key: str, most: int, late: str = "2 minutes") -> DataFrame:
    """(key, window_end, n): sliding minutes, by ten seconds, in which a key made more than ``most`` requests."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    counted = timed.groupBy(F.window("__ts", "60 seconds", "10 seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > most).select(key, F.col("w.end").alias("window_end"), "n")


def first_requests(events: DataFrame, ts: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark: repeated deliveries are dropped, state expires."""
    return events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark(key).drop("__ts")


def folded_state(events: DataFrame, key: str, ts: str, topic: str, turns: int = 20) -> DataFrame:
    """(key, n_turns, topic, n_changes): a conversation folded turn by turn.

    A turn with another topic resets the count of turns; more than ``turns`` are not
    counted. State is one small tuple per key, whatever the number of turns.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, current, changes = state.get if state.exists else (0, None, 0)
        for turn in pd.concat(list(batches)).sort_values("at").itertuples():
            if turn.topic is None:
                continue
            if current is not None and turn.topic != current:
                n, changes = 0, changes + 1
            current, n = turn.topic, min(n + 1, turns)
        state.update((n, current, changes))
        yield pd.DataFrame({"key": [k[0]], "n_turns": [n], "topic": [current], "n_changes": [changes]})

    rows = events.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(topic).cast("string").alias("topic"))
    return rows.groupBy("key").applyInPandasWithState(fold, "key string, n_turns int, topic string, n_changes int", "n int, topic string, changes int", "update", GroupStateTimeout.NoTimeout)
