"""Attributes as known at event time: bitemporal as-of join in time shards."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import checkpointed, shuffle_partitions

#: Rows of one entity beyond which it is cut into time shards of about this size.
SHARD_ROWS = 20_000

_OUT = "entity string, day int, version bigint"
_SCHEMA = pa.schema([("entity", pa.string()), ("day", pa.int32()), ("version", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge of one task's shards: rows come sorted by (entity, shard, day, kind).

    Versions already begun wait in a heap, best first; those at its top that ended by
    the day asked for are dropped for good, as days only grow.
    """
    current, heap = None, []
    for batch in batches:
        entities, days, versions = [], [], []
        c = batch.to_pydict()
        for entity, shard, day, kind, end, start, known, version in zip(*(c[f] for f in ("entity", "shard", "day", "kind", "end", "start", "known", "version")), strict=True):
            if (entity, shard) != current:
                current, heap = (entity, shard), []
            if kind == 0:
                heapq.heappush(heap, (-start, -known, -version, end))
                continue
            while heap and heap[0][3] <= day:
                heapq.heappop(heap)
            if heap:
                entities.append(entity)
                days.append(day)
                versions.append(-heap[0][2])
        yield pa.RecordBatch.from_arrays([pa.array(entities, pa.string()), pa.array(days, pa.int32()), pa.array(versions, pa.int64())], schema=_SCHEMA)


def as_known(events: DataFrame, versions: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(entity, event, version): for each event the version valid and known at its day.

    ``events``: entity, event (of any type that can be compared), day. ``versions``:
    entity, version (bigint), start, end, known_day, known (all integers; end
    exclusive). Of several, the one with the latest start, then known, then version
    wins; events without one give no row. NULL in entity or day of an event, or in any
    field of a version, leaves the row out. Repeated rows count once.

    The answer depends on entity and day alone, so each day is asked once per entity
    and the answers are joined back to the events: an entity that a third of all
    events name brings no more days than the calendar has. Of versions alike in begin
    and end only the best is kept.

    Entities that still have more than ``shard_rows`` rows are cut into shards of time
    of about that many. The shard of a day is joined by entity and day, as the days
    of all rows and ends are at hand; nothing is broadcast by hint. A version that may
    still win after its shard is carried into the later shards that it reaches: within
    one shard only those that no better version outlives. Shards are then merged each
    on its own.
    """
    asked = events.where("entity IS NOT NULL AND day IS NOT NULL AND event IS NOT NULL").select("entity", "event", "day").distinct()
    best = F.max(F.struct("start", "known", "version"))
    usable = checkpointed(
        versions.select("entity", "version", "start", "end", "known_day", "known").dropna()
        .withColumn("day", F.greatest("start", "known_day"))
        .where("day < end")
        .groupBy("entity", "day", "end").agg(best.alias("b"))
        .select("entity", "day", "end", "b.start", "b.known", "b.version")
    )
    wanted = asked.select("entity", "day").distinct()
    days = wanted.select("entity", "day", F.lit(1).alias("n")).unionByName(usable.select("entity", "day", F.lit(1).alias("n"))).unionByName(usable.select("entity", (F.col("end") - 1).alias("day"), F.lit(0).alias("n")))
    daily = days.groupBy("entity", "day").agg(F.sum("n").alias("n"))
    large = daily.groupBy("entity").agg(F.sum("n").alias("n")).where(F.col("n") > shard_rows).select("entity")
    # one row per entity and calendar day
    so_far = F.coalesce(F.sum("n").over(Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = checkpointed(daily.join(large, "entity").select("entity", "day", F.floor(so_far / shard_rows).cast("int").alias("shard")))
    if shards.limit(1).count():
        at = lambda df: df.join(shards, ["entity", "day"], "left").withColumn("shard", F.coalesce("shard", F.lit(0)))
        questions, placed = at(wanted), at(usable)
        reach = shards.select("entity", (F.col("day") + 1).alias("end"), F.col("shard").alias("last"))
        # Carry-in of cut entities: of a shard's versions, those no better version outlives.
        better = Window.partitionBy("entity", "shard").orderBy(F.desc("start"), F.desc("known"), F.desc("version")).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            placed.join(reach, ["entity", "end"])
            .withColumn("outlived", F.max("end").over(better))
            .where("(outlived IS NULL OR end > outlived) AND last > shard")
            .withColumn("shard", F.explode(F.sequence(F.col("shard") + 1, F.col("last"))))
        )
        placed = placed.unionByName(carried.select(*placed.columns))
    else:
        questions, placed = wanted.withColumn("shard", F.lit(0)), usable.withColumn("shard", F.lit(0))
    merged = placed.withColumn("kind", F.lit(0)).unionByName(questions.withColumn("kind", F.lit(1)), allowMissingColumns=True).select("entity", "shard", "day", "kind", "end", "start", "known", "version")
    n = shuffle_partitions(events.sparkSession)
    answers = merged.repartition(n, "entity", "shard").sortWithinPartitions("entity", "shard", "day", "kind").mapInArrow(_merge, _OUT)
    return asked.join(answers, ["entity", "day"]).select("entity", "event", "version")
