"""Choosing from ranked lists: required groups, anchors, unions, promotions, group metrics.

Lists are as long as a query's candidates, which a top-k bounds before; windows run
over one query's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_metrics(ranked: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(query_id, group_recall, novel_precision, mrr, group_ndcg, all_found) at k of every query with a group.

    ``ranked``: query_id, id, rank; ``groups``: query_id, group, id: ids of a group are
    interchangeable. A group gains once, at its first id; an id that is in several
    groups serves the greatest. NULL groups and ids do not count, repeated rows count
    once, a query without any hit has zeros.
    """
    member = groups.where("query_id IS NOT NULL AND id IS NOT NULL AND group IS NOT NULL").groupBy("query_id", "id").agg(F.max("group").alias("group"))
    totals = groups.where("query_id IS NOT NULL AND group IS NOT NULL").groupBy("query_id").agg(F.countDistinct("group").alias("n"))
    first = ranked.where(F.col("rank") <= k).join(member, ["query_id", "id"]).groupBy("query_id", "group").agg(F.min("rank").alias("rank"))
    hits = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("best"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return totals.join(hits, "query_id", "left").select(
        "query_id", zero(F.col("hits") / F.col("n")).alias("group_recall"), zero(F.col("hits") / k).alias("novel_precision"), zero(1 / F.col("best")).alias("mrr"),
        zero(F.col("dcg") / ideal).alias("group_ndcg"), (F.coalesce("hits", F.lit(0)) == F.col("n")).alias("all_found"),
    )


def prioritized(items: DataFrame) -> DataFrame:
    """``items`` with ``place`` and ``reason``: the first item of each group, in the order of groups, then the rest as ranked.

    ``items``: query_id, id, rank, group (NULL: serves none), one row per item and
    group. An item that is first for several groups stands for the least of them.
    """
    best = F.row_number().over(Window.partitionBy("query_id", "group").orderBy("rank", "id"))
    marked = items.withColumn("__first", F.when(F.col("group").isNotNull() & (best == 1), F.col("group")))
    once = marked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"), F.min("__first").alias("group"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("group").isNull(), "group", "rank", "id"))
    return once.withColumn("place", place).withColumn("reason", F.when(F.col("group").isNotNull(), "GROUP").otherwise("RANK"))


def retained(items: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, place, origin): at most ``limit`` ids of each query, one anchor of each group first, then items as ranked.

    ``items``: query_id, id, rank; ``anchors``: query_id, group, id, rank. Where there
    are more groups than places, the least groups keep theirs. An anchor that is
    among the items anyway is ITEM, a restored one ANCHOR.
    """
    best = anchors.groupBy("query_id", "group").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))
    kept = best.groupBy("query_id", "id").agg(F.min("group").alias("group"))
    known = items.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    both = known.join(kept, ["query_id", "id"], "full")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("group").isNull(), "group", "rank", "id"))
    return both.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "id", "place", F.when(F.col("rank").isNull(), "ANCHOR").otherwise("ITEM").alias("origin"))


def union_lists(base: DataFrame, added: DataFrame, cap: int) -> DataFrame:
    """(query_id, id, rank, origin): the base list, then up to ``cap`` ids of the added list that it lacks.

    Both: query_id, id, rank; an id counts once, at its best rank.
    """
    once = lambda df: df.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    first = once(base)
    new = once(added).join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")
    new = new.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("__n") <= cap).drop("__n")
    both = first.withColumn("origin", F.lit("BASE")).unionByName(new.withColumn("origin", F.lit("ADDED")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("origin"), "rank", "id")))


def promoted(ranked: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """``ranked`` (query_id, id, rank) with ``new_rank``: ids that the first one links to move up behind it.

    ``links``: source, target. At most min(k - 1, k // 2) move, in their order; the
    rest keep theirs.
    """
    once = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    place = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))
    seed = place.where("rank = 1").select("query_id", F.col("id").alias("source"))
    targets = seed.join(links.select("source", "target").distinct(), "source").select("query_id", F.col("target").alias("id"), F.lit(1).alias("linked"))
    marked = place.join(targets, ["query_id", "id"], "left").withColumn("linked", F.coalesce("linked", F.lit(0)) * (F.col("rank") > 1).cast("int"))
    turn = F.sum("linked").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    moved = (F.col("linked") == 1) & (turn <= max(0, min(k - 1, k // 2)))
    tiers = marked.withColumn("tier", F.when(F.col("rank") == 1, 0).when(moved, 1).otherwise(2))
    return tiers.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank"))).select("query_id", "id", "rank", "new_rank")


def union_recall(channels: DataFrame, relevant: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, n_relevant, n_found, recall, passed): recall of the union of all channels' first k.

    ``channels``: query_id, channel, id, rank; ``relevant``: query_id, id. ``passed``
    where the recall is at least ``least``; queries without a relevant id are left out.
    """
    wanted = relevant.where("id IS NOT NULL").select("query_id", "id").distinct()
    found = channels.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("ok")).distinct()
    per = wanted.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.count("ok").alias("n_found"))
    return per.withColumn("recall", F.round(F.col("n_found") / F.col("n_relevant"), 6)).withColumn("passed", F.col("recall") >= least)


def outcome(deltas: list[Column]) -> Column:
    """IMPROVED, HARMED, MIXED or UNCHANGED of columns of differences; NULL ones do not count."""
    up = F.lit(False)
    down = F.lit(False)
    for d in deltas:
        up, down = up | F.coalesce(d > 1e-12, F.lit(False)), down | F.coalesce(d < -1e-12, F.lit(False))
    return F.when(up & down, "MIXED").when(up, "IMPROVED").when(down, "HARMED").otherwise("UNCHANGED")


def schedule_faults(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): combinations of the values of all ``keys`` that do not occur exactly once.

    Expected is every value of each key with every value of the others; the values of
    each but the last are few, so they travel as one list beside the last.
    """
    expected = rows.select(keys[-1]).distinct()
    for key in keys[:-1]:
        values = rows.agg(F.sort_array(F.collect_set(key)).alias("v")).first().v
        expected = expected.withColumn(key, F.explode(F.array(*[F.lit(v) for v in values])) if values else F.lit(None))
    seen = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return expected.join(seen, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1").select(*keys, "n")
