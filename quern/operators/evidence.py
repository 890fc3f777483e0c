"""Evidence rows of a query: exact look-up, dedupe, coverage of required groups, ordered selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``; an aggregate, so a large key is reduced map-side.

    ``order`` holds columns whose least values win; end it in a unique one.
    """
    rest = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def dedupe(df: DataFrame, identity: list[str], content: list[str], order: list) -> DataFrame:
    """Two passes: one row per identity, then one per equal content at the same place."""
    return first_rows(first_rows(df, identity, order), content, order)


def coverage(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, n_groups, n_found, share, missing): required groups of a query against what was found.

    ``wanted``: query_id, group; ``found``: query_id, group. ``missing`` lists the
    groups that were not found, sorted, joined by commas: a query's own groups, not the data.
    """
    have = found.select("query_id", "group", F.lit(1).alias("ok")).distinct()
    joined = wanted.select("query_id", "group").distinct().join(have, ["query_id", "group"], "left")
    return joined.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_groups"), F.count("ok").alias("n_found"), F.round(F.count("ok") / F.count(F.lit(1)), 6).alias("share"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("ok").isNull(), F.col("group")))), ",").alias("missing"),
    )


def round_robin(df: DataFrame, group: str, bucket: str, score: str, tie: str, k: int) -> DataFrame:
    """Up to k rows of each group, one from each bucket in turn: order (place in bucket, bucket)."""
    place = F.row_number().over(Window.partitionBy(group, bucket).orderBy(F.desc(score), tie))
    turn = F.row_number().over(Window.partitionBy(group).orderBy("__place", bucket))
    return df.withColumn("__place", place).where(F.col("__place") <= k).withColumn("turn", turn).where(F.col("turn") <= k).drop("__place")


def stratified(df: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """``n`` rows of each stratum, chosen by the hash of ``key``: the same rows in any order of the input."""
    pick = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key))
    return df.withColumn("pick", pick).where(F.col("pick") <= n)
