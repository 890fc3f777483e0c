"""Integrity checks that give rows: duplicate keys, missing targets, fingerprints, multiset equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_rows(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of every row that breaks a rule; a rule that is NULL for a row is not broken.

    One pass over the rows for all rules.
    """
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]))
    return df.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, n_distinct): keys with more than one row, and how many of the rows differ."""
    rows = df.select(F.col(key).alias("key"), F.xxhash64(*df.columns).alias("h")).groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("key").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).where("n_rows > 1")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, fingerprint): the same for the same rows in any order; repeated rows count.

    The sum of 60 bits of each row's hash, as a decimal, which no grouping changes.
    """
    joined = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    bits = F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(bits).cast("string").alias("fingerprint"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows by their number in ``left`` less that in ``right``, where it is not 0. No rows: equal multisets."""
    both = left.withColumn("__n", F.lit(1)).unionByName(right.select(*left.columns).withColumn("__n", F.lit(-1)))
    return both.groupBy(*left.columns).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")


def resolved(manifest: DataFrame, catalog: DataFrame, key: str, required: list[str]) -> DataFrame:
    """``manifest`` with ``status`` VERIFIED or UNVERIFIED and ``missing``: the required catalog fields that are NULL or empty.

    A manifest row without a catalog row misses every field. ``catalog`` has one row per key.
    """
    fields = [F.col(c).alias(f"c_{c}") for c in required]
    joined = manifest.join(catalog.select(F.col(key).alias("__key"), *fields), F.col(key) == F.col("__key"), "left")
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f"c_{c}").cast("string")), F.lit("")) == "", F.lit(c)) for c in required]))
    return joined.withColumn("missing", F.array_join(missing, ",")).withColumn("status", F.when(F.col("missing") == "", "VERIFIED").otherwise("UNVERIFIED")).drop("__key", *[f"c_{c}" for c in required])
