"""Running computations over groups of any size.

A window over a group sorts the whole group in one task. When one group may hold
a third of all rows, that task becomes the job. Here the rows are range-partitioned
by (group, order), so that a large group is cut into neighbouring shards; each
shard is computed alone and the little that must cross a cut (a sum, a last value)
is added as a carry. A cut falls into at most one group, so the carries are at most
one row per shard: that bound, and not the data, sizes the broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import checkpointed, shuffle_partitions

SHARD = "__shard"


def range_shards(df: DataFrame, group: list[str], order: list[str], shards: int | None = None) -> DataFrame:
    """``df`` with a shard number that follows (group, order).

    ``order`` should end in a unique column: rows equal in all of group and order
    stay in one shard. The result is checkpointed, as range boundaries are sampled
    and must not differ between two evaluations.
    """
    n = shards or shuffle_partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in [*group, *order]])
    return checkpointed(placed.withColumn(SHARD, F.spark_partition_id()))


def _carry(partial: DataFrame, group: list[str], values: dict) -> DataFrame:
    """Per (group, shard) of groups that cross a cut: ``values`` over the shards before."""
    across = Window.partitionBy(*group)
    before = across.orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    return (
        partial.withColumn("__n", F.count(F.lit(1)).over(across))
        .where("__n > 1")
        .withColumns({name: value.over(before) for name, value in values.items()})
        .select(*[F.col(c).alias(f"__g_{c}") for c in group], F.col(SHARD).alias("__g_shard"), *values)
    )


def _with_carry(df: DataFrame, carry: DataFrame, group: list[str]) -> DataFrame:
    on = F.col(SHARD) == F.col("__g_shard")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return df.join(F.broadcast(carry), on, "left").drop("__g_shard", *[f"__g_{c}" for c in group])


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str], lasts: dict[str, str], shards: int | None = None, tops: dict[str, str] | None = None) -> DataFrame:
    """Adds running sums, last values and greatest values, name -> column, in one pass over the shards.

    A sum is over the rows before this one in its group (NULL counts as 0, the first
    row has 0); a last value is the last that is not NULL at or before this row; a
    greatest value (``tops``) is that of the rows before this one, NULL for the first. Rows
    equal in group and order are put in some order of their own, so end ``order`` in a
    unique column. With no ``group`` all rows are one.
    """
    placed = range_shards(df, group, order, shards)
    rank = F.struct(*order)
    parts = [F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"__p_{k}") for k, v in sums.items()]
    parts += [F.max_by(v, F.when(F.col(v).isNotNull(), rank)).alias(f"__p_{k}") for k, v in lasts.items()]
    tops = tops or {}
    parts += [F.max(v).alias(f"__p_{k}") for k, v in tops.items()]
    partial = placed.groupBy(*group, SHARD).agg(*parts)
    carried = {f"__c_{k}": F.sum(f"__p_{k}") for k in sums} | {f"__c_{k}": F.last(f"__p_{k}", ignorenulls=True) for k in lasts}
    carried |= {f"__c_{k}": F.max(f"__p_{k}") for k in tops}
    local = Window.partitionBy(*group, SHARD).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    before, up_to = local.rowsBetween(Window.unboundedPreceding, -1), local.rowsBetween(Window.unboundedPreceding, 0)
    here = {k: F.coalesce(F.sum(F.coalesce(F.col(v), F.lit(0))).over(before), F.lit(0)) for k, v in sums.items()}
    here |= {k: F.last(v, ignorenulls=True).over(up_to) for k, v in lasts.items()}
    here |= {k: F.max(v).over(before) for k, v in tops.items()}
    result = _with_carry(placed.withColumns(here), _carry(partial, group, carried), group)
    whole = {k: F.col(k) + F.coalesce(f"__c_{k}", F.lit(0)) for k in sums} | {k: F.coalesce(k, f"__c_{k}") for k in lasts} | {k: F.greatest(k, f"__c_{k}") for k in tops}
    return result.withColumns(whole).drop(SHARD, *carried)


def prefix_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, shards: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group, see ``running``."""
    return running(df, group, order, {out: value}, {}, shards)


def last_value(df: DataFrame, group: list[str], order: list[str], value: str, out: str, shards: int | None = None) -> DataFrame:
    """Adds ``out``: the last non-NULL ``value`` at or before this row in its group, else NULL."""
    return running(df, group, order, {}, {out: value}, shards)


def previous_value(df: DataFrame, group: list[str], order: list[str], value: str, out: str, shards: int | None = None) -> DataFrame:
    """Adds ``out``: ``value`` of the row before this one in its group, NULL for the first."""
    placed = range_shards(df, group, order, shards)
    lasts = placed.groupBy(*group, SHARD).agg(F.max_by(F.struct(F.col(value)), F.struct(*order)).alias("__last"))
    carry = _carry(lasts, group, {"__carry": F.last("__last", ignorenulls=True)})
    local = Window.partitionBy(*group, SHARD).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    first = F.row_number().over(local) == 1
    result = _with_carry(placed.withColumn("__first", first).withColumn(out, F.lag(value).over(local)), carry, group)
    return result.withColumn(out, F.when(F.col("__first"), F.col("__carry")[value]).otherwise(F.col(out))).drop("__carry", "__first", SHARD)
