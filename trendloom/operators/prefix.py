"""Distributed running sums (W3, W4, and dense ordinals).

A running sum over a global order written as one ``Window.orderBy`` with no
``partitionBy`` pulls every row into one task.  Here it is two-phase:

1. ``repartitionByRange`` on (group, order) keys: sampled bounds, so every
   partition holds a contiguous, balanced key range - also when one group
   holds a third of all rows (that group spans several partitions).  The
   partition id is recorded and the result checkpointed, because sampled
   bounds may differ between two executions of the same exchange.
2. a window inside (partition id, group): each piece is one range partition.
3. per (partition id, group) totals - one row per piece, not per row - and
   an exclusive running sum of those totals per group, ordered by partition
   id (range order = key order).
4. join the offset back; running = local + offset.  Only a group that goes on
   from an earlier partition has an offset, and a partition has at most one
   such group (its first), so the offsets have at most one row for each partition and
   are broadcast.

All columns of the rows are moved and written once, so callers pass narrow rows
(keys and numbers) and join wide columns back by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.session import checkpoint_dir


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def range_rows(df: DataFrame, order_by: Sequence, partition_by: Sequence[str] = (),
               num_partitions: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of (group, order) with the partition in ``_pid``,
    written once."""
    keys = [*[F.col(c) for c in partition_by], *[_col(c) for c in order_by]]
    # Without an explicit count AQE may coalesce small ranges; it merges
    # adjacent ones only, so partition ids still follow key order.
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    # Range bounds come from sampling and are not guaranteed to be equal in
    # two executions of the exchange, while all branches of ``running_over`` must see
    # the same partition of every row: assign it once and materialise it
    # (reliable checkpoint in the shared folder, also a lineage cut).
    checkpoint_dir(df.sparkSession)
    return ranged.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)


def running_over(ranged: DataFrame, value, order_by: Sequence, partition_by: Sequence[str] = (),
                 out: str = "running", inclusive: bool = True, how: str = "sum") -> DataFrame:
    """Adds ``out`` to rows dealt by ``range_rows`` with the same keys."""
    if how not in ("sum", "max"):
        raise ValueError(f"unknown aggregate {how!r}")
    agg = F.sum if how == "sum" else F.max
    part, order = list(partition_by), [_col(c) for c in order_by]
    rows = ranged.withColumn("_v", _col(value))
    last = Window.currentRow if inclusive else -1
    w_local = (Window.partitionBy("_pid", *part).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, last))
    local = rows.withColumn("_loc", agg("_v").over(w_local))
    totals = rows.groupBy("_pid", *part).agg(agg("_v").alias("_tot"))
    # pieces of one group (without groups: one row per range partition)
    w_off = (Window.partitionBy(*part) if part else Window).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_pid").alias("_opid"), *[F.col(c).alias(f"_o_{i}") for i, c in enumerate(part)],
                            agg("_tot").over(w_off).alias("_off")).where(F.col("_off").isNotNull())
    same = F.col("_pid") == F.col("_opid")
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{i}"))
    # at most one row for each range partition, see above
    res = local.join(F.broadcast(offsets), same, "left")
    if how == "sum":
        run = F.coalesce(F.col("_loc"), F.lit(0)) + F.coalesce(F.col("_off"), F.lit(0))
    else:
        run = F.greatest(F.col("_loc"), F.col("_off"))
    return res.withColumn(out, run).drop("_v", "_loc", "_off", "_opid", *[f"_o_{i}" for i in range(len(part))])


def running_agg(df: DataFrame, value, order_by: Sequence, partition_by: Sequence[str] = (),
                out: str = "running", inclusive: bool = True, how: str = "sum",
                num_partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = sum (``how='sum'``) or max (``how='max'``) of ``value``
    over the rows up to this one (``inclusive``) or before it, in
    ``order_by`` per ``partition_by`` group.  ``order_by`` must be a total
    order (add a unique tie-breaker).  An exclusive max of the first row of a
    group is null; an exclusive sum is 0."""
    ranged = range_rows(df, order_by, partition_by, num_partitions)
    return running_over(ranged, value, order_by, partition_by, out, inclusive, how).drop("_pid")


def running_sum(df: DataFrame, value, order_by: Sequence, partition_by: Sequence[str] = (),
                out: str = "running", inclusive: bool = True,
                num_partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = sum of ``value`` over rows up to this one in
    ``order_by`` (per ``partition_by`` group)."""
    return running_agg(df, value, order_by, partition_by, out, inclusive, "sum", num_partitions)


def ordinal(df: DataFrame, order_by: Sequence, partition_by: Sequence[str] = (),
            out: str = "ordinal", num_partitions: int | None = None) -> DataFrame:
    """1-based row number in ``order_by`` (per group) without a
    single-task window: a running count."""
    return running_sum(df, F.lit(1).cast("long"), order_by, partition_by, out, True,
                       num_partitions)
