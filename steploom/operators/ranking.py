"""Running totals and row numbers that split hot groups.

A window over a whole group puts the group into one task. Here the integer order column is cut into
blocks; totals run inside a block, and the totals of the blocks before are added from a small table
with one row per group and block. A group may then hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.sources.tables import checkpointed

#: Width of a block in units of the order column.
BLOCK = 4096


def block_of(order: Column, width: int = BLOCK) -> Column:
    return F.floor(order / F.lit(width)).cast("long")


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    weights: dict[str, str | None],
    block: str = "_block",
    width: int = BLOCK,
) -> DataFrame:
    """Adds, for each (out: weight), the total of `weight` (1 where None) up to and including this row.

    The order is the integer column `order` inside `keys`. The caller makes (keys, order) unique, so
    a block holds at most `width` rows of a group. Null keys form a group as in GROUP BY. Rows with
    a null `order` are not allowed. If `df` has the column `block` already it is used as it is, so
    that one exchange by (some keys, block) serves several calls.
    """
    own = block not in df.columns
    base = df.withColumn(block, block_of(F.col(order), width)) if own else df
    value = {o: F.lit(1).cast("long") if w is None else F.col(w).cast("long") for o, w in weights.items()}
    inside = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    local = base.select("*", *[F.sum(v).over(inside).alias(f"_in_{o}") for o, v in value.items()])
    before = (
        base.groupBy(*keys, block)
        .agg(*[F.sum(v).alias(f"_all_{o}") for o, v in value.items()])
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col(block).alias("_kb"),
            *[F.coalesce(F.sum(f"_all_{o}").over(earlier), F.lit(0).cast("long")).alias(f"_pre_{o}") for o in value],
        )
    )
    same = F.col(block) == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    kept = df.columns if own else base.columns
    return local.join(before, same, "left").select(*kept, *[(F.col(f"_in_{o}") + F.col(f"_pre_{o}")).alias(o) for o in value])


def running_total(
    df: DataFrame, keys: list[str], order: str, weight: str | None, out: str, block: str = "_block", width: int = BLOCK
) -> DataFrame:
    """`running_totals` of one weight; of no weight: the row number."""
    return running_totals(df, keys, order, {out: weight}, block, width)


def range_totals(df: DataFrame, keys: list[str], order: list[str], weight: str | None, out: str) -> DataFrame:
    """Adds `out`: the total of `weight` (1 where None) up to and including the row, in the order of `order` inside `keys`.

    For orders that are no integers: rows are cut into ranges of (keys, order) over all partitions, and what
    the ranges before hold is added. The caller makes (keys, order) unique.
    """
    value = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    ranged = checkpointed(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id().cast("long")))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_s")).select(*keys, "_range", F.coalesce(F.sum("_s").over(earlier), F.lit(0).cast("long")).alias("_before"))
    totals = ranged.select("*", F.sum(value).over(inside).alias("_own")).join(F.broadcast(before), [*keys, "_range"])  # a row for each range and key
    return totals.select(*df.columns, (F.col("_own") + F.col("_before")).alias(out))
