"""Joins whose hot keys are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.sources.tables import broadcast_if_small

#: Rows of a key on the left side that go to one task.
HOT_ROWS = 100_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner", rows: int = HOT_ROWS) -> DataFrame:
    """left.join(right, keys, how) for inner, left and left_semi, with hot keys of `left` in several parts.

    A key with more than `rows` rows on the left is cut into parts by a hash of the column `by`, and its
    right rows are copied to each part. There are at most (rows of left) / `rows` such keys. `left` is
    read twice, so it should be a table or cut by `checkpointed`. Rows with a null key match nothing.
    """
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_parts"))
    hot = broadcast_if_small(hot)
    parts = F.coalesce("_parts", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    b = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [*keys, "_part"], how).drop("_part")
