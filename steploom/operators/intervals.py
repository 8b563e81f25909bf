"""Continuous periods and gaps of overlapping intervals (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.functions.parse import span_label
from steploom.operators.ranking import running_total
from steploom.sources.tables import checkpointed, read_table


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Merged periods and the gaps between them, per entity `keys`.

    `intervals` has integer, inclusive bounds. Result: keys, kind ('period' or 'gap'), `start`, `end`.
    Intervals that overlap, nest or adjoin (next start = end + 1) form one period; repeated rows
    change nothing. Rows with a null key or bound are left out, swapped bounds are put in order, an
    empty table gives an empty result, and further columns are ignored.

    Method: starts and ends are ranked independently. The r intervals that start first have all ended
    before the next one starts exactly if the start of rank r + 1 lies beyond the end of rank r (by
    more than 1, as adjoining intervals merge). These pairs are the gaps; the first start, the ends
    and starts at the gaps, and the last end are the bounds of the periods, paired by their own rank.
    Equal starts (ends) are counted first, so only distinct bounds are ranked, in blocks.
    """
    names = [f"_e{i}" for i in range(len(keys))]
    rows = intervals.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)],
        F.least(start, end).cast("long").alias("_s"),
        F.greatest(start, end).cast("long").alias("_t"),
        (F.col(start).isNotNull() & F.col(end).isNotNull()).alias("_ok"),
    ).where("_ok")
    for n in names:
        rows = rows.where(F.col(n).isNotNull())
    # One exchange for both sides: every bound as (entity, side, position) with its count.
    bounds = (
        rows.select(
            *names,
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("side"), F.col("_s").alias("pos")),
                    F.struct(F.lit(1).alias("side"), F.col("_t").alias("pos")),
                )
            ).alias("b"),
        )
        .select(*names, "b.side", "b.pos")
        .groupBy(*names, "side", "pos")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Read several times below, so it is written once: a row for each distinct bound.
    ranked = checkpointed(running_total(checkpointed(bounds), [*names, "side"], "pos", "n", "rank"))
    # Before the start of rank r + 1 there are r starts; up to the end of rank r there are r ends.
    starts = ranked.where("side = 0").select(*names, (F.col("rank") - F.col("n")).alias("rank"), F.col("pos").alias("next_start"))
    ends = ranked.where("side = 1").select(*names, "rank", F.col("pos").alias("last_end"))
    # A rank names few bounds, so an entity with many is many groups here; its first and last bound are one each.
    gaps = starts.join(ends, [*names, "rank"]).where(F.col("next_start") > F.col("last_end") + 1).select(*names, "next_start", "last_end")
    none = F.lit(None).cast("long")
    first = starts.where("rank = 0").select(*names, "next_start", none.alias("last_end"))
    last = ends.groupBy(*names).agg(F.max(F.struct("rank", "last_end")).alias("x")).select(*names, none.alias("next_start"), "x.last_end")
    cuts = gaps.unionByName(first).unionByName(last)
    sided = cuts.select(
        *names,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("next_start").alias("pos"), F.col("last_end").alias("other")),
                F.struct(F.lit(1).alias("side"), F.col("last_end").alias("pos"), F.col("next_start").alias("other")),
            )
        ).alias("b"),
    ).select(*names, "b.*").where(F.col("pos").isNotNull())
    ranked = running_total(checkpointed(sided), [*names, "side"], "pos", None, "k")
    period = ranked.groupBy(*names, "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("pos"))).alias("p0"),
        F.max(F.when(F.col("side") == 1, F.col("pos"))).alias("p1"),
        F.max(F.when(F.col("side") == 1, F.col("other"))).alias("g1"),
    )
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("p0").alias("s"), F.col("p1").alias("t")),
        F.struct(F.lit("gap").alias("kind"), (F.col("p1") + 1).alias("s"), (F.col("g1") - 1).alias("t")),
    )
    return (
        period.select(*names, F.explode(kinds).alias("r"))
        .where(F.col("r.t").isNotNull())
        .select(
            *[F.col(n).alias(k) for n, k in zip(names, keys)],
            F.col("r.kind").alias("kind"),
            F.col("r.s").cast("int").alias(start),
            F.col("r.t").cast("int").alias(end),
        )
    )


def clean_spans(spans: DataFrame, steps: DataFrame) -> DataFrame:
    """trajectory_id, span_label, start_step_index, end_step_index of the usable rows of `spans`.

    A null end becomes the highest step_index of the trajectory in `steps`, and stays null (left out
    later) if the trajectory has no step. Rows without trajectory, start or label are left out.
    """
    usable = spans.select(
        "trajectory_id", "start_step_index", "end_step_index", span_label(F.col("span_label_norm")).alias("span_label")
    ).where(
        _filled(F.col("trajectory_id")) & F.col("start_step_index").isNotNull() & F.col("span_label").isNotNull()
    )
    usable = usable.distinct()
    last = (
        steps.where(F.col("step_index").isNotNull())
        .groupBy("trajectory_id")
        .agg(F.max("step_index").alias("_last"))
    )
    closed = usable.where(F.col("end_step_index").isNotNull())
    opened = (
        usable.where(F.col("end_step_index").isNull())
        .drop("end_step_index")
        .join(last, "trajectory_id")
        .withColumnRenamed("_last", "end_step_index")
    )
    return closed.unionByName(opened)


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def p3_found(spark, folder: str) -> DataFrame:
    spans = read_table(spark, folder, "normalized_spans")
    steps = read_table(spark, folder, "enriched_steps", "trajectory_id", "step_index")
    return periods_and_gaps(
        clean_spans(spans, steps), ["trajectory_id", "span_label"], "start_step_index", "end_step_index"
    ).select("trajectory_id", "span_label", "kind", "start_step_index", "end_step_index")


def p3_coverage(spark, folder: str) -> DataFrame:
    """Per label: periods, gaps, steps covered and steps in gaps."""
    return (
        p3_found(spark, folder)
        .groupBy("span_label")
        .agg(
            F.sum(F.when(F.col("kind") == "period", 1).otherwise(0)).alias("periods"),
            F.sum(F.when(F.col("kind") == "gap", 1).otherwise(0)).alias("gaps"),
            F.sum(F.when(F.col("kind") == "period", F.col("end_step_index") - F.col("start_step_index") + 1).otherwise(0)).alias("covered_steps"),
            F.sum(F.when(F.col("kind") == "gap", F.col("end_step_index") - F.col("start_step_index") + 1).otherwise(0)).alias("gap_steps"),
        )
    )


_LABEL_SQL = r"""
  CASE regexp_replace(regexp_replace(lower(trim(span_label_norm)), '[^a-z]+', '_', 'g'), '_?spans?$|^_+|_+$', '', 'g')
    WHEN 'productive_iteration' THEN 'productive_iteration' WHEN 'pi' THEN 'productive_iteration'
    WHEN 'unproductive_cycle' THEN 'unproductive_cycle' WHEN 'uc' THEN 'unproductive_cycle'
    WHEN 'uncertain' THEN 'uncertain' WHEN 'unresolved' THEN 'unresolved'
    WHEN 'none' THEN 'none' WHEN 'no' THEN 'none' END"""

P3_FOUND_SQL = rf"""
WITH last AS (SELECT trajectory_id, max(step_index) AS m FROM enriched_steps GROUP BY 1),
raw AS (
  SELECT n.trajectory_id, {_LABEL_SQL} AS span_label, start_step_index AS a, coalesce(end_step_index, m) AS b
  FROM normalized_spans n LEFT JOIN last USING (trajectory_id)
  WHERE trim(n.trajectory_id) <> ''),
ok AS (SELECT trajectory_id, span_label, least(a, b) AS s, greatest(a, b) AS t FROM raw
       WHERE a IS NOT NULL AND b IS NOT NULL AND span_label IS NOT NULL),
marked AS (SELECT *, max(t) OVER (PARTITION BY trajectory_id, span_label ORDER BY s, t
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
grouped AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END)
                     OVER (PARTITION BY trajectory_id, span_label ORDER BY s, t) AS g FROM marked),
periods AS (SELECT trajectory_id, span_label, g, min(s) AS s, max(t) AS t FROM grouped GROUP BY 1, 2, 3),
gaps AS (SELECT trajectory_id, span_label, t + 1 AS s,
                lead(s) OVER (PARTITION BY trajectory_id, span_label ORDER BY s) - 1 AS t FROM periods)
SELECT trajectory_id, span_label, 'period' AS kind, s::INTEGER AS start_step_index, t::INTEGER AS end_step_index FROM periods
UNION ALL
SELECT trajectory_id, span_label, 'gap', s::INTEGER, t::INTEGER FROM gaps WHERE t IS NOT NULL"""

P3_COVERAGE_SQL = f"""
SELECT span_label, count(*) FILTER (kind = 'period') AS periods, count(*) FILTER (kind = 'gap') AS gaps,
  coalesce(sum(end_step_index - start_step_index + 1) FILTER (kind = 'period'), 0)::BIGINT AS covered_steps,
  coalesce(sum(end_step_index - start_step_index + 1) FILTER (kind = 'gap'), 0)::BIGINT AS gap_steps
FROM ({P3_FOUND_SQL}) GROUP BY 1"""
