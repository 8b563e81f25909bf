"""What would have been cut off or saved if a run had stopped at a detector's first trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.operators import sequence as seq
from steploom.operators.detectors import CONFIGS, FEATURES_SQL, config_table, location, triggered
from steploom.operators.ranking import block_of, running_totals
from steploom.operators.sequence import KEYS, PREPARED_SQL
from steploom.sources.tables import read_table

_KINDS = {"pi": "in_pi", "uc": "in_uc", "hn": "in_hn", "productive": "in_pi OR in_hn"}


def by_blocks(rows: DataFrame, totals: DataFrame, order: str) -> DataFrame:
    """`rows` with the totals of their trajectory: a copy of them for each block of `order`, so that a long trajectory is many groups."""
    cut = rows.withColumn("_blk", block_of(F.col(order)))
    blocks = cut.select(*KEYS, "_blk").distinct()
    return cut.join(blocks.join(totals, KEYS), [*KEYS, "_blk"]).drop("_blk")


def suffix_counts(t: DataFrame) -> DataFrame:
    """Adds remaining_steps and remaining_{pi,uc,hn,productive}: steps of the kind after this one."""
    marked = t.select("*", F.lit(1).alias("k_steps"), *[F.expr(f"CAST({e} AS INT)").alias(f"k_{k}") for k, e in _KINDS.items()])
    names = ["steps", *_KINDS]
    upto = running_totals(marked, KEYS, "position", {f"u_{k}": f"k_{k}" for k in names})
    total = marked.groupBy(*KEYS).agg(*[F.sum(f"k_{k}").alias(f"t_{k}") for k in names])
    out = by_blocks(upto, total, "position")
    return out.select(*t.columns, *[(F.col(f"t_{k}") - F.col(f"u_{k}")).alias(f"remaining_{k}") for k in names])


def spans_after(t: DataFrame, spans: DataFrame) -> DataFrame:
    """(keys, step_index, productive_spans_after, uc_spans_after): spans that end after the step."""
    prod = (F.col("label") == "productive_iteration") | F.col("productive_iteration_flag") | F.col("hard_negative")
    uc = (F.col("label") == "unproductive_cycle") | F.col("unproductive_cycle_flag")
    ends = spans.select(*KEYS, F.col("end").cast("long").alias("pos"), prod.cast("long").alias("p"), uc.cast("long").alias("u"), F.lit(0).alias("s"))
    zero = F.lit(0).cast("long")
    marks = ends.unionByName(t.select(*KEYS, F.col("step_index").cast("long").alias("pos"), zero.alias("p"), zero.alias("u"), F.lit(1).alias("s")))
    summed = marks.groupBy(*KEYS, "pos").agg(F.sum("p").alias("p"), F.sum("u").alias("u"), F.max("s").alias("s"))
    upto = running_totals(summed, KEYS, "pos", {"pu": "p", "uu": "u"})
    total = summed.groupBy(*KEYS).agg(F.sum("p").alias("pt"), F.sum("u").alias("ut"))
    return by_blocks(upto.where("s = 1"), total, "pos").select(
        *KEYS, F.col("pos").cast("int").alias("step_index"), (F.col("pt") - F.col("pu")).alias("productive_spans_after"), (F.col("ut") - F.col("uu")).alias("uc_spans_after")
    )


def first_stops(spark, folder: str) -> DataFrame:
    """First trigger of each configuration and trajectory with what comes after it."""
    t = triggered(spark, folder)
    first = t.select(*KEYS, "position", F.explode("fired").alias("cfg")).groupBy(*KEYS, "cfg").agg(F.min("position").alias("position"))
    spans = seq.ordered_spans(read_table(spark, folder, "normalized_spans"))
    wide = suffix_counts(t.drop("fired")).join(spans_after(t, spans), [*KEYS, "step_index"])
    return first.join(wide, [*KEYS, "position"]).withColumn("location", location(True))


def _summary(stops: DataFrame, *by: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return stops.groupBy(*by).agg(
        F.count(F.lit(1)).alias("stops"),
        F.sum("remaining_steps").alias("steps_cut"),
        F.avg("remaining_productive").alias("productive_steps_cut_mean"),
        F.avg("remaining_uc").alias("uc_steps_saved_mean"),
        F.avg("remaining_hn").alias("hn_steps_cut_mean"),
        F.avg("productive_spans_after").alias("productive_spans_after_mean"),
        F.avg("uc_spans_after").alias("uc_spans_after_mean"),
        share(F.col("remaining_productive") > 0).alias("cuts_productive_rate"),
        share(F.col("remaining_uc") > 0).alias("saves_uc_rate"),
    )


def stop_summary(spark, folder: str) -> DataFrame:
    """Per pool and configuration: what stopping at the first trigger cuts and saves."""
    out = _summary(first_stops(spark, folder), "dataset", "cfg")
    names = config_table(spark).select("cfg", "detector", "config")
    return out.join(F.broadcast(names), "cfg").drop("cfg")


def stop_summary_by_location(spark, folder: str) -> DataFrame:
    return _summary(first_stops(spark, folder), "dataset", "location")


def suffix_totals(spark, folder: str) -> DataFrame:
    """Steps after each step, summed per trajectory: a check of the suffix counts on every row."""
    s = seq.prepared(spark, folder).select(*KEYS, "step_index", "position", "in_pi", "in_uc", "in_hn")
    c = suffix_counts(s)
    return c.groupBy(*KEYS).agg(*[F.sum(f"remaining_{k}").alias(f"remaining_{k}") for k in ("steps", "pi", "uc", "hn", "productive")])


_AFTER = "OVER (PARTITION BY dataset, trajectory_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
_SUFFIX = f"""count(*) {_AFTER} AS remaining_steps, coalesce(sum(in_pi::INT) {_AFTER}, 0) AS remaining_pi, coalesce(sum(in_uc::INT) {_AFTER}, 0) AS remaining_uc,
  coalesce(sum(in_hn::INT) {_AFTER}, 0) AS remaining_hn, coalesce(sum((in_pi OR in_hn)::INT) {_AFTER}, 0) AS remaining_productive"""
STOP_COLUMNS_SQL = _SUFFIX


def first_stops_cte(before: str) -> str:
    """The first stops behind the named queries of `before`, which hold steps, spans and triggers."""
    return before + f""",
suf AS (SELECT dataset, trajectory_id, position, step_index, in_pi, in_uc, in_hn, in_uncertain, {_SUFFIX} FROM steps),
fir AS (SELECT dataset, trajectory_id, cfg, min(position) AS position FROM trig GROUP BY 1, 2, 3),
stops AS (SELECT f.cfg, s.*,
  (SELECT count(*) FROM sp WHERE sp.dataset = s.dataset AND sp.trajectory_id = s.trajectory_id AND sp.b > s.step_index AND (label = 'productive_iteration' OR pi OR hn)) AS pa,
  (SELECT count(*) FROM sp WHERE sp.dataset = s.dataset AND sp.trajectory_id = s.trajectory_id AND sp.b > s.step_index AND (label = 'unproductive_cycle' OR uc)) AS ua,
  CASE WHEN in_uc THEN 'UC' WHEN in_hn THEN 'HN' WHEN in_pi THEN 'PI' WHEN in_uncertain THEN 'uncertain' ELSE 'other' END AS location
  FROM fir f JOIN suf s ON s.dataset = f.dataset AND s.trajectory_id = f.trajectory_id AND s.position = f.position)"""
_STOPS = first_stops_cte(FEATURES_SQL)
_AGG = """count(*) AS stops, sum(remaining_steps)::BIGINT AS steps_cut, avg(remaining_productive) AS productive_steps_cut_mean, avg(remaining_uc) AS uc_steps_saved_mean,
  avg(remaining_hn) AS hn_steps_cut_mean, avg(pa) AS productive_spans_after_mean, avg(ua) AS uc_spans_after_mean,
  avg((remaining_productive > 0)::INT) AS cuts_productive_rate, avg((remaining_uc > 0)::INT) AS saves_uc_rate"""
STOP_SUMMARY_SQL = _STOPS + f" SELECT stops.dataset, c.detector, c.config, {_AGG} FROM stops JOIN cfgs c USING (cfg) GROUP BY 1, 2, 3"
STOP_SUMMARY_BY_LOCATION_SQL = _STOPS + f" SELECT dataset, location, {_AGG} FROM stops GROUP BY 1, 2"
SUFFIX_TOTALS_SQL = PREPARED_SQL + f""", x AS (SELECT dataset, trajectory_id, {_SUFFIX} FROM steps)
SELECT dataset, trajectory_id, sum(remaining_steps)::BIGINT AS remaining_steps, sum(remaining_pi)::BIGINT AS remaining_pi, sum(remaining_uc)::BIGINT AS remaining_uc,
  sum(remaining_hn)::BIGINT AS remaining_hn, sum(remaining_productive)::BIGINT AS remaining_productive FROM x GROUP BY 1, 2"""

QUERIES = {"stop_summary": stop_summary, "stop_summary_by_location": stop_summary_by_location, "suffix_totals": suffix_totals}
ORACLES = {"stop_summary": STOP_SUMMARY_SQL, "stop_summary_by_location": STOP_SUMMARY_BY_LOCATION_SQL, "suffix_totals": SUFFIX_TOTALS_SQL}
assert len(CONFIGS) < 64
