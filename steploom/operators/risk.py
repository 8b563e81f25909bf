"""Detector metrics by trajectory and their bootstrap intervals; the table of all triggers; comparisons of detectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.operators import sequence as seq
from steploom.operators.counterfactual import STOP_COLUMNS_SQL, first_stops_cte, spans_after, stop_summary, suffix_counts
from steploom.operators.detectors import CONFIGS, METRICS_CTE, NEAR_F1_PAIRS_SQL, config_table, eval_spans, location, metrics, near_f1_pairs, span_hits, triggered
from steploom.operators.experiments import POISSON, poisson_weight_sql
from steploom.operators.ranking import range_totals
from steploom.operators.sequence import KEYS
from steploom.sources.tables import checkpointed, read_table

#: Fixed value: replicates of the detector metrics' intervals.
REPLICATES = 1000
#: What a trajectory adds to the metrics of a configuration.
COUNTS = ["tp", "fp", "fn", "tn", "uc_recalled", "uc_total", "pi_hit", "pi_total", "hn_fired", "hn", "fired", "eligible", "latency_sum", "latency_count"]
#: Each metric as numerator and denominator over COUNTS.
RATIOS = {
    "f1": ({"tp": 2}, {"tp": 2, "fp": 1, "fn": 1}), "uc_recall": ({"uc_recalled": 1}, {"uc_total": 1}), "piir": ({"pi_hit": 1}, {"pi_total": 1}),
    "hn_fpr": ({"hn_fired": 1}, {"hn": 1}), "burden": ({"fired": 1}, {"eligible": 1}), "latency_mean": ({"latency_sum": 1}, {"latency_count": 1}),
}


def _contributions(spark, folder: str) -> DataFrame:
    """Per trajectory an array of COUNTS structs, one for each configuration by its number."""
    t = triggered(spark, folder)
    n = range(len(CONFIGS))
    hit = lambda i: F.array_contains("fired", i)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    steps = t.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("eligible"), one(F.col("in_uc")).alias("uc"), one(F.col("in_hn")).alias("hn"),
        F.array(*[F.struct(one(hit(i)).alias("fired"), one(hit(i) & F.col("in_uc")).alias("tp"), one(hit(i) & F.col("in_hn")).alias("hn_fired")) for i in n]).alias("x"),
    )
    spans = eval_spans(read_table(spark, folder, "normalized_spans"), t.select(*KEYS).distinct())
    is_uc = F.col("label") == "unproductive_cycle"
    totals = spans.groupBy(*KEYS).agg(one(is_uc).alias("uc_total"), one(~is_uc).alias("pi_total"))
    delay = lambda i: F.when(is_uc, F.col(f"f{i}") - F.col("first_position"))
    hits = span_hits(t, spans).groupBy(*KEYS).agg(
        F.array(*[
            F.struct(
                one(is_uc & F.col(f"f{i}").isNotNull()).alias("uc_recalled"), one(~is_uc & F.col(f"f{i}").isNotNull()).alias("pi_hit"),
                F.coalesce(F.sum(delay(i)), F.lit(0)).alias("latency_sum"), F.count(delay(i)).alias("latency_count"),
            )
            for i in n
        ]).alias("s")
    )
    wide = steps.join(totals, KEYS, "left").join(hits, KEYS, "left").na.fill(0, ["uc_total", "pi_total"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")

    def cell(i: int) -> Column:
        x, s = F.col("x")[i], F.col("s")[i]
        tp, fired = x["tp"], x["fired"]
        values = {
            "tp": tp, "fp": fired - tp, "fn": F.col("uc") - tp, "tn": F.col("eligible") - F.col("uc") - fired + tp, "uc_recalled": zero(s["uc_recalled"]), "uc_total": F.col("uc_total"),
            "pi_hit": zero(s["pi_hit"]), "pi_total": F.col("pi_total"), "hn_fired": x["hn_fired"], "hn": F.col("hn"), "fired": fired, "eligible": F.col("eligible"),
            "latency_sum": zero(s["latency_sum"]), "latency_count": zero(s["latency_count"]),
        }
        return F.struct(*[values[c].cast("long").alias(c) for c in COUNTS])

    return wide.select(*KEYS, F.array(*[cell(i) for i in n]).alias("cells"))


def detector_contributions(spark, folder: str) -> DataFrame:
    """What each trajectory adds to the metrics of each configuration."""
    each = _contributions(spark, folder).select(*KEYS, F.posexplode("cells").alias("cfg", "c")).select(*KEYS, "cfg", "c.*")
    return each.join(F.broadcast(config_table(spark).select("cfg", "detector", "config")), "cfg").drop("cfg")


def _replicated(replicates: int):
    """Weighted sums of the wide counts of a task's trajectories, for each pool and replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        limits = [math.ceil(p * 4294967296) for p in POISSON]
        for batch in batches:
            pools, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            values = np.array(batch.column(2).flatten(), dtype=np.float64).reshape(len(pools), -1)
            weights = np.zeros((len(pools), replicates))
            for i, (pool, id_) in enumerate(zip(pools, ids)):
                head = hashlib.md5(f"{pool}|{id_}|".encode())
                drawn = np.empty(replicates, dtype=np.int64)
                for rep in range(replicates):
                    h = head.copy()
                    h.update(str(rep).encode())
                    drawn[rep] = int.from_bytes(h.digest()[:4], "big")
                weights[i] = np.searchsorted(limits, drawn, side="right")
            for pool in dict.fromkeys(pools):
                mine = np.array([p == pool for p in pools])
                part = weights[mine].T @ values[mine]
                sums[pool] = sums[pool] + part if pool in sums else part
        for pool, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([pool] * replicates), pa.array(range(replicates), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["dataset", "rep", "sums"]
            )

    return run


def detector_intervals(spark, folder: str, replicates: int = REPLICATES) -> DataFrame:
    """Each metric of each configuration with its 95 % interval over bootstrap replicates of the trajectories.

    A trajectory's weight in a replicate is a Poisson number from a hash of both, so replicates are
    weighted sums: they are added up where the trajectories are, and again after one shuffle. A replicate
    without denominator does not count.
    """
    flat = F.flatten(F.transform("cells", lambda c: F.array(*[c[n] for n in COUNTS])))
    wide = checkpointed(_contributions(spark, folder).select("dataset", "trajectory_id", flat.alias("v")))
    size = len(CONFIGS) * len(COUNTS)
    parts = wide.mapInArrow(_replicated(replicates), "dataset string, rep int, sums array<double>")
    # A part has replicates x pools rows, whatever the number of its trajectories.
    reps = parts.select("dataset", "rep", F.posexplode("sums").alias("k", "v")).groupBy("dataset", "rep", F.floor(F.col("k") / len(COUNTS)).cast("int").alias("cfg")).agg(
        *[F.sum(F.when(F.col("k") % len(COUNTS) == i, F.col("v"))).alias(c) for i, c in enumerate(COUNTS)]
    )
    point = wide.select("dataset", F.posexplode("v").alias("k", "v")).groupBy("dataset", F.floor(F.col("k") / len(COUNTS)).cast("int").alias("cfg")).agg(
        *[F.sum(F.when(F.col("k") % len(COUNTS) == i, F.col("v"))).cast("double").alias(c) for i, c in enumerate(COUNTS)]
    )
    assert size < 10_000  # columns of the wide counts

    def ratios(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        total = lambda terms: sum(F.col(c) * w for c, w in terms.items())
        cells = [F.struct(F.lit(m).alias("metric"), F.when(total(d) != 0, total(n) / total(d)).alias(name)) for m, (n, d) in RATIOS.items()]
        return df.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*")

    ends = ratios(reps, ["dataset", "cfg"], "v").where("v IS NOT NULL").groupBy("dataset", "cfg", "metric").agg(
        F.round(F.percentile("v", 0.025), 9).alias("ci_low"), F.round(F.percentile("v", 0.975), 9).alias("ci_high")
    )
    out = ratios(point, ["dataset", "cfg"], "point").join(ends, ["dataset", "cfg", "metric"], "left")
    named = out.join(F.broadcast(config_table(spark).select("cfg", "detector", "config")), "cfg").drop("cfg")
    return named.withColumn("point", F.round("point", 9))


def trigger_table(spark, folder: str) -> DataFrame:
    """Every trigger with its id, place, what comes after it in steps and spans, and its configuration's metrics.

    Ids count the triggers by pool, detector, configuration, trajectory and step.
    """
    t = triggered(spark, folder)
    spans = seq.ordered_spans(read_table(spark, folder, "normalized_spans"))
    after = suffix_counts(t).join(spans_after(t, spans), [*KEYS, "step_index"]).withColumn("location", location(True))
    each = after.select(
        *KEYS, "step_index", "position", "location", *[f"remaining_{k}" for k in ("steps", "pi", "hn", "uc", "productive")], "productive_spans_after", "uc_spans_after",
        F.explode("fired").alias("cfg"),
    )
    first = t.select(*KEYS, "position", F.explode("fired").alias("cfg")).groupBy(*KEYS, "cfg").agg(F.min("position").alias("position")).withColumn("is_first", F.lit(True))
    each = each.join(first, [*KEYS, "cfg", "position"], "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))
    each = each.join(F.broadcast(config_table(spark).select("cfg", "detector", "config", "family")), "cfg").drop("cfg")
    each = each.withColumn("cuts_productive", (F.col("remaining_productive") > 0) | (F.col("productive_spans_after") > 0))
    each = each.withColumn("saves_uc", (F.col("remaining_uc") > 0) | (F.col("uc_spans_after") > 0))
    measured = metrics(spark, folder).select("dataset", "detector", "config", "f1", "uc_recall", "piir", "hn_fpr", "burden")
    numbered = range_totals(each.withColumn("_all", F.lit(0)), ["_all"], ["dataset", "detector", "config", "trajectory_id", "step_index"], None, "n").drop("_all")
    out = numbered.withColumn("trigger_id", F.format_string("trig_%08d", "n")).drop("n")
    return out.join(F.broadcast(measured), ["dataset", "detector", "config"], "left")  # a row for each pool and configuration


def near_f1_stops(spark, folder: str) -> DataFrame:
    """Pairs of configurations with nearly the same F1, with what stopping at either cuts and saves; both must have stops."""
    pairs = near_f1_pairs(spark, folder).select("dataset", "detector_a", "config_a", "detector_b", "config_b", "abs_f1_diff", "abs_piir_diff", "abs_hn_fpr_diff")
    s = checkpointed(stop_summary(spark, folder).select("dataset", "detector", "config", F.col("productive_steps_cut_mean").alias("cut"), F.col("uc_steps_saved_mean").alias("saved")))
    side = lambda x: s.select("dataset", *[F.col(c).alias(f"{c}_{x}") for c in ("detector", "config", "cut", "saved")])
    both = pairs.join(side("a"), ["dataset", "detector_a", "config_a"]).join(side("b"), ["dataset", "detector_b", "config_b"])
    return both.withColumn("abs_cut_diff", F.abs(F.col("cut_a") - F.col("cut_b"))).withColumn("abs_saved_diff", F.abs(F.col("saved_a") - F.col("saved_b")))


def progress_comparison(spark, folder: str) -> DataFrame:
    """Per pool the best configuration by F1 among those that look at progress and among those that do not; of equal ones the first listed."""
    order = config_table(spark).select("cfg", "detector", "config", "progress_aware")
    m = metrics(spark, folder).join(F.broadcast(order), ["detector", "config"]).where("f1 IS NOT NULL")
    kind = F.when(F.col("progress_aware"), "progress-aware").otherwise("progress-insensitive").alias("guard_type")
    best = m.groupBy("dataset", kind).agg(F.max(F.struct("f1", (-F.col("cfg")).alias("o"), "detector", "config", "piir", "hn_fpr")).alias("b"))
    both = best.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("dataset"))).where("kinds = 2")  # two rows for each pool
    return both.select("dataset", "guard_type", "b.detector", "b.config", "b.f1", "b.piir", "b.hn_fpr")


# ---------------------------------------------------------------- SQL twins

_CONTRIBUTIONS = METRICS_CTE + """,
tj AS (SELECT dataset, trajectory_id, count(*) AS eligible, count(*) FILTER (in_uc) AS uc, count(*) FILTER (in_hn) AS hn FROM steps GROUP BY 1, 2),
tf AS (SELECT dataset, trajectory_id, cfg, count(*) AS fired, count(*) FILTER (in_uc) AS tp, count(*) FILTER (in_hn) AS hn_fired FROM trig GROUP BY 1, 2, 3),
ts AS (SELECT dataset, trajectory_id, count(*) FILTER (label = 'unproductive_cycle') AS uc_total, count(*) FILTER (label = 'productive_iteration') AS pi_total FROM es GROUP BY 1, 2),
th AS (SELECT dataset, trajectory_id, cfg, count(*) FILTER (label = 'unproductive_cycle') AS uc_recalled, count(*) FILTER (label = 'productive_iteration') AS pi_hit,
  sum(hit_at - first_position) FILTER (label = 'unproductive_cycle') AS latency_sum FROM hits GROUP BY 1, 2, 3),
con AS (SELECT tj.dataset, tj.trajectory_id, c.cfg, c.detector, c.config, coalesce(tp, 0) AS tp, coalesce(fired, 0) - coalesce(tp, 0) AS fp, uc - coalesce(tp, 0) AS fn,
  eligible - uc - coalesce(fired, 0) + coalesce(tp, 0) AS tn, coalesce(uc_recalled, 0) AS uc_recalled, coalesce(uc_total, 0) AS uc_total, coalesce(pi_hit, 0) AS pi_hit,
  coalesce(pi_total, 0) AS pi_total, coalesce(hn_fired, 0) AS hn_fired, hn, coalesce(fired, 0) AS fired, eligible, coalesce(latency_sum, 0)::BIGINT AS latency_sum,
  coalesce(uc_recalled, 0) AS latency_count
  FROM tj CROSS JOIN cfgs c LEFT JOIN tf ON tf.dataset = tj.dataset AND tf.trajectory_id = tj.trajectory_id AND tf.cfg = c.cfg
  LEFT JOIN ts ON ts.dataset = tj.dataset AND ts.trajectory_id = tj.trajectory_id
  LEFT JOIN th ON th.dataset = tj.dataset AND th.trajectory_id = tj.trajectory_id AND th.cfg = c.cfg)
"""
DETECTOR_CONTRIBUTIONS_SQL = _CONTRIBUTIONS + "SELECT * EXCLUDE (cfg) FROM con"


def _ratio_sql(metric: str, total: str) -> str:
    n, d = (" + ".join(f"{w} * {total.format(c)}" for c, w in terms.items()) for terms in RATIOS[metric])
    return f"CASE WHEN {d} <> 0 THEN ({n})::DOUBLE / ({d}) END"


_SUMMED = sorted({c for n, d in RATIOS.values() for c in (*n, *d)})
DETECTOR_INTERVALS_SQL = _CONTRIBUTIONS + f""",
u AS (SELECT dataset, trajectory_id, rep, {poisson_weight_sql("('0x' || substr(md5(dataset || '|' || trajectory_id || '|' || rep::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE")} AS w
  FROM tj, range({REPLICATES}) t(rep)),
rs AS (SELECT con.dataset, cfg, rep, {', '.join(f'sum(w * {c}) AS {c}' for c in _SUMMED)} FROM con JOIN u ON u.dataset = con.dataset AND u.trajectory_id = con.trajectory_id GROUP BY 1, 2, 3),
rv AS ({' UNION ALL '.join(f"SELECT dataset, cfg, '{m}' AS metric, {_ratio_sql(m, '{}')} AS v FROM rs" for m in RATIOS)}),
pt AS (SELECT dataset, cfg, detector, config, {', '.join(f'sum({c}) AS {c}' for c in _SUMMED)} FROM con GROUP BY 1, 2, 3, 4),
pv AS ({' UNION ALL '.join(f"SELECT dataset, cfg, detector, config, '{m}' AS metric, {_ratio_sql(m, '{}')} AS point FROM pt" for m in RATIOS)}),
en AS (SELECT dataset, cfg, metric, round(quantile_cont(v, 0.025), 9) AS ci_low, round(quantile_cont(v, 0.975), 9) AS ci_high FROM rv WHERE v IS NOT NULL GROUP BY 1, 2, 3)
SELECT pv.dataset, detector, config, pv.metric, round(point, 9) AS point, ci_low, ci_high FROM pv LEFT JOIN en ON en.dataset = pv.dataset AND en.cfg = pv.cfg AND en.metric = pv.metric"""

TRIGGER_TABLE_SQL = METRICS_CTE + f""",
sx AS (SELECT dataset, trajectory_id, position, step_index, {STOP_COLUMNS_SQL},
  CASE WHEN in_uc THEN 'UC' WHEN in_hn THEN 'HN' WHEN in_pi THEN 'PI' WHEN in_uncertain THEN 'uncertain' ELSE 'other' END AS location FROM steps),
sy AS (SELECT sx.*,
  (SELECT count(*) FROM sp WHERE sp.dataset = sx.dataset AND sp.trajectory_id = sx.trajectory_id AND sp.b > sx.step_index AND (label = 'productive_iteration' OR pi OR hn)) AS productive_spans_after,
  (SELECT count(*) FROM sp WHERE sp.dataset = sx.dataset AND sp.trajectory_id = sx.trajectory_id AND sp.b > sx.step_index AND (label = 'unproductive_cycle' OR uc)) AS uc_spans_after FROM sx),
fam(detector, family) AS (VALUES {', '.join(sorted({f"('{c.detector}', '{c.family}')" for c in CONFIGS}))})
SELECT t.dataset, t.trajectory_id, t.step_index, t.position, location, remaining_steps, remaining_pi, remaining_hn, remaining_uc, remaining_productive, productive_spans_after, uc_spans_after,
  t.position = min(t.position) OVER (PARTITION BY t.dataset, t.trajectory_id, t.cfg) AS is_first, t.detector, t.config, family,
  remaining_productive > 0 OR productive_spans_after > 0 AS cuts_productive, remaining_uc > 0 OR uc_spans_after > 0 AS saves_uc,
  'trig_' || lpad(row_number() OVER (ORDER BY t.dataset, t.detector, t.config, t.trajectory_id, t.step_index)::VARCHAR, 8, '0') AS trigger_id, f1, uc_recall, piir, hn_fpr, burden
FROM trig t JOIN sy s ON s.dataset = t.dataset AND s.trajectory_id = t.trajectory_id AND s.position = t.position JOIN fam ON fam.detector = t.detector
LEFT JOIN met ON met.dataset = t.dataset AND met.cfg = t.cfg"""

NEAR_F1_STOPS_SQL = first_stops_cte(METRICS_CTE) + f""",
ss AS (SELECT stops.dataset, c.detector, c.config, avg(remaining_productive) AS cut, avg(remaining_uc) AS saved FROM stops JOIN cfgs c USING (cfg) GROUP BY 1, 2, 3),
np AS ({NEAR_F1_PAIRS_SQL[len(METRICS_CTE):]})
SELECT np.dataset, detector_a, config_a, detector_b, config_b, abs_f1_diff, abs_piir_diff, abs_hn_fpr_diff, x.cut AS cut_a, x.saved AS saved_a, y.cut AS cut_b, y.saved AS saved_b,
  abs(x.cut - y.cut) AS abs_cut_diff, abs(x.saved - y.saved) AS abs_saved_diff
FROM np JOIN ss x ON x.dataset = np.dataset AND x.detector = detector_a AND x.config = config_a JOIN ss y ON y.dataset = np.dataset AND y.detector = detector_b AND y.config = config_b"""

_AWARE = ", ".join(str(i) for i, c in enumerate(CONFIGS) if c.progress_aware)
PROGRESS_COMPARISON_SQL = METRICS_CTE + f""",
k AS (SELECT *, CASE WHEN cfg IN ({_AWARE}) THEN 'progress-aware' ELSE 'progress-insensitive' END AS guard_type FROM met WHERE f1 IS NOT NULL),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY dataset, guard_type ORDER BY f1 DESC, cfg) = 1)
SELECT dataset, guard_type, detector, config, f1, piir, hn_fpr FROM b QUALIFY count(*) OVER (PARTITION BY dataset) = 2"""

NAMES = ["detector_contributions", "detector_intervals", "trigger_table", "near_f1_stops", "progress_comparison"]
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[f"{n.upper()}_SQL"] for n in NAMES}
