"""Audits and construct analyses of steps and spans: flags, lengths, gaps, labels, prevalence, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.functions.parse import SPAN_LABELS, STEP_LABELS, bool_known, json_score
from steploom.operators import sequence as seq
from steploom.operators.intervals import periods_and_gaps
from steploom.operators.ranking import range_totals, running_total
from steploom.operators.sequence import KEYS, ONCE_SQL, PREPARED_SQL, SPANS_SQL
from steploom.sources.tables import checkpointed, read_table

PREVIEW = 20
LONGEST_SHARE = 0.9
#: Spans whose bounds lie further apart are left out of projected densities.
LONGEST_SPAN = 10_000


def one(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def _steps(spark, folder: str, *columns: str) -> DataFrame:
    return seq.steps_once(read_table(spark, folder, "enriched_steps", "dataset", "trajectory_id", "step_index", *columns))


def _spans(spark, folder: str) -> DataFrame:
    return seq.ordered_spans(read_table(spark, folder, "normalized_spans"))


def trajectory_flags(spark, folder: str) -> DataFrame:
    """Per trajectory: steps by label and flag, spans by kind. A trajectory without spans has zeros."""
    flags = ["hard_negative", "productive_iteration_flag", "unproductive_cycle_flag"]
    s = _steps(spark, folder, "label_norm", *flags)
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    steps = s.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("steps"), F.max("step_index").alias("last_index"),
        *[one(F.col("label_norm") == v).alias(f"{v}_steps") for v in ("productive", "stagnant", "uncertain", "neutral")],
        one(on("hard_negative")).alias("hn_steps"), one(on("productive_iteration_flag")).alias("pi_steps"), one(on("unproductive_cycle_flag")).alias("uc_steps"),
    )
    spans = _spans(spark, folder).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("spans"), one(F.col("label") == "productive_iteration").alias("pi_spans"),
        one(F.col("label") == "unproductive_cycle").alias("uc_spans"), one(F.col("hard_negative")).alias("hn_spans"),
    )
    return steps.join(spans, KEYS, "left").na.fill(0, ["spans", "pi_spans", "uc_spans", "hn_spans"])


TRAJECTORY_FLAGS_CTE = f"""
WITH {ONCE_SQL}, {SPANS_SQL},
st AS (SELECT dataset, trajectory_id, count(*) AS steps, max(step_index) AS last_index,
  count(*) FILTER (label_norm = 'productive') AS productive_steps, count(*) FILTER (label_norm = 'stagnant') AS stagnant_steps,
  count(*) FILTER (label_norm = 'uncertain') AS uncertain_steps, count(*) FILTER (label_norm = 'neutral') AS neutral_steps,
  count(*) FILTER (hard_negative) AS hn_steps, count(*) FILTER (productive_iteration_flag) AS pi_steps, count(*) FILTER (unproductive_cycle_flag) AS uc_steps
  FROM s0 GROUP BY 1, 2),
ss AS (SELECT dataset, trajectory_id, count(*) AS spans, count(*) FILTER (label = 'productive_iteration') AS pi_spans,
  count(*) FILTER (label = 'unproductive_cycle') AS uc_spans, count(*) FILTER (hn) AS hn_spans FROM sp GROUP BY 1, 2),
fl AS (SELECT st.*, coalesce(spans, 0) AS spans, coalesce(pi_spans, 0) AS pi_spans, coalesce(uc_spans, 0) AS uc_spans, coalesce(hn_spans, 0) AS hn_spans
  FROM st LEFT JOIN ss USING (dataset, trajectory_id))"""
TRAJECTORY_FLAGS_SQL = TRAJECTORY_FLAGS_CTE + " SELECT * FROM fl"


def prevalence(spark, folder: str) -> DataFrame:
    """Per pool: trajectories and how many hold UC, PI and HN, and which of HN and UC they mix."""
    f = trajectory_flags(spark, folder)
    uc = (F.col("uc_spans") > 0) | (F.col("uc_steps") > 0)
    pi = (F.col("pi_spans") > 0) | (F.col("pi_steps") > 0)
    hn = (F.col("hn_spans") > 0) | (F.col("hn_steps") > 0)
    return f.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("trajectories"), one(uc).alias("with_uc"), one(pi).alias("with_pi"), one(hn).alias("with_hn"),
        one(hn & ~uc).alias("hn_only"), one(uc & ~hn).alias("uc_only"), one(uc & hn).alias("hn_and_uc"), one(~uc & ~hn).alias("neither"),
        F.min(F.when(uc & hn, F.col("trajectory_id"))).alias("example_hn_and_uc"),
    )


PREVALENCE_SQL = TRAJECTORY_FLAGS_CTE + """,
x AS (SELECT *, uc_spans > 0 OR uc_steps > 0 AS uc, pi_spans > 0 OR pi_steps > 0 AS pi, hn_spans > 0 OR hn_steps > 0 AS hn FROM fl)
SELECT dataset, count(*) AS trajectories, count(*) FILTER (uc) AS with_uc, count(*) FILTER (pi) AS with_pi, count(*) FILTER (hn) AS with_hn,
  count(*) FILTER (hn AND NOT uc) AS hn_only, count(*) FILTER (uc AND NOT hn) AS uc_only, count(*) FILTER (uc AND hn) AS hn_and_uc,
  count(*) FILTER (NOT uc AND NOT hn) AS neither, min(trajectory_id) FILTER (uc AND hn) AS example_hn_and_uc FROM x GROUP BY 1"""


def length_summary(spark, folder: str) -> DataFrame:
    n = _steps(spark, folder).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("trajectories"), F.sum("n").alias("steps"), F.avg("n").alias("mean_length"), F.percentile("n", 0.5).alias("median_length"),
        F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.percentile("n", 0.9).alias("p90_length"),
    )


LENGTH_SUMMARY_SQL = f"""
WITH {ONCE_SQL}, n AS (SELECT dataset, trajectory_id, count(*) AS n FROM s0 GROUP BY 1, 2)
SELECT dataset, count(*) AS trajectories, sum(n)::BIGINT AS steps, avg(n) AS mean_length, quantile_cont(n, 0.5) AS median_length, min(n) AS min_length,
  max(n) AS max_length, quantile_cont(n, 0.9) AS p90_length FROM n GROUP BY 1"""


def longest_decile(spark, folder: str) -> DataFrame:
    """UC prevalence of the longest trajectories of each pool (at or above its 90th percentile) and the rest."""
    f = trajectory_flags(spark, folder).select("dataset", "steps", ((F.col("uc_spans") > 0) | (F.col("uc_steps") > 0)).alias("uc"))
    limit = f.groupBy("dataset").agg(F.percentile("steps", LONGEST_SHARE).alias("limit"))
    x = f.join(F.broadcast(limit), "dataset").withColumn("length_group", F.when(F.col("steps") >= F.col("limit"), "longest").otherwise("rest"))
    return x.groupBy("dataset", "length_group").agg(
        F.count(F.lit(1)).alias("trajectories"), F.avg(F.col("uc").cast("double")).alias("uc_prevalence"), F.avg("steps").alias("mean_length")
    )


LONGEST_DECILE_SQL = TRAJECTORY_FLAGS_CTE + """,
l AS (SELECT dataset, quantile_cont(steps, 0.9) AS lim FROM fl GROUP BY 1)
SELECT dataset, CASE WHEN steps >= lim THEN 'longest' ELSE 'rest' END AS length_group, count(*) AS trajectories,
  avg((uc_spans > 0 OR uc_steps > 0)::INT) AS uc_prevalence, avg(steps) AS mean_length FROM fl JOIN l USING (dataset) GROUP BY 1, 2"""


EVERY = "all"
#: Fixed value: the pool that robustness checks leave out.
OUTSIDE_POOL = "OpenHandsExternal330"


def _scopes(df: DataFrame) -> DataFrame:
    """Every row under its pool, under all pools, and, unless it is of the outside pool, under all without that."""
    names = F.array(F.col("dataset"), F.lit(EVERY), F.when(F.col("dataset") != OUTSIDE_POOL, F.lit(f"{EVERY}_without_{OUTSIDE_POOL}")))
    return df.withColumn("scope", F.explode(names)).where("scope IS NOT NULL")


_SCOPES_SQL = f"""(SELECT *, dataset AS scope FROM fl UNION ALL SELECT *, '{EVERY}' FROM fl
  UNION ALL SELECT *, '{EVERY}_without_{OUTSIDE_POOL}' FROM fl WHERE dataset <> '{OUTSIDE_POOL}')"""


def length_correlation(spark, folder: str) -> DataFrame:
    """Spearman's rank correlation of trajectory length with the share of UC steps, per pool, over all, and without the outside pool.

    Ranks are averages over ties, from counts per distinct value, added up over ranges of the values.
    """
    f = trajectory_flags(spark, folder).select("dataset", F.col("steps").cast("double").alias("x"), (F.col("uc_steps") / F.col("steps")).alias("y"))
    f = checkpointed(_scopes(f))

    def ranks(c: str) -> DataFrame:
        n = f.groupBy("scope", c).agg(F.count(F.lit(1)).alias("n"))
        return range_totals(n, ["scope"], [c], "n", "upto").select("scope", c, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(f"r_{c}"))

    return f.join(ranks("x"), ["scope", "x"]).join(ranks("y"), ["scope", "y"]).groupBy("scope").agg(
        F.count(F.lit(1)).alias("trajectories"), F.round(F.corr("r_x", "r_y"), 9).alias("spearman")
    )


LENGTH_CORRELATION_SQL = TRAJECTORY_FLAGS_CTE + f""",
v AS (SELECT scope, steps::DOUBLE AS x, uc_steps / steps AS y FROM {_SCOPES_SQL}),
r AS (SELECT scope, rank() OVER (PARTITION BY scope ORDER BY x) + (count(*) OVER (PARTITION BY scope, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY scope ORDER BY y) + (count(*) OVER (PARTITION BY scope, y) - 1) / 2.0 AS ry FROM v)
SELECT scope, count(*) AS trajectories, CASE WHEN isnan(corr(rx, ry)) THEN NULL ELSE round(corr(rx, ry), 9) END AS spearman FROM r GROUP BY 1"""


def length_groups(spark, folder: str) -> DataFrame:
    """Longest tenth against the rest, by the 90th percentile of each scope: lengths, UC and HN prevalence, UC density."""
    has = lambda k: (F.col(f"{k}_spans") > 0) | (F.col(f"{k}_steps") > 0)
    f = trajectory_flags(spark, folder).select("dataset", "steps", has("uc").alias("uc"), has("hn").alias("hn"), (F.col("uc_steps") / F.col("steps")).alias("density"))
    f = checkpointed(_scopes(f))
    limit = f.groupBy("scope").agg(F.percentile("steps", LONGEST_SHARE).alias("limit"))  # a row for each scope
    x = f.join(F.broadcast(limit), "scope").withColumn("length_group", F.when(F.col("steps") >= F.col("limit"), "longest").otherwise("rest"))
    return x.groupBy("scope", "length_group").agg(
        F.count(F.lit(1)).alias("trajectories"), F.avg("steps").alias("mean_length"), F.percentile("steps", 0.5).alias("median_length"), F.round(F.percentile("steps", 0.9), 6).alias("p90_length"),
        one(F.col("uc")).alias("with_uc"), F.avg(F.col("uc").cast("int")).alias("uc_prevalence"), one(F.col("hn")).alias("with_hn"),
        F.avg(F.col("hn").cast("int")).alias("hn_prevalence"), F.round(F.avg("density"), 9).alias("mean_uc_density"),
    )


LENGTH_GROUPS_SQL = TRAJECTORY_FLAGS_CTE + f""",
v AS (SELECT scope, steps, (uc_spans > 0 OR uc_steps > 0)::INT AS uc, (hn_spans > 0 OR hn_steps > 0)::INT AS hn, uc_steps / steps AS density FROM {_SCOPES_SQL}),
l AS (SELECT scope, quantile_cont(steps, 0.9) AS lim FROM v GROUP BY 1)
SELECT scope, CASE WHEN steps >= lim THEN 'longest' ELSE 'rest' END AS length_group, count(*) AS trajectories, avg(steps) AS mean_length, quantile_cont(steps, 0.5) AS median_length,
  round(quantile_cont(steps, 0.9), 6) AS p90_length, sum(uc)::BIGINT AS with_uc, avg(uc) AS uc_prevalence, sum(hn)::BIGINT AS with_hn, avg(hn) AS hn_prevalence, round(avg(density), 9) AS mean_uc_density
FROM v JOIN l USING (scope) GROUP BY 1, 2"""


def duplicate_keys(spark, folder: str) -> DataFrame:
    """Step keys that occur on several rows."""
    t = read_table(spark, folder, "enriched_steps", "dataset", "trajectory_id", "step_index").where(F.col("step_index").isNotNull())
    return t.groupBy("dataset", "trajectory_id", "step_index").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


DUPLICATE_KEYS_SQL = "SELECT dataset, trajectory_id, step_index, count(*) AS rows FROM enriched_steps WHERE step_index IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1"


def index_gaps(spark, folder: str) -> DataFrame:
    """Missing step indexes between the first and last step: per gap its bounds and length."""
    s = seq.with_halo(seq.positioned(_steps(spark, folder)), halo=1)
    before = F.lag("step_index").over(seq.over_block())
    gap = s.select(*KEYS, "own", "step_index", before.alias("b")).where(F.col("own") & (F.col("step_index") > F.col("b") + 1))
    return gap.select(*KEYS, (F.col("b") + 1).alias("gap_start"), (F.col("step_index") - 1).alias("gap_end"), (F.col("step_index") - F.col("b") - 1).alias("missing"))


INDEX_GAPS_SQL = f"""
WITH {ONCE_SQL}, l AS (SELECT dataset, trajectory_id, step_index, lag(step_index) OVER (PARTITION BY dataset, trajectory_id ORDER BY step_index) AS b FROM s0)
SELECT dataset, trajectory_id, b + 1 AS gap_start, step_index - 1 AS gap_end, step_index - b - 1 AS missing FROM l WHERE step_index > b + 1"""


def missing_indexes(spark, folder: str) -> DataFrame:
    """Per trajectory with gaps: the number of missing indexes and the first 20 of them, joined by commas.

    Every gap holds at least one index, so the first 20 gaps are enough for the preview.
    """
    gaps = checkpointed(index_gaps(spark, folder))
    few = running_total(gaps, KEYS, "gap_start", None, "n").where(F.col("n") <= PREVIEW)
    first = few.select(*KEYS, F.explode(F.sequence("gap_start", F.least("gap_end", F.col("gap_start") + PREVIEW - 1))).alias("i"))
    shown = first.groupBy(*KEYS).agg(F.concat_ws(",", F.slice(F.sort_array(F.collect_list("i")), 1, PREVIEW).cast("array<string>")).alias("preview"))
    return gaps.groupBy(*KEYS).agg(F.sum("missing").alias("missing")).join(shown, KEYS)


MISSING_INDEXES_SQL = INDEX_GAPS_SQL.replace("SELECT dataset, trajectory_id, b + 1", ", g AS (SELECT dataset, trajectory_id, b + 1", 1) + """),
i AS (SELECT dataset, trajectory_id, unnest(range(gap_start, gap_end + 1)) AS i FROM g)
SELECT dataset, trajectory_id, count(*) AS missing, array_to_string(list_slice(list_sort(list(i)), 1, 20), ',') AS preview FROM i GROUP BY 1, 2"""


def label_distribution(spark, folder: str) -> DataFrame:
    """Values of both label columns per pool with their share; blank and null as not_available."""
    s = _steps(spark, folder, "label_norm", "span_label_norm")
    each = s.select("dataset", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("label_norm", "span_label_norm")])).alias("x"))
    value = F.coalesce(F.nullif(F.trim("x.v"), F.lit("")), F.lit("not_available"))
    n = each.groupBy("dataset", "x.field", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dataset", "field")))


LABEL_DISTRIBUTION_SQL = f"""
WITH {ONCE_SQL}, x AS (SELECT dataset, 'label_norm' AS field, label_norm AS v FROM s0 UNION ALL SELECT dataset, 'span_label_norm', span_label_norm FROM s0),
n AS (SELECT dataset, field, coalesce(nullif(trim(v), ''), 'not_available') AS value, count(*) AS n FROM x GROUP BY 1, 2, 3)
SELECT *, n / sum(n) OVER (PARTITION BY dataset, field) AS share FROM n"""


def illegal_labels(spark, folder: str) -> DataFrame:
    """Label values outside the legal ones, by table, with their rows."""
    steps = read_table(spark, folder, "enriched_steps", "label_norm").select(F.lit("steps").alias("source"), F.col("label_norm").alias("value"), F.lit(0).alias("k"))
    spans = read_table(spark, folder, "normalized_spans", "span_label_norm").select(F.lit("spans").alias("source"), F.col("span_label_norm").alias("value"), F.lit(1).alias("k"))
    legal = F.when(F.col("k") == 0, F.col("value").isin(*sorted(set(STEP_LABELS.values())))).otherwise(F.col("value").isin(*sorted(set(SPAN_LABELS.values()))))
    return steps.unionByName(spans).where(F.col("value").isNotNull() & ~legal).groupBy("source", "value").agg(F.count(F.lit(1)).alias("rows"))


ILLEGAL_LABELS_SQL = """
SELECT 'steps' AS source, label_norm AS value, count(*) AS rows FROM enriched_steps WHERE label_norm NOT IN ('productive', 'stagnant', 'uncertain', 'neutral') GROUP BY 1, 2
UNION ALL SELECT 'spans', span_label_norm, count(*) FROM normalized_spans
WHERE span_label_norm NOT IN ('productive_iteration', 'unproductive_cycle', 'uncertain', 'unresolved', 'none') GROUP BY 1, 2"""


def id_overlap(spark, folder: str) -> DataFrame:
    """For each two pools the number of task ids they share, zeros included. Pools are few and fixed."""
    t = read_table(spark, folder, "enriched_steps", "dataset", "task_id").where("dataset IS NOT NULL AND task_id IS NOT NULL").distinct()
    t = checkpointed(t)
    pools = [r.dataset for r in t.select("dataset").distinct().orderBy("dataset").collect()]
    per_task = t.groupBy("task_id").agg(F.collect_set("dataset").alias("d"))  # at most one entry per pool
    counts = [one(F.array_contains("d", a) & F.array_contains("d", b)).alias(f"c{i}_{j}") for i, a in enumerate(pools) for j, b in enumerate(pools)]
    if not pools:
        return spark.createDataFrame([], "dataset_a string, dataset_b string, shared bigint")
    cells = [
        F.struct(F.lit(a).alias("dataset_a"), F.lit(b).alias("dataset_b"), F.col(f"c{i}_{j}").alias("shared"))
        for i, a in enumerate(pools)
        for j, b in enumerate(pools)
    ]
    return per_task.agg(*counts).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


ID_OVERLAP_SQL = """
WITH t AS (SELECT DISTINCT dataset, task_id FROM enriched_steps WHERE dataset IS NOT NULL AND task_id IS NOT NULL), d AS (SELECT DISTINCT dataset FROM t)
SELECT a.dataset AS dataset_a, b.dataset AS dataset_b,
  (SELECT count(*) FROM t x JOIN t y ON x.task_id = y.task_id WHERE x.dataset = a.dataset AND y.dataset = b.dataset) AS shared FROM d a CROSS JOIN d b"""


def uncertain_counts(spark, folder: str) -> DataFrame:
    """Uncertain and unresolved flags per pool, in steps and in spans."""
    def part(name: str, df: DataFrame) -> DataFrame:
        return df.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), one(F.col("uncertain_flag")).alias("uncertain"), one(F.col("unresolved_flag")).alias("unresolved")).withColumn("source", F.lit(name))

    flags = ["uncertain_flag", "unresolved_flag"]
    spans = read_table(spark, folder, "normalized_spans").withColumn("dataset", F.coalesce("dataset", F.lit("")))
    spans = spans.drop("row_number", "ingested_at").distinct()
    return part("steps", _steps(spark, folder, *flags)).unionByName(part("spans", spans))


UNCERTAIN_COUNTS_SQL = f"""
WITH {ONCE_SQL}, n AS (SELECT DISTINCT * EXCLUDE (row_number, ingested_at) FROM normalized_spans)
SELECT coalesce(dataset, '') AS dataset, count(*) AS rows, count(*) FILTER (uncertain_flag) AS uncertain, count(*) FILTER (unresolved_flag) AS unresolved, 'spans' AS source FROM n GROUP BY 1
UNION ALL SELECT dataset, count(*), count(*) FILTER (uncertain_flag), count(*) FILTER (unresolved_flag), 'steps' FROM s0 GROUP BY 1"""

_FIELDS = ["raw_action_text", "tool_name", "command_text", "thought_text", "observation_text", "output_text", "error_text", "file_path", "mentioned_files", "signal_fields"]


def field_availability(spark, folder: str) -> DataFrame:
    """Per pool and text field: rows with a value, all rows, and their ratio."""
    s = _steps(spark, folder, *_FIELDS)
    wide = s.groupBy("dataset").agg(F.count(F.lit(1)).alias("total"), *[one(F.trim(c) != "").alias(c) for c in _FIELDS])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in _FIELDS])
    return wide.select("dataset", "total", F.explode(cells).alias("x")).select("dataset", "x.field", "x.filled", "total", (F.col("x.filled") / F.col("total")).alias("coverage"))


FIELD_AVAILABILITY_SQL = f"WITH {ONCE_SQL} " + " UNION ALL ".join(
    f"SELECT dataset, '{c}' AS field, count(*) FILTER (trim({c}) <> '') AS filled, count(*) AS total, count(*) FILTER (trim({c}) <> '') / count(*) AS coverage FROM s0 GROUP BY 1"
    for c in _FIELDS
)


#: Fixed value: the scores that signals carry.
SCORES = ["progress", "recurrence", "novelty", "error_persistence", "budget_pressure"]


def signal_regions(spark, folder: str) -> DataFrame:
    """Five signal scores by region of the step's own flags; of several flags uncertain beats HN beats UC beats PI.

    with_scores counts steps with any of the first four scores, which older records have.
    """
    flags = {"uncertain_flag": "uncertain_or_unresolved", "hard_negative": "HN", "unproductive_cycle_flag": "UC", "productive_iteration_flag": "PI_non_HN"}
    s = _steps(spark, folder, "signal_fields", *flags)
    region = F.lit("other")
    for flag, name in reversed(flags.items()):
        region = F.when(bool_known(F.col(flag)), name).otherwise(region)
    s = s.select("dataset", region.alias("region"), *[json_score(F.col("signal_fields"), n).alias(n) for n in SCORES])
    any_ = F.coalesce(*SCORES[:4]).isNotNull()
    measures = [m for n in SCORES for m in (F.round(F.avg(n), 9).alias(f"{n}_mean"), F.percentile(n, 0.5).alias(f"{n}_median"))]
    return s.groupBy("dataset", "region").agg(
        F.count(F.lit(1)).alias("steps"), one(any_).alias("with_scores"), F.avg(any_.cast("int")).alias("coverage"), *measures
    )


SIGNAL_REGIONS_SQL = f"""WITH {ONCE_SQL}, x AS (SELECT dataset, CASE WHEN uncertain_flag THEN 'uncertain_or_unresolved' WHEN hard_negative THEN 'HN'
  WHEN unproductive_cycle_flag THEN 'UC' WHEN productive_iteration_flag THEN 'PI_non_HN' ELSE 'other' END AS region,
  {', '.join(f"{seq.score_sql(n)} AS {n}" for n in SCORES)} FROM s0)
SELECT dataset, region, count(*) AS steps, count(*) FILTER (coalesce({', '.join(SCORES[:4])}) IS NOT NULL) AS with_scores,
  avg((coalesce({', '.join(SCORES[:4])}) IS NOT NULL)::INT) AS coverage,
  {', '.join(f"round(avg({n}), 9) AS {n}_mean, quantile_cont({n}, 0.5) AS {n}_median" for n in SCORES)} FROM x GROUP BY 1, 2"""


def projected_density(spark, folder: str) -> DataFrame:
    """Per pool: mean, median and maximum share of indexes that PI, HN and UC spans cover, by label or by flag.

    Covered indexes need not have a step row, so a share may exceed 1. Overlaps count once; spans whose
    end lies more than 10,000 behind their start are left out.
    """
    s = _spans(spark, folder).where(F.col("end") - F.col("start") <= LONGEST_SPAN)
    kinds = F.array(
        F.when((F.col("label") == "productive_iteration") | F.col("productive_iteration_flag"), "pi"), F.when(F.col("hard_negative"), "hn"),
        F.when((F.col("label") == "unproductive_cycle") | F.col("unproductive_cycle_flag"), "uc"),
    )
    marked = s.select(*KEYS, "start", "end", F.explode(kinds).alias("kind_")).where("kind_ IS NOT NULL")
    merged = periods_and_gaps(marked, [*KEYS, "kind_"], "start", "end").where("kind = 'period'")
    size = F.col("end") - F.col("start") + 1
    n = merged.groupBy(*KEYS).agg(*[F.sum(F.when(F.col("kind_") == k, size).otherwise(0)).alias(k) for k in ("pi", "hn", "uc")])
    steps = _steps(spark, folder).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    d = steps.join(n, KEYS, "left").na.fill(0, ["pi", "hn", "uc"]).select("dataset", *[(F.col(k) / F.col("n")).alias(k) for k in ("pi", "hn", "uc")])
    return d.groupBy("dataset").agg(
        *[m for k in ("pi", "hn", "uc") for m in (F.round(F.avg(k), 9).alias(f"{k}_mean"), F.percentile(k, 0.5).alias(f"{k}_median"), F.max(k).alias(f"{k}_max"))]
    )


_KIND_CONDITIONS = {"pi": "label = 'productive_iteration' OR pi", "hn": "hn", "uc": "label = 'unproductive_cycle' OR uc"}
PROJECTED_DENSITY_SQL = f"""
WITH {ONCE_SQL}, {SPANS_SQL},
c AS ({' UNION '.join(f"SELECT dataset, trajectory_id, '{k}' AS k, unnest(range(a, b + 1)) AS i FROM sp WHERE b - a <= {LONGEST_SPAN} AND ({x})" for k, x in _KIND_CONDITIONS.items())}),
n AS (SELECT dataset, trajectory_id, {', '.join(f"count(*) FILTER (k = '{k}') AS {k}" for k in _KIND_CONDITIONS)} FROM c GROUP BY 1, 2),
d AS (SELECT s.dataset, {', '.join(f"coalesce({k}, 0) / m AS {k}" for k in _KIND_CONDITIONS)}
  FROM (SELECT dataset, trajectory_id, count(*) AS m FROM s0 GROUP BY 1, 2) s LEFT JOIN n USING (dataset, trajectory_id))
SELECT dataset, {', '.join(f"round(avg({k}), 9) AS {k}_mean, quantile_cont({k}, 0.5) AS {k}_median, max({k}) AS {k}_max" for k in _KIND_CONDITIONS)} FROM d GROUP BY 1"""


def derived_spans(spark, folder: str) -> DataFrame:
    """Spans as maximal runs of steps with the same label other than none, with any hard negative."""
    s = seq.positioned(_steps(spark, folder, "span_label_norm", "hard_negative"))
    s = s.withColumn("label", seq.span_label(F.col("span_label_norm"))).where(F.col("label").isNotNull() & (F.col("label") != "none"))
    r = running_total(s, [*KEYS, "label"], "position", None, "n")
    return r.groupBy(*KEYS, "label", (F.col("position") - F.col("n")).alias("run")).agg(
        F.min("step_index").alias("start_step_index"), F.max("step_index").alias("end_step_index"), F.count(F.lit(1)).alias("step_count"),
        F.max(F.coalesce("hard_negative", F.lit(False))).alias("hard_negative"),
    ).drop("run")


DERIVED_SPANS_SQL = f"""
WITH {ONCE_SQL}, l AS (SELECT *, {seq.label_sql('span_label_norm')} AS label, row_number() OVER (PARTITION BY dataset, trajectory_id ORDER BY step_index) AS p FROM s0),
r AS (SELECT *, p - row_number() OVER (PARTITION BY dataset, trajectory_id, label ORDER BY step_index) AS g FROM l WHERE label NOT IN ('', 'none'))
SELECT dataset, trajectory_id, label, min(step_index) AS start_step_index, max(step_index) AS end_step_index, count(*) AS step_count,
  bool_or(coalesce(hard_negative, false)) AS hard_negative FROM r GROUP BY dataset, trajectory_id, label, g"""


def spans_by_id(spark, folder: str) -> DataFrame:
    """Spans grouped by their explicit id: first start, last end, any hard negative, rows."""
    return _spans(spark, folder).where("span_id IS NOT NULL").groupBy(*KEYS, "span_id").agg(
        F.min("start").alias("start_step_index"), F.max("end").alias("end_step_index"), F.max("hard_negative").alias("hard_negative"), F.count(F.lit(1)).alias("rows")
    )


SPANS_BY_ID_SQL = f"""WITH {SPANS_SQL} SELECT dataset, trajectory_id, span_id, min(a) AS start_step_index, max(b) AS end_step_index, bool_or(hn) AS hard_negative,
  count(*) AS rows FROM sp WHERE span_id IS NOT NULL GROUP BY 1, 2, 3"""


def span_overlaps(spark, folder: str) -> DataFrame:
    """HN spans that overlap UC spans of the same trajectory: number of pairs and best IoU per HN span.

    Spans meet in buckets of 64 indexes; a pair counts in the bucket where its overlap begins.
    """
    s = checkpointed(_spans(spark, folder))
    cols = [*KEYS, "span_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor(F.col("end") / 64))).alias("bk")]
    a = s.where(F.col("hard_negative")).select(*KEYS, "span_id", "start", "end", "label", cols[-1])
    b = s.where(F.col("label") == "unproductive_cycle").select(*KEYS, F.col("span_id").alias("o_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("hard_negative").alias("o_hn"), cols[-1])
    low, high = F.greatest("start", "o_start"), F.least("end", "o_end")
    same = F.col("span_id").eqNullSafe(F.col("o_id")) & (F.col("start") == F.col("o_start")) & (F.col("end") == F.col("o_end")) & (F.col("label") == "unproductive_cycle")
    pairs = a.join(b, [*KEYS, "bk"]).where((low <= high) & (F.floor(low / 64) == F.col("bk")) & ~same)
    inter = high - low + 1
    iou = inter / ((F.col("end") - F.col("start") + 1) + (F.col("o_end") - F.col("o_start") + 1) - inter)
    return pairs.groupBy(*KEYS, "span_id", "start", "end").agg(F.count(F.lit(1)).alias("overlapping"), F.max(iou).alias("best_iou"))


SPAN_OVERLAPS_SQL = f"""WITH {SPANS_SQL}
SELECT x.dataset, x.trajectory_id, x.span_id, x.a AS start, x.b AS end, count(*) AS overlapping,
  max((least(x.b, y.b) - greatest(x.a, y.a) + 1) / ((x.b - x.a + 1) + (y.b - y.a + 1) - (least(x.b, y.b) - greatest(x.a, y.a) + 1))) AS best_iou
FROM sp x JOIN sp y ON x.dataset = y.dataset AND x.trajectory_id = y.trajectory_id AND greatest(x.a, y.a) <= least(x.b, y.b)
WHERE x.hn AND y.label = 'unproductive_cycle'
  AND NOT (x.span_id IS NOT DISTINCT FROM y.span_id AND x.a = y.a AND x.b = y.b AND x.label = 'unproductive_cycle') GROUP BY 1, 2, 3, 4, 5"""


def public_ids(spark, folder: str) -> DataFrame:
    """Per pool the rank of each trajectory id as a padded number, and the SHA-256 of pool and id.

    Ids are sorted by ranges over all partitions; ranks are counted inside and added up.
    """
    ids = _steps(spark, folder).select(*KEYS).distinct()
    return range_totals(ids, ["dataset"], ["trajectory_id"], None, "r").select(
        *KEYS, F.format_string("%06d", "r").alias("public_number"), F.sha2(F.concat_ws("|", *KEYS), 256).alias("public_hash")
    )


PUBLIC_IDS_SQL = f"""
WITH {ONCE_SQL}, i AS (SELECT DISTINCT dataset, trajectory_id FROM s0)
SELECT dataset, trajectory_id, lpad(row_number() OVER (PARTITION BY dataset ORDER BY trajectory_id)::VARCHAR, 6, '0') AS public_number,
  sha256(dataset || '|' || trajectory_id) AS public_hash FROM i"""


def fingerprints(spark, folder: str) -> DataFrame:
    """Rows, distinct ids and an order-free fingerprint of the ids of three tables."""
    def part(table: str, key: str) -> DataFrame:
        t = read_table(spark, folder, table, key)
        mark = F.conv(F.substring(F.sha2(F.col(key), 256), 1, 8), 16, 10).cast("long")
        n = t.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.sum("n").alias("rows"), F.count(key).alias("ids"), F.sum(mark).alias("fingerprint")).withColumn("source", F.lit(table))

    a, b = part("enriched_steps", "trajectory_id"), part("normalized_spans", "trajectory_id")
    return a.unionByName(b).unionByName(part("api_replan_parsed_responses", "prompt_id"))


FINGERPRINTS_SQL = " UNION ALL ".join(
    f"""SELECT sum(n)::BIGINT AS rows, count({k}) AS ids, sum(('0x' || substr(sha256({k}), 1, 8))::BIGINT)::BIGINT AS fingerprint, '{t}' AS source
    FROM (SELECT {k}, count(*) AS n FROM {t} GROUP BY 1)"""
    for t, k in (("enriched_steps", "trajectory_id"), ("normalized_spans", "trajectory_id"), ("api_replan_parsed_responses", "prompt_id"))
)

NAMES = [
    "trajectory_flags", "prevalence", "length_summary", "longest_decile", "length_correlation", "length_groups", "duplicate_keys", "index_gaps", "missing_indexes",
    "label_distribution", "illegal_labels", "id_overlap", "uncertain_counts", "field_availability", "signal_regions", "projected_density",
    "derived_spans", "spans_by_id", "span_overlaps", "public_ids", "fingerprints",
]
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[f"{n.upper()}_SQL"] for n in NAMES}
