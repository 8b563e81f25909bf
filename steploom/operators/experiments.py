"""Paired comparison of experiment arms: latest attempts, rates, effects, bootstrap, McNemar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.functions.parse import bool_known, bool_or_null, bool_permissive, bool_reply, bool_strict
from steploom.sources.tables import checkpointed, read_table

NEUTRAL, WARN = "NEUTRAL_CONTINUE", "WARN_REPLAN"
BASE_ARM = "NO_GUARD"
#: Replicates of response and arm effects.
RESPONSE_REPLICATES, ARM_REPLICATES = 5000, 1000
#: Cumulated Poisson(1) probabilities: the weight of a pair in a replicate is the number passed.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
RATES = ["repeat_pattern", "new_evidence_action", "should_continue_bin", "progress_seeking_score"]


def latest_responses(responses: DataFrame) -> DataFrame:
    """The last received row of each prompt; rows without prompt_id are left out."""
    cols = [c for c in responses.columns if c not in ("prompt_id", "received_at")]
    # A null time is the earliest; of equal times the greatest values win, so the choice is fixed.
    last = responses.where("prompt_id IS NOT NULL").groupBy("prompt_id").agg(F.max(F.struct("received_at", *cols)).alias("r"))
    return last.select("prompt_id", "r.*")


def _word(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")


def _target(c: Column) -> Column:
    w = _word(c)
    return F.when(w.isin("", "none", "n/a", "na", "unknown"), "").otherwise(w)


def _yes(c: Column) -> Column:
    return _word(c).isin("true", "1", "yes", "y")


_RESPONSE = [
    "prompt_id", "released_prefix_id", "arm", "stratum", "dataset_display", "status", "json_parse_success", "next_action_type", "next_action_target",
    "uses_new_evidence", "repeats_recent_pattern", "expected_information_gain", "should_continue", "received_at",
]


def scored_responses(spark, folder: str) -> DataFrame:
    """Each usable answer with its scores; the prefix's summaries are joined on its three keys."""
    r = latest_responses(read_table(spark, folder, "api_replan_parsed_responses", *_RESPONSE)).where((F.col("status") == "ok") & F.col("json_parse_success"))
    keys = ["released_prefix_id", "stratum", "dataset_display"]
    p = read_table(spark, folder, "prefix_replan_sample", *keys, "recent_actions_summary", "repeated_pattern_summary")
    p = p.groupBy(*keys).agg(F.max("recent_actions_summary").alias("actions"), F.max("repeated_pattern_summary").alias("pattern"))
    j = r.join(p, keys, "left")
    target, kind = _target(F.col("next_action_target")), _target(F.col("next_action_type"))
    actions, pattern = _target(F.col("actions")), _target(F.col("pattern"))
    named = (F.length(target) >= 4) & (pattern.contains(target) | actions.contains(target))
    same_kind = (kind != "") & actions.contains(F.concat(F.lit("step_type="), kind)) & ~_yes(F.col("uses_new_evidence"))
    repeat = (_yes(F.col("repeats_recent_pattern")) | named | same_kind).cast("int")
    evidence = _yes(F.col("uses_new_evidence")).cast("int")
    gain = _word(F.col("expected_information_gain")).isin("medium", "high").cast("int")
    return j.select(
        "prompt_id", "released_prefix_id", "arm", "stratum", "dataset_display",
        repeat.alias("repeat_pattern"), F.greatest(evidence, gain).alias("new_evidence_action"),
        _yes(F.col("should_continue")).cast("int").alias("should_continue_bin"),
        ((F.col("stratum") == "productive_risk") & ~_yes(F.col("should_continue"))).cast("int").alias("unsafe_overstop"),
        (evidence + gain + 1 - repeat).alias("progress_seeking_score"), target.alias("target"), kind.alias("kind"),
    )


_S = r"regexp_replace(lower(trim(coalesce({0}, ''))), '\s+', ' ', 'g')"
_T = "CASE WHEN {0} IN ('', 'none', 'n/a', 'na', 'unknown') THEN '' ELSE {0} END"
_t = lambda c: _T.format(_S.format(c))
_y = lambda c: _S.format(c) + " IN ('true', '1', 'yes', 'y')"
SCORED_CTE = f"""
WITH lr AS (SELECT * FROM api_replan_parsed_responses WHERE prompt_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY received_at DESC NULLS LAST) = 1),
pf AS (SELECT released_prefix_id, stratum, dataset_display, max(recent_actions_summary) AS actions, max(repeated_pattern_summary) AS pattern FROM prefix_replan_sample GROUP BY 1, 2, 3),
j AS (SELECT lr.*, {_t('actions')} AS a, {_t('pattern')} AS p, {_t('next_action_target')} AS target, {_t('next_action_type')} AS kind
  FROM lr LEFT JOIN pf ON pf.released_prefix_id = lr.released_prefix_id AND pf.stratum = lr.stratum AND pf.dataset_display = lr.dataset_display
  WHERE status = 'ok' AND json_parse_success),
k AS (SELECT *, ({_y('repeats_recent_pattern')} OR (length(target) >= 4 AND (contains(p, target) OR contains(a, target)))
   OR (kind <> '' AND contains(a, 'step_type=' || kind) AND NOT ({_y('uses_new_evidence')})))::INT AS repeat_pattern,
  ({_y('uses_new_evidence')})::INT AS ev, ({_S.format('expected_information_gain')} IN ('medium', 'high'))::INT AS gain, ({_y('should_continue')})::INT AS should_continue_bin FROM j),
sc AS (SELECT prompt_id, released_prefix_id, arm, stratum, dataset_display, repeat_pattern, greatest(ev, gain) AS new_evidence_action, should_continue_bin,
  (stratum = 'productive_risk' AND should_continue_bin = 0)::INT AS unsafe_overstop, ev + gain + 1 - repeat_pattern AS progress_seeking_score, target, kind FROM k)
"""


def response_summary(spark, folder: str) -> DataFrame:
    """Rates per stratum and arm."""
    s = scored_responses(spark, folder)
    return s.groupBy("stratum", "arm").agg(
        F.countDistinct("released_prefix_id").alias("prefixes"), *[F.avg(c).alias(f"{c}_mean") for c in RATES], F.avg("unsafe_overstop").alias("unsafe_overstop_rate")
    )


RESPONSE_SUMMARY_SQL = SCORED_CTE + f"""SELECT stratum, arm, count(DISTINCT released_prefix_id) AS prefixes, {', '.join(f'avg({c}) AS {c}_mean' for c in RATES)},
  avg(unsafe_overstop) AS unsafe_overstop_rate FROM sc GROUP BY 1, 2"""


def arm_pairs(scored: DataFrame) -> DataFrame:
    """One row per prefix that has both arms, with the columns of both; of several answers the greatest prompt_id."""
    cols = ["stratum", "kind", "target", *RATES]
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, F.struct("prompt_id", *cols)))
    both = scored.where("released_prefix_id IS NOT NULL").groupBy("released_prefix_id").agg(pick(NEUTRAL).alias("n"), pick(WARN).alias("w"))
    return both.where("n IS NOT NULL AND w IS NOT NULL")


PAIRS_CTE = SCORED_CTE + f""", n AS (SELECT * FROM sc WHERE arm = '{NEUTRAL}' QUALIFY row_number() OVER (PARTITION BY released_prefix_id ORDER BY prompt_id DESC) = 1),
w AS (SELECT * FROM sc WHERE arm = '{WARN}' QUALIFY row_number() OVER (PARTITION BY released_prefix_id ORDER BY prompt_id DESC) = 1)"""


def action_shift(spark, folder: str) -> DataFrame:
    """Share of prefixes whose next action differs between the arms, per stratum of the warned arm."""
    p = arm_pairs(scored_responses(spark, folder))
    shift = (~F.col("n.kind").eqNullSafe(F.col("w.kind")) | ~F.col("n.target").eqNullSafe(F.col("w.target"))).cast("int")
    return p.groupBy(F.col("w.stratum").alias("stratum")).agg(F.count(F.lit(1)).alias("pairs"), F.avg(shift).alias("action_shift_rate"))


ACTION_SHIFT_SQL = PAIRS_CTE + """ SELECT w.stratum, count(*) AS pairs, avg((n.kind IS DISTINCT FROM w.kind OR n.target IS DISTINCT FROM w.target)::INT) AS action_shift_rate
FROM n JOIN w USING (released_prefix_id) GROUP BY 1"""


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, by a rational approximation with error below 1.5e-7."""
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mcnemar(spark, folder: str) -> DataFrame:
    """McNemar's test with continuity correction for three binary scores, neutral against warned."""
    p = arm_pairs(scored_responses(spark, folder))
    names = ["repeat_pattern", "new_evidence_action", "should_continue_bin"]
    x = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"n.{c}").alias("a"), F.col(f"w.{c}").alias("b")) for c in names])).alias("x")).select("x.*")
    g = x.groupBy("metric").agg(F.sum(F.when((F.col("a") == 1) & (F.col("b") == 0), 1).otherwise(0)).alias("only_neutral"), F.sum(F.when((F.col("a") == 0) & (F.col("b") == 1), 1).otherwise(0)).alias("only_warn"))
    m = F.col("only_neutral") + F.col("only_warn")
    chi = F.when(m > 0, F.pow(F.abs(F.col("only_neutral") - F.col("only_warn")) - 1, F.lit(2.0)) / m).otherwise(0.0)
    g = g.withColumn("chi2", chi)
    return g.select("metric", "only_neutral", "only_warn", "chi2", F.round(F.when(m > 0, erfc(F.sqrt(F.col("chi2") / 2.0))).otherwise(1.0), 6).alias("p_value"))


MCNEMAR_SQL = PAIRS_CTE + """, x AS (
""" + " UNION ALL ".join(f"SELECT '{c}' AS metric, n.{c} AS a, w.{c} AS b FROM n JOIN w USING (released_prefix_id)" for c in ("repeat_pattern", "new_evidence_action", "should_continue_bin")) + """),
g AS (SELECT metric, count(*) FILTER (a = 1 AND b = 0) AS only_neutral, count(*) FILTER (a = 0 AND b = 1) AS only_warn FROM x GROUP BY 1),
h AS (SELECT *, CASE WHEN only_neutral + only_warn > 0 THEN pow(abs(only_neutral - only_warn) - 1, 2.0) / (only_neutral + only_warn) ELSE 0.0 END AS chi2 FROM g),
i AS (SELECT *, 1.0::DOUBLE / (1.0 + 0.3275911::DOUBLE * sqrt(chi2 / 2.0)) AS t FROM h)
SELECT metric, only_neutral, only_warn, chi2, round(CASE WHEN only_neutral + only_warn > 0 THEN t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE
  + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-chi2 / 2.0) ELSE 1.0 END, 6) AS p_value FROM i"""


def bootstrap_weight(unit: Column, replicate: Column) -> Column:
    """A Poisson(1) weight from a hash of unit and replicate: the same in every engine and partitioning."""
    return _passed(F.md5(F.concat(unit, F.lit("|"), replicate.cast("string"))))


def _passed(digest: Column) -> Column:
    # The first 32 bits over 2 ** 32 pass p where the hex digits do not sort before p's.
    out = F.lit(0)
    for p in POISSON:
        out = out + (digest >= f"{math.ceil(p * 4294967296):08x}").cast("int")
    return out


def poisson_weight_sql(u: str) -> str:
    """The weight of a number from 0 to 1: how many of the cumulated probabilities it passes."""
    return " + ".join(f"({u} >= {p})::INT" for p in POISSON)


_WEIGHT_SQL = poisson_weight_sql("u")


def bootstraps(pairs: DataFrame, unit: str, values: list[str], by: list[str], replicates: int) -> DataFrame:
    """Mean of each of `values` with a 95 % percentile interval over weighted replicates of the units, per `by` and `metric`.

    A unit is weighed once a replicate for all values; a null counts in neither sum. Each replicate is a
    weighted sum, added up before the shuffle; units are never drawn on the driver.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = pairs.select(*by, F.col(unit).alias("unit"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(values)])
    # Few rows become many, so they are spread first.
    each = base.repartition(n, "unit").select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    each = each.withColumn("h", F.md5(F.concat("unit", F.lit("|"), F.col("rep").cast("string")))).withColumn("w", _passed(F.col("h")))
    v = [F.col(f"v{i}") for i in range(len(values))]
    reps = each.groupBy(*by, "rep").agg(*[x for i, c in enumerate(v) for x in (F.sum(F.col("w") * c).alias(f"s{i}"), F.sum(F.when(c.isNotNull(), F.col("w"))).alias(f"n{i}"))])
    cells = [F.struct(F.lit(c).alias("metric"), F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")).alias("m")) for i, c in enumerate(values)]
    ends = reps.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*").where("m IS NOT NULL").groupBy(*by, "metric").agg(
        F.round(F.percentile("m", 0.025), 9).alias("low"), F.round(F.percentile("m", 0.975), 9).alias("high")
    )
    cells = [F.struct(F.lit(c).alias("metric"), v[i].alias("v")) for i, c in enumerate(values)]
    point = base.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*").where("v IS NOT NULL").groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("units"), F.round(F.avg("v"), 9).alias("mean")
    )
    return point.join(ends, [*by, "metric"])


def bootstrap(pairs: DataFrame, unit: str, value: str, by: list[str], replicates: int) -> DataFrame:
    """`bootstraps` of one value."""
    return bootstraps(pairs, unit, [value], by, replicates).drop("metric")


def response_effects(spark, folder: str) -> DataFrame:
    """Difference warned minus neutral of each score over paired prefixes, with bootstrap intervals."""
    p = arm_pairs(scored_responses(spark, folder))
    d = checkpointed(p.select("released_prefix_id", *[(F.col(f"w.{c}") - F.col(f"n.{c}")).alias(c) for c in RATES]))
    return bootstraps(d, "released_prefix_id", RATES, [], RESPONSE_REPLICATES)


def _boot_sql(source: str, by: str, replicates: int) -> str:
    return f""",
r AS (SELECT {by}, d, ('0x' || substr(md5(unit || '|' || rep::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, rep FROM {source}, range({replicates}) t(rep)),
q AS (SELECT {by}, rep, sum(({_WEIGHT_SQL}) * d) AS s, sum({_WEIGHT_SQL}) AS n FROM r GROUP BY {by}, rep),
e AS (SELECT {by}, round(quantile_cont(s / n, 0.025), 9) AS low, round(quantile_cont(s / n, 0.975), 9) AS high FROM q WHERE n > 0 GROUP BY {by}),
o AS (SELECT {by}, count(*) AS units, round(avg(d), 9) AS mean FROM {source} GROUP BY {by})
SELECT * FROM o JOIN e USING ({by})"""


RESPONSE_EFFECTS_SQL = PAIRS_CTE + ", x AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, released_prefix_id AS unit, (w.{c} - n.{c})::DOUBLE AS d FROM n JOIN w USING (released_prefix_id)" for c in RATES
) + ")" + _boot_sql("x", "metric", RESPONSE_REPLICATES)


# ---------------------------------------------------------------- run log


def latest_runs(spark, folder: str) -> DataFrame:
    """The latest attempt of each task and arm: the last start time, then the greatest run_id."""
    t = read_table(spark, folder, "run_log").where("released_task_id IS NOT NULL AND arm IS NOT NULL")
    cols = [c for c in t.columns if c not in ("released_task_id", "arm", "start_time", "run_id")]
    last = t.groupBy("released_task_id", "arm").agg(F.max(F.struct("start_time", "run_id", *cols)).alias("r"))
    return last.select("released_task_id", "arm", "r.*")


LATEST_RUNS_CTE = """
WITH lr AS (SELECT * FROM run_log WHERE released_task_id IS NOT NULL AND arm IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY released_task_id, arm ORDER BY start_time DESC NULLS LAST, run_id DESC NULLS LAST) = 1),
x AS (SELECT *, tokens_input + tokens_output AS tokens, coalesce(lower(trim(guard_triggered)) IN ('true', '1', 'yes'), false)::INT AS guard,
  coalesce(lower(trim(patch_generated)) IN ('true', '1', 'yes'), false)::INT AS patch FROM lr)"""
_RUN_METRICS = ["steps", "tokens", "repeated_file_rate", "patch"]


def _runs(spark, folder: str) -> DataFrame:
    return (
        latest_runs(spark, folder)
        .withColumn("tokens", F.col("tokens_input") + F.col("tokens_output"))
        .withColumn("guard", bool_strict(F.col("guard_triggered")).cast("int"))
        .withColumn("patch", bool_strict(F.col("patch_generated")).cast("int"))
    )


def latest_run_rows(spark, folder: str) -> DataFrame:
    return latest_runs(spark, folder).select("released_task_id", "arm", "run_id", "status", "steps")


LATEST_RUN_ROWS_SQL = LATEST_RUNS_CTE + " SELECT released_task_id, arm, run_id, status, steps FROM lr"


def arm_summary(spark, folder: str) -> DataFrame:
    """Latest attempts per arm: counts, rates and means."""
    r = _runs(spark, folder)
    is_ = lambda s: F.col("status") == s
    return r.groupBy("arm").agg(
        F.count(F.lit(1)).alias("attempted"), F.sum(F.when(is_("completed"), 1).otherwise(0)).alias("completed"),
        F.avg(F.when(is_("infra_failure"), 1.0).otherwise(0.0)).alias("infrastructure_failure_rate"),
        F.avg("patch").alias("patch_generated_rate"), F.avg("guard").alias("guard_trigger_rate"), F.avg("steps").alias("mean_steps"),
        F.percentile("steps", 0.5).alias("median_steps"), F.avg("tokens").alias("mean_tokens"), F.avg("trigger_step").alias("mean_trigger_step"),
        F.round(F.avg("repeated_file_rate"), 9).alias("mean_repeated_file_rate"),
    )


ARM_SUMMARY_SQL = LATEST_RUNS_CTE + """ SELECT arm, count(*) AS attempted, count(*) FILTER (status = 'completed') AS completed,
  avg((status IS NOT DISTINCT FROM 'infra_failure')::INT) AS infrastructure_failure_rate, avg(patch) AS patch_generated_rate, avg(guard) AS guard_trigger_rate,
  avg(steps) AS mean_steps, quantile_cont(steps, 0.5) AS median_steps, avg(tokens) AS mean_tokens, avg(trigger_step) AS mean_trigger_step,
  round(avg(repeated_file_rate), 9) AS mean_repeated_file_rate FROM x GROUP BY 1"""


def arm_effects(spark, folder: str) -> DataFrame:
    """Each guarded arm minus no guard over the tasks that have both, with bootstrap intervals."""
    r = checkpointed(_runs(spark, folder).select("released_task_id", "arm", *_RUN_METRICS))
    base = r.where(F.col("arm") == BASE_ARM).select("released_task_id", *[F.col(c).cast("double").alias(f"b_{c}") for c in _RUN_METRICS])
    other = r.where(F.col("arm") != BASE_ARM).join(base, "released_task_id")
    d = other.select("released_task_id", "arm", *[(F.col(c).cast("double") - F.col(f"b_{c}")).alias(c) for c in _RUN_METRICS])
    return bootstraps(checkpointed(d), "released_task_id", _RUN_METRICS, ["arm"], ARM_REPLICATES)


ARM_EFFECTS_SQL = LATEST_RUNS_CTE + ", d0 AS (" + " UNION ALL ".join(
    f"SELECT a.arm, '{c}' AS metric, a.released_task_id AS unit, a.{c}::DOUBLE - b.{c}::DOUBLE AS d FROM x a JOIN x b USING (released_task_id) WHERE b.arm = '{BASE_ARM}' AND a.arm <> '{BASE_ARM}'"
    for c in _RUN_METRICS
) + "), dd AS (SELECT * FROM d0 WHERE d IS NOT NULL)" + _boot_sql("dd", "arm, metric", ARM_REPLICATES)


def bool_readings(spark, folder: str) -> DataFrame:
    """How the parsers read each spelling of guard_triggered in the run log."""
    t = read_table(spark, folder, "run_log", "guard_triggered")
    g = t.groupBy("guard_triggered").agg(F.count(F.lit(1)).alias("rows"))
    c = F.col("guard_triggered")
    return g.select(F.coalesce(c, F.lit("(null)")).alias("spelling"), "rows", bool_strict(c).alias("strict"), bool_permissive(c).alias("permissive"),
                    bool_or_null(c).alias("or_null"), bool_known(c).alias("known"), bool_reply(c).alias("reply"))


BOOL_READINGS_SQL = """SELECT coalesce(guard_triggered, '(null)') AS spelling, count(*) AS rows,
  coalesce(lower(trim(guard_triggered)) IN ('true', '1', 'yes'), false) AS strict,
  CASE WHEN lower(trim(guard_triggered)) IN ('true', '1', 'yes', 'y', 't') THEN true WHEN lower(trim(guard_triggered)) IN ('false', '0', 'no', 'n', 'f') THEN false
    ELSE coalesce(trim(guard_triggered) <> '', false) END AS permissive,
  CASE WHEN lower(trim(guard_triggered)) IN ('true', '1', 'yes', 'y', 't') THEN true WHEN lower(trim(guard_triggered)) IN ('false', '0', 'no', 'n', 'f') THEN false END AS or_null,
  coalesce(lower(trim(guard_triggered)) IN ('true', '1', 'yes', 'y', 't'), false) AS known, coalesce(lower(trim(guard_triggered)) IN ('true', '1', 'yes', 'y'), false) AS reply
  FROM run_log GROUP BY guard_triggered"""


def pending_prompts(spark, folder: str) -> DataFrame:
    """Prefix and arm pairs without a good response: what a resumed experiment would still run."""
    p = read_table(spark, folder, "prefix_replan_sample", "released_prefix_id").where("released_prefix_id IS NOT NULL").distinct()
    want = p.select("released_prefix_id", F.explode(F.array(F.lit(NEUTRAL), F.lit(WARN))).alias("arm"))
    done = read_table(spark, folder, "api_replan_parsed_responses", "released_prefix_id", "arm", "status", "json_parse_success").where((F.col("status") == "ok") & F.col("json_parse_success"))
    return want.join(done.select("released_prefix_id", "arm").distinct(), ["released_prefix_id", "arm"], "left_anti")


PENDING_PROMPTS_SQL = f"""SELECT DISTINCT released_prefix_id, arm FROM prefix_replan_sample p, (VALUES ('{NEUTRAL}'), ('{WARN}')) a(arm) WHERE released_prefix_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM api_replan_parsed_responses r WHERE r.released_prefix_id = p.released_prefix_id AND r.arm = a.arm AND status = 'ok' AND json_parse_success)"""

NAMES = [
    "response_summary", "action_shift", "mcnemar", "response_effects", "latest_run_rows", "arm_summary", "arm_effects", "bool_readings", "pending_prompts",
]
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[f"{n.upper()}_SQL"] for n in NAMES}
