"""Samples of triggers, report tables and quality gates of a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.functions.parse import recovered_json
from steploom.operators import sequence as seq
from steploom.operators.audit import TRAJECTORY_FLAGS_CTE, one, trajectory_flags
from steploom.operators.detectors import METRICS_CTE, TRIGGER_LOCATION_SQL, config_table, metrics, trigger_location
from steploom.operators.risk import TRIGGER_TABLE_SQL, trigger_table
from steploom.operators.sequence import KEYS, ONCE_SQL, SPANS_SQL
from steploom.sources.tables import broadcast_if_small, checkpointed, read_table

# Configurations in the order they are preferred; pools in the order they are shown; sizes of samples and lists.
PREFERRED = [
    ("file_revisit_guard", "window=5;repeats=3"), ("file_revisit_guard", "window=10;repeats=3"), ("max_step_guard", "threshold=50"),
    ("tool_repeat_k", "k=3"), ("tool_repeat", "k=3"), ("repeat_without_progress_guard", None),
]
POOLS = ["Natural500", "Final500", "StressFresh100", "OpenHandsExternal330"]
SAMPLE, PER_TRAJECTORY, TOP = 60, 2, 4
PRIVACY = {
    "local_drive": r"(?i)(^|[^A-Za-z0-9])D:[\\/][^\s,;]*", "local_wsl": r"(?i)\\\\wsl\.localhost[^\s,;]*", "local_home": r"/home/[A-Za-z0-9_.-]+[^\s,;]*",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "token_sk": r"sk-[A-Za-z0-9_-]{20,}", "token_ghp": r"ghp_[A-Za-z0-9_]{20,}",
    "token_xox": r"xox[abprs]-[A-Za-z0-9-]{20,}", "token_aiza": r"AIza[0-9A-Za-z_-]{20,}", "token_bearer": r"(?i)Bearer\s+[A-Za-z0-9._-]{30,}",
}
SCANNED = ["command_text", "observation_text", "thought_text"]


def pool_rank(c: Column) -> Column:
    """The place of a pool in reports; unknown pools come last."""
    out = F.lit(999)
    for n, pool in reversed(list(enumerate(POOLS))):
        out = F.when(c == pool, n).otherwise(out)
    return out


_RANK_SQL = "CASE dataset " + " ".join(f"WHEN '{p}' THEN {n}" for n, p in enumerate(POOLS)) + " ELSE 999 END"


def _drawn(*columns: str) -> Column:
    """A number from the hash of some columns: an order without order, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 12), 16, 10).cast("long")


def _candidates(spark, folder: str) -> DataFrame:
    t = trigger_table(spark, folder).where("is_first").select(*KEYS, "step_index", "detector", "config", "location", "remaining_productive", "remaining_uc")
    return t.withColumn("drawn", _drawn("trajectory_id", "step_index", "detector", "config"))


def priority_sample(spark, folder: str, size: int = SAMPLE) -> DataFrame:
    """`size` first triggers: by preference, then drawn, one of each trajectory first, then any others in the same order."""
    c = _candidates(spark, folder)
    rank = F.lit(len(PREFERRED) + 10)
    for n, (detector, config) in reversed(list(enumerate(PREFERRED))):
        rank = F.when((F.col("detector") == detector) & (F.lit(True) if config is None else F.col("config") == config), n).otherwise(rank)
    order = ["priority", "drawn", "dataset", "trajectory_id", "detector", "config"]
    c = checkpointed(c.withColumn("priority", rank).select(*order, "step_index"))
    names = [x for x in order if x not in ("dataset", "trajectory_id")]
    best = c.groupBy(*KEYS).agg(F.min(F.struct(*names, "step_index")).alias("b")).select(*KEYS, "b.*", F.lit(0).alias("turn"))
    rest = c.join(best.select(*order), order, "left_anti").withColumn("turn", F.lit(1))
    # The sample is the feature: a top list over both turns.
    return best.unionByName(rest).orderBy("turn", *order).limit(size).select(*KEYS, "detector", "config", "step_index", "priority", "turn")


def capped_sample(spark, folder: str, size: int = SAMPLE) -> DataFrame:
    """Drawn first triggers of two strata, half the size each, at most PER_TRAJECTORY of a trajectory over both."""
    c = checkpointed(_candidates(spark, folder))
    order = ["drawn", "dataset", "detector", "config"]
    strata = {
        "productive_risk": F.col("location").isin("PI", "HN") & (F.col("remaining_productive") > 0),
        "uc": (F.col("location") == "UC") & (F.col("remaining_uc") > 0),
    }
    out: DataFrame | None = None
    for name, condition in strata.items():
        # Only the first few of a trajectory can be taken; they are cut before the shuffle.
        mine = c.where(condition).withColumn("n", F.row_number().over(Window.partitionBy("trajectory_id").orderBy(*order))).where(F.col("n") <= PER_TRAJECTORY)
        if out is not None:
            taken = out.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("taken"))  # of a sample of `size` rows
            mine = mine.join(F.broadcast(taken), "trajectory_id", "left").where(F.col("n") <= PER_TRAJECTORY - F.coalesce("taken", F.lit(0)))
        part = mine.orderBy(*order, "trajectory_id").limit(size // 2).select(F.lit(name).alias("stratum"), *KEYS, "detector", "config", "step_index")
        out = checkpointed(part if out is None else out.unionByName(part))
    return out


def overlap_categories(spark, folder: str) -> DataFrame:
    """Per pool six combinations of PI, HN and UC: trajectories, share, and both in one cell for a report; pools with their place."""
    f = trajectory_flags(spark, folder)
    has = {k: (F.col(f"{k}_spans") > 0) | (F.col(f"{k}_steps") > 0) for k in ("pi", "hn", "uc")}
    kinds = {
        "HN_and_UC": has["hn"] & has["uc"], "HN_only": has["hn"] & ~has["uc"], "UC_only": ~has["hn"] & has["uc"],
        "neither_HN_nor_UC": ~has["hn"] & ~has["uc"], "PI_and_UC": has["pi"] & has["uc"], "PI_and_HN": has["pi"] & has["hn"],
    }
    g = f.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), *[one(c).alias(k) for k, c in kinds.items()])
    x = g.select("dataset", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("trajectories")) for k in kinds])).alias("x"))
    share = F.round(F.col("x.trajectories") / F.col("n"), 3)
    return x.select("dataset", pool_rank(F.col("dataset")).alias("pool_rank"), "x.*", share.alias("share"), count_and_rate(F.col("x.trajectories"), share).alias("cell"))


def count_and_rate(count: Column, rate: Column) -> Column:
    """'12 (0.345)', or NA where one is missing."""
    return F.when(count.isNotNull() & rate.isNotNull(), F.format_string("%d (%.3f)", count, rate)).otherwise("NA")


def count_of(cell: Column) -> Column:
    """The count of a 'count (rate)' cell."""
    return F.regexp_extract(cell, r"^\s*(-?\d+)\s*\(", 1).try_cast("long")


def rate_of(cell: Column) -> Column:
    return F.regexp_extract(cell, r"\(\s*(-?[\d.]+)\s*\)", 1).try_cast("double")


_HAS = {k: f"({k}_spans > 0 OR {k}_steps > 0)" for k in ("pi", "hn", "uc")}
_KINDS_SQL = {
    "HN_and_UC": "{hn} AND {uc}", "HN_only": "{hn} AND NOT {uc}", "UC_only": "NOT {hn} AND {uc}", "neither_HN_nor_UC": "NOT {hn} AND NOT {uc}",
    "PI_and_UC": "{pi} AND {uc}", "PI_and_HN": "{pi} AND {hn}",
}
OVERLAP_CATEGORIES_SQL = TRAJECTORY_FLAGS_CTE + ", x AS (" + " UNION ALL ".join(
    f"SELECT dataset, '{k}' AS category, count(*) FILTER ({c.format(**_HAS)}) AS trajectories, round(count(*) FILTER ({c.format(**_HAS)}) / count(*), 3) AS share FROM fl GROUP BY 1"
    for k, c in _KINDS_SQL.items()
) + f") SELECT dataset, {_RANK_SQL} AS pool_rank, category, trajectories, share, printf('%d (%.3f)', trajectories, share) AS cell FROM x"


def location_pivot(spark, folder: str) -> DataFrame:
    """Shares of triggers by place, a column for each place."""
    places = ["UC_span", "HN_step", "PI_span_non_HN", "other"]
    return trigger_location(spark, folder).groupBy("dataset", "detector", "config").pivot("location_category", places).agg(F.first("trigger_pct"))


LOCATION_PIVOT_SQL = f"""SELECT dataset, detector, config, {', '.join(f"max(trigger_pct) FILTER (location_category = '{p}') AS {p}" for p in ("UC_span", "HN_step", "PI_span_non_HN", "other"))}
FROM ({TRIGGER_LOCATION_SQL}) GROUP BY 1, 2, 3"""


def top_detectors(spark, folder: str) -> DataFrame:
    """The configurations with the highest F1 of each pool; of equal ones the first listed. A pool has as many rows as configurations."""
    order = config_table(spark).select("cfg", "detector", "config")
    m = metrics(spark, folder).join(F.broadcast(order), ["detector", "config"]).where("f1 IS NOT NULL")
    ranked = m.withColumn("rank", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("f1"), "cfg")))
    return ranked.where(F.col("rank") <= TOP).select("dataset", "rank", "detector", "config", "f1", "piir", "hn_fpr", "burden")


TOP_DETECTORS_SQL = METRICS_CTE + f""" SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, cfg) AS rank, detector, config, f1, piir, hn_fpr, burden
FROM met WHERE f1 IS NOT NULL QUALIFY rank <= {TOP}"""


def release_projection(spark, folder: str) -> DataFrame:
    """The steps of a release: flags and labels of the spans laid over those of the steps; UC overrides PI."""
    flags = ["hard_negative", "productive_iteration_flag", "unproductive_cycle_flag"]
    s = seq.steps_once(read_table(spark, folder, "enriched_steps", "dataset", "trajectory_id", "step_index", "span_label_norm", *flags))
    label = F.col("label")
    uc = (label == "unproductive_cycle") | F.col("unproductive_cycle_flag")
    pi = (label == "productive_iteration") | F.col("productive_iteration_flag")
    spans = seq.ordered_spans(read_table(spark, folder, "normalized_spans")).select(
        *KEYS, "start", "end", uc.alias("s_uc"), (pi & ~uc).alias("s_pi"), F.col("hard_negative").alias("s_hn")
    )
    held = s.join(seq.coverage(s, spans, ["s_uc", "s_pi", "s_hn"]), [*KEYS, "step_index"])
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = F.coalesce(seq.span_label(F.col("span_label_norm")), F.lit(""))
    return held.select(
        *KEYS, "step_index", (on("unproductive_cycle_flag") | F.col("s_uc")).alias("uc"), (on("productive_iteration_flag") | F.col("s_pi")).alias("pi"),
        (on("hard_negative") | F.col("s_hn")).alias("hn"), F.when(F.col("s_uc"), "unproductive_cycle").when(F.col("s_pi"), "productive_iteration").otherwise(own).alias("step_span_label"),
    )


RELEASE_PROJECTION_SQL = f"""WITH {ONCE_SQL}, {SPANS_SQL},
h AS (SELECT s.dataset, s.trajectory_id, s.step_index, bool_or(p.label = 'unproductive_cycle' OR p.uc) AS s_uc,
  bool_or((p.label = 'productive_iteration' OR p.pi) AND NOT (p.label = 'unproductive_cycle' OR p.uc)) AS s_pi, bool_or(p.hn) AS s_hn
  FROM s0 s JOIN sp p ON s.dataset = p.dataset AND s.trajectory_id = p.trajectory_id AND s.step_index BETWEEN p.a AND p.b GROUP BY 1, 2, 3)
SELECT s0.dataset, s0.trajectory_id, s0.step_index, coalesce(unproductive_cycle_flag, false) OR coalesce(s_uc, false) AS uc,
  coalesce(productive_iteration_flag, false) OR coalesce(s_pi, false) AS pi, coalesce(hard_negative, false) OR coalesce(s_hn, false) AS hn,
  CASE WHEN s_uc THEN 'unproductive_cycle' WHEN s_pi THEN 'productive_iteration' ELSE {seq.label_sql('span_label_norm')} END AS step_span_label
FROM s0 LEFT JOIN h USING (dataset, trajectory_id, step_index)"""


def quality_gates(spark, folder: str) -> DataFrame:
    """Per pool and rule what breaks it: step keys on several rows, trajectories that do not start at 0 or lack an index, spans that
    are swapped, reach beyond the last step, stand in a trajectory without steps, or count their steps wrongly."""
    raw = read_table(spark, folder, "enriched_steps", "dataset", "trajectory_id", "step_index").where("trajectory_id IS NOT NULL AND step_index IS NOT NULL")
    raw = raw.withColumn("dataset", F.coalesce("dataset", F.lit("")))
    keys = raw.groupBy(*KEYS, "step_index").agg(F.count(F.lit(1)).alias("n"))
    per = checkpointed(keys.groupBy(*KEYS).agg(F.min("step_index").alias("lo"), F.max("step_index").alias("hi"), F.count(F.lit(1)).alias("steps"), one(F.col("n") > 1).alias("repeated")))
    rules = {"duplicate_step_keys": F.sum("repeated"), "not_from_0": one(F.col("lo") != 0), "missing_indexes": one(F.col("hi") - F.col("lo") + 1 != F.col("steps"))}
    spans = read_table(spark, folder, "normalized_spans").withColumn("dataset", F.coalesce("dataset", F.lit(""))).drop("row_number", "ingested_at").distinct()
    spans = spans.join(per.select(*KEYS, "hi"), KEYS, "left")
    a, b = F.col("start_step_index"), F.col("end_step_index")
    span_rules = {
        "swapped_bounds": one(a > b), "beyond_last_step": one(F.greatest(a, b) > F.col("hi")), "without_steps": one(F.col("hi").isNull()),
        "wrong_step_count": one(F.col("step_count") != F.abs(b - a) + 1),
    }

    def long(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
        wide = df.groupBy("dataset").agg(*[c.alias(k) for k, c in rules.items()])
        cells = F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).cast("long").alias("violations")) for k in rules])
        return wide.select("dataset", F.explode(cells).alias("x")).select("dataset", "x.gate", "x.violations", (F.col("x.violations") == 0).alias("passed"))

    return long(per, rules).unionByName(long(spans, span_rules))


QUALITY_GATES_SQL = """
WITH k AS (SELECT coalesce(dataset, '') AS dataset, trajectory_id, step_index, count(*) AS n FROM enriched_steps WHERE trajectory_id IS NOT NULL AND step_index IS NOT NULL GROUP BY 1, 2, 3),
per AS (SELECT dataset, trajectory_id, min(step_index) AS lo, max(step_index) AS hi, count(*) AS steps, count(*) FILTER (n > 1) AS repeated FROM k GROUP BY 1, 2),
s AS (SELECT DISTINCT * EXCLUDE (row_number, ingested_at) REPLACE (coalesce(dataset, '') AS dataset) FROM normalized_spans),
j AS (SELECT s.*, hi FROM s LEFT JOIN per ON per.dataset = s.dataset AND per.trajectory_id = s.trajectory_id),
g AS (
  SELECT dataset, 'duplicate_step_keys' AS gate, sum(repeated)::BIGINT AS violations FROM per GROUP BY 1 UNION ALL
  SELECT dataset, 'not_from_0', count(*) FILTER (lo <> 0) FROM per GROUP BY 1 UNION ALL
  SELECT dataset, 'missing_indexes', count(*) FILTER (hi - lo + 1 <> steps) FROM per GROUP BY 1 UNION ALL
  SELECT dataset, 'swapped_bounds', count(*) FILTER (start_step_index > end_step_index) FROM j GROUP BY 1 UNION ALL
  SELECT dataset, 'beyond_last_step', count(*) FILTER (greatest(start_step_index, end_step_index) > hi) FROM j GROUP BY 1 UNION ALL
  SELECT dataset, 'without_steps', count(*) FILTER (hi IS NULL) FROM j GROUP BY 1 UNION ALL
  SELECT dataset, 'wrong_step_count', count(*) FILTER (step_count <> abs(end_step_index - start_step_index) + 1) FROM j GROUP BY 1)
SELECT *, violations = 0 AS passed FROM g"""


def privacy_scan(spark, folder: str) -> DataFrame:
    """Lines of the texts that match a pattern no release may hold, per field and pattern, and the rows they stand in."""
    s = read_table(spark, folder, "enriched_steps", "row_number", *SCANNED)
    texts = s.select("row_number", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in SCANNED])).alias("x")).select("row_number", "x.*")
    lines = texts.where("text IS NOT NULL").select("field", F.split("text", "\n").alias("l"))

    def matching(pattern: str):
        return lambda line: F.regexp_like(line, F.lit(pattern))

    hits = lines.select("field", *[F.size(F.filter("l", matching(p))).alias(k) for k, p in PRIVACY.items()])
    wide = hits.groupBy("field").agg(*[a for k in PRIVACY for a in (F.sum(k).alias(f"{k}_lines"), one(F.col(k) > 0).alias(f"{k}_rows"))])
    cells = F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(f"{k}_lines").alias("lines"), F.col(f"{k}_rows").alias("rows")) for k in PRIVACY])
    return wide.select("field", F.explode(cells).alias("x")).select("field", "x.*")


PRIVACY_SCAN_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS field, '{k}' AS pattern, coalesce(sum(len(h)), 0)::BIGINT AS lines, count(*) FILTER (len(h) > 0) AS rows
    FROM (SELECT list_filter(string_split({c}, chr(10)), lambda x: regexp_matches(x, '{p}')) AS h FROM enriched_steps WHERE {c} IS NOT NULL)"""
    for c in SCANNED
    for k, p in PRIVACY.items()
)


def json_recovery(spark, folder: str) -> DataFrame:
    """How a JSON object is got out of each field: the whole text, a fenced block, the text from the first to the last brace, or not."""
    fields = ["signal_fields", "evidence_fields", "observation_text"]
    s = read_table(spark, folder, "enriched_steps", *fields)
    texts = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in fields])).alias("x")).select("x.*")
    return texts.where("text IS NOT NULL").groupBy("field", recovered_json(F.col("text"))["way"].alias("way")).agg(F.count(F.lit(1)).alias("rows"))


def _json_sql(x: str) -> str:
    return f"CASE WHEN json_valid({x}) THEN json_type({x}) = 'OBJECT' ELSE false END"


JSON_RECOVERY_SQL = "WITH x AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS field, trim({c}) AS t, regexp_extract({c}, '(?is)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1) AS f,
    CASE WHEN strpos({c}, '{{') > 0 THEN regexp_extract({c}, '(?s)\\{{.*\\}}', 0) ELSE '' END AS b FROM enriched_steps WHERE {c} IS NOT NULL"""
    for c in ("signal_fields", "evidence_fields", "observation_text")
) + f") SELECT field, CASE WHEN {_json_sql('t')} THEN 'whole' WHEN {_json_sql('f')} THEN 'fenced' WHEN {_json_sql('b')} THEN 'braces' ELSE 'none' END AS way, count(*) AS rows FROM x GROUP BY 1, 2"

_DRAWN_SQL = "('0x' || substr(md5(trajectory_id || '|' || step_index::VARCHAR || '|' || detector || '|' || config), 1, 12))::BIGINT"
_CANDIDATES_SQL = f"SELECT *, {_DRAWN_SQL} AS drawn FROM ({TRIGGER_TABLE_SQL}) WHERE is_first"
_PRIORITY_SQL = "CASE " + " ".join(
    f"WHEN detector = '{d}'" + ("" if c is None else f" AND config = '{c}'") + f" THEN {n}" for n, (d, c) in enumerate(PREFERRED)
) + f" ELSE {len(PREFERRED) + 10} END"
PRIORITY_SAMPLE_SQL = f"""WITH c AS (SELECT *, {_PRIORITY_SQL} AS priority FROM ({_CANDIDATES_SQL})),
o AS (SELECT *, (row_number() OVER (PARTITION BY dataset, trajectory_id ORDER BY priority, drawn, detector, config) > 1)::INTEGER AS turn FROM c)
SELECT dataset, trajectory_id, detector, config, step_index, priority, turn FROM o ORDER BY turn, priority, drawn, dataset, trajectory_id, detector, config LIMIT {SAMPLE}"""
CAPPED_SAMPLE_SQL = f"""WITH c AS MATERIALIZED ({_CANDIDATES_SQL}),
a AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY drawn, dataset, detector, config) AS n FROM c
  WHERE location IN ('PI', 'HN') AND remaining_productive > 0) WHERE n <= {PER_TRAJECTORY} ORDER BY drawn, dataset, detector, config, trajectory_id LIMIT {SAMPLE // 2}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY drawn, dataset, detector, config) AS n FROM c WHERE location = 'UC' AND remaining_uc > 0) z
  WHERE n <= {PER_TRAJECTORY} - (SELECT count(*) FROM a WHERE a.trajectory_id = z.trajectory_id) ORDER BY drawn, dataset, detector, config, trajectory_id LIMIT {SAMPLE // 2})
SELECT 'productive_risk' AS stratum, dataset, trajectory_id, detector, config, step_index FROM a UNION ALL SELECT 'uc', dataset, trajectory_id, detector, config, step_index FROM b"""


def within_tolerance(found: DataFrame, expected: dict[str, float], tolerance: float = 0.0015) -> DataFrame:
    """(name, value) rows against expected numbers: expected, difference, passed; a name that is missing fails."""
    want = found.sparkSession.createDataFrame(list(expected.items()), "name string, expected double")
    out = want.join(broadcast_if_small(found.select("name", F.col("value").cast("double").alias("value"))), "name", "left")
    gap = F.abs(F.col("value") - F.col("expected"))
    return out.withColumn("difference", gap).withColumn("passed", F.coalesce(gap <= tolerance, F.lit(False)))


def exactly_one(df: DataFrame, condition: Column):
    """The only row that meets a condition; an error if there is none or another."""
    rows = df.where(condition).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no' if not rows else 'more than one'} row meets the condition")
    return rows[0]


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join that fails if a key stands on several rows of either side."""
    for df in (left, right):
        if df.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"{keys} are not unique")
    return left.join(right, keys, how)


NAMES = [
    "priority_sample", "capped_sample", "overlap_categories", "location_pivot", "top_detectors", "release_projection", "quality_gates", "privacy_scan", "json_recovery",
]
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[f"{n.upper()}_SQL"] for n in NAMES}
