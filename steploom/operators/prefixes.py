"""Prefixes of runs: sampling, recent steps, repeated patterns, next actions, revisit counts, text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.functions import text as tx
from steploom.operators import sequence as seq
from steploom.operators.detectors import FEATURES_SQL, config_table, triggered
from steploom.operators.ranking import running_totals
from steploom.operators.sequence import KEYS, ONCE_SQL, PREPARED_SQL, norm_sql
from steploom.sources.tables import checkpointed, read_table

#: Quotas of the strata, of 100.
QUOTAS = {"productive_risk": 40, "uc": 40, "matched_control": 20}
#: Steps of a pattern, indexes of the recent steps, and the fields a pattern is sought in.
RECENT = 6
RECENT_INDEXES = 10
PATTERN_FIELDS = ["tool_name", "file_path", "error_signature", "normalized_action_text", "command_text"]


def stratified_sample(spark, folder: str) -> DataFrame:
    """A fixed number of prefixes per stratum, in the order of a hash of the id: the same on every run.

    Rows far behind the quota are dropped by the hash before they are ranked, so no stratum is sorted
    whole: the share kept is four times what the quota needs, and all rows of a small stratum.
    """
    p = read_table(spark, folder, "prefix_replan_sample", "released_prefix_id", "stratum").where("released_prefix_id IS NOT NULL").distinct()
    p = p.withColumn("h", F.conv(F.substring(F.md5("released_prefix_id"), 1, 8), 16, 10).cast("long"))
    p = checkpointed(p.where(F.col("stratum").isin(*QUOTAS)))
    n = {r.stratum: r.n for r in p.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for s, q in QUOTAS.items():
        share = min(1.0, (4 * q + 100) / max(1, n.get(s, 1)))
        keep = keep | ((F.col("stratum") == s) & (F.col("h") < int(share * 4294967296)))
    ranked = p.where(keep).withColumn("selected_order", F.row_number().over(Window.partitionBy("stratum").orderBy("h", "released_prefix_id")))
    quota = F.element_at(F.create_map(*[F.lit(x) for s, q in QUOTAS.items() for x in (s, q)]), F.col("stratum"))
    return ranked.where(F.col("selected_order") <= quota).select("stratum", "selected_order", "released_prefix_id")


STRATIFIED_SAMPLE_SQL = f"""
WITH p AS (SELECT DISTINCT released_prefix_id, stratum, ('0x' || substr(md5(released_prefix_id), 1, 8))::BIGINT AS h FROM prefix_replan_sample WHERE released_prefix_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, released_prefix_id) AS selected_order FROM p)
SELECT stratum, selected_order, released_prefix_id FROM r JOIN (VALUES {', '.join(f"('{s}', {q})" for s, q in QUOTAS.items())}) q(stratum, quota) USING (stratum) WHERE selected_order <= quota"""


def _first_triggers(spark, folder: str) -> DataFrame:
    """The first trigger of every configuration in every trajectory: cfg, position `at` and `trigger_step`."""
    t = triggered(spark, folder).select(*KEYS, "step_index", "position", F.explode("fired").alias("cfg"))
    return t.groupBy(*KEYS, "cfg").agg(F.min(F.struct("position", "step_index")).alias("f")).select(*KEYS, "cfg", F.col("f.position").alias("at"), F.col("f.step_index").alias("trigger_step"))


def _prefixes(spark, folder: str) -> DataFrame:
    """The places of first triggers once each, with the configurations that first fire there; at most a row per configuration."""
    return checkpointed(_first_triggers(spark, folder).groupBy(*KEYS, "at", "trigger_step").agg(F.sort_array(F.collect_list("cfg")).alias("cfgs")))


def _recent(prefixes: DataFrame, steps: DataFrame) -> DataFrame:
    """The steps within the last RECENT_INDEXES indexes up to each place, joined by the single index: no trajectory meets itself."""
    at = prefixes.select(*KEYS, "at", "trigger_step", F.explode(F.sequence(F.col("trigger_step") - RECENT_INDEXES + 1, F.col("trigger_step"))).alias("step_index"))
    return at.join(steps, [*KEYS, "step_index"])


def _per_config(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per configuration of `cfgs`, with its names."""
    names = config_table(df.sparkSession).select("cfg", "detector", "config")
    return df.withColumn("cfg", F.explode("cfgs")).join(F.broadcast(names), "cfg").select(*KEYS, "detector", "config", "trigger_step", *columns)


def _steps(spark, folder: str) -> DataFrame:
    return seq.steps_once(read_table(spark, folder, "enriched_steps", *[c for c in seq.COLUMNS if c != "row_number"]))


# Every configuration has its first trigger; what came before it is read by index.
_FIRST_CTE = FEATURES_SQL + """, ft AS (SELECT dataset, trajectory_id, detector, config, min(step_index) AS trigger_step FROM trig GROUP BY ALL)"""


def recent_steps(spark, folder: str) -> DataFrame:
    """The steps within the last ten indexes up to the first trigger of each configuration in each trajectory."""
    p = _prefixes(spark, folder)
    s = seq.keyed(_steps(spark, folder)).select(*KEYS, "step_index", "tool_key", "action_key")
    r = _recent(p, s).join(p.select(*KEYS, "trigger_step", "cfgs"), [*KEYS, "trigger_step"])
    return _per_config(r, ["step_index", "tool_key", "action_key"])


RECENT_STEPS_SQL = _FIRST_CTE + f""" SELECT s.dataset, s.trajectory_id, detector, config, trigger_step, step_index, tool_key, action_key FROM steps s
JOIN ft ON ft.dataset = s.dataset AND ft.trajectory_id = s.trajectory_id WHERE step_index > trigger_step - {RECENT_INDEXES} AND step_index <= trigger_step"""


def repeated_patterns(spark, folder: str) -> DataFrame:
    """Per first trigger and field: the most frequent value of the last six of the recent steps, if it occurs at least twice.

    Values are scrubbed; of equally frequent ones the greatest counts.
    """
    p = _prefixes(spark, folder)
    r = _recent(p, _steps(spark, folder).select(*KEYS, "step_index", *PATTERN_FIELDS))
    # A place has at most RECENT_INDEXES rows.
    r = r.withColumn("back", F.row_number().over(Window.partitionBy(*KEYS, "trigger_step").orderBy(F.desc("step_index")))).where(F.col("back") <= RECENT)
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in PATTERN_FIELDS]
    v = r.select(*KEYS, "trigger_step", F.explode(F.array(*cells)).alias("x")).select(*KEYS, "trigger_step", "x.field", tx.scrubbed(F.col("x.value")).alias("value"))
    n = v.where(F.col("value") != "").groupBy(*KEYS, "trigger_step", "field", "value").agg(F.count(F.lit(1)).alias("times"))
    best = n.groupBy(*KEYS, "trigger_step", "field").agg(F.max(F.struct("times", "value")).alias("b")).where("b.times >= 2")
    best = best.select(*KEYS, "trigger_step", "field", "b.value", "b.times")
    return _per_config(best.join(p.select(*KEYS, "trigger_step", "cfgs"), [*KEYS, "trigger_step"]), ["field", "value", "times"])


def next_actions(spark, folder: str) -> DataFrame:
    """The action at the very next index after the first trigger of each configuration; a lost step gives no row."""
    first = _prefixes(spark, folder).withColumn("step_index", F.col("trigger_step") + 1)
    s = seq.keyed(_steps(spark, folder)).select(*KEYS, "step_index", F.col("action_key").alias("next_action"))
    return _per_config(first.join(s, [*KEYS, "step_index"]), ["next_action"])


NEXT_ACTIONS_SQL = _FIRST_CTE + """ SELECT s.dataset, s.trajectory_id, detector, config, trigger_step, action_key AS next_action FROM steps s
JOIN ft ON ft.dataset = s.dataset AND ft.trajectory_id = s.trajectory_id AND s.step_index = ft.trigger_step + 1"""


def _targets() -> Column:
    """A step's files in the order they are named, or its action where it names none."""
    action = F.when(F.trim("action_key") != "", F.substring("action_key", 1, 120)).otherwise("<empty-action>")
    return F.when(F.size("files") > 0, F.col("files")).otherwise(F.array(action))


def repetition_counts(spark, folder: str) -> DataFrame:
    """Per trajectory: steps, targets among the five targets before, and steps whose tool was among those of the five steps before.

    Every target of a step counts, so the rate of files can exceed 1.
    """
    # Neither flags nor spans are needed, so only keys are made, and both totals run in one pass.
    s = seq.keyed(_steps(spark, folder)).select(*KEYS, "step_index", "tool_key", _targets().alias("targets")).withColumn("size", F.size("targets"))
    s = checkpointed(running_totals(s, KEYS, "step_index", {"position": None, "upto": "size"}).drop("step_index"))
    each = s.select(*KEYS, "size", "upto", F.posexplode("targets").alias("k", "target")).select(*KEYS, "target", (F.col("upto") - F.col("size") + F.col("k") + 1).alias("position"))
    before = seq.over_block().rowsBetween(-5, -1)
    seen = lambda c: (F.coalesce(F.array_contains(F.collect_list(c).over(before), F.col(c)), F.lit(False)) & (F.col(c) != "")).cast("int")
    again = lambda df, c: seq.with_halo(df).select(*KEYS, "own", seen(c).alias("again")).where("own").groupBy(*KEYS)
    files = again(each, "target").agg(F.sum("again").alias("repeated_files"))
    tools = again(s.select(*KEYS, "position", "tool_key"), "tool_key").agg(F.count(F.lit(1)).alias("steps"), F.sum("again").alias("repeated_tools"))
    rate = lambda c: (F.col(c) / F.col("steps"))
    return tools.join(files, KEYS).select(
        *KEYS, "steps", "repeated_files", "repeated_tools", rate("repeated_files").alias("repeated_file_rate"), rate("repeated_tools").alias("repeated_tool_rate")
    )


# All targets of all steps in a row, whatever step they belong to; an action of 120 characters stands for a step without files.
_TARGETS_SQL = """, tg AS (SELECT dataset, trajectory_id, step_index, position, tool_key, CASE WHEN len(files) > 0 THEN files
  ELSE [CASE WHEN trim(action_key) <> '' THEN substr(action_key, 1, 120) ELSE '<empty-action>' END] END AS l FROM steps),
fl AS (SELECT dataset, trajectory_id, step_index, position, unnest(l) AS target, generate_subscripts(l, 1) AS k FROM tg)"""
REPETITION_COUNTS_SQL = PREPARED_SQL + _TARGETS_SQL + """,
bf AS (SELECT dataset, trajectory_id, target, list(target) OVER (PARTITION BY dataset, trajectory_id ORDER BY position, k ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before FROM fl),
fi AS (SELECT dataset, trajectory_id, count(*) FILTER (coalesce(list_contains(before, target), false)) AS repeated_files FROM bf GROUP BY 1, 2),
bt AS (SELECT dataset, trajectory_id, tool_key, list(tool_key) OVER (PARTITION BY dataset, trajectory_id ORDER BY position ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before FROM tg),
ti AS (SELECT dataset, trajectory_id, count(*) AS steps, count(*) FILTER (tool_key <> '' AND coalesce(list_contains(before, tool_key), false)) AS repeated_tools FROM bt GROUP BY 1, 2)
SELECT dataset, trajectory_id, steps, repeated_files, repeated_tools, repeated_files / steps AS repeated_file_rate, repeated_tools / steps AS repeated_tool_rate
FROM ti JOIN fi USING (dataset, trajectory_id)"""


def text_forms(spark, folder: str) -> DataFrame:
    """Error signature, step type, command and hashed observation of every step."""
    cols = ["error_text", "output_text", "observation_text", "normalized_action_text", "tool_name", "command_text"]
    s = seq.steps_once(read_table(spark, folder, "enriched_steps", "dataset", "trajectory_id", "step_index", *cols))
    return s.select(
        *KEYS, "step_index", tx.error_signature(F.col("error_text"), F.col("output_text"), F.col("observation_text")).alias("signature"),
        tx.step_type(F.col("normalized_action_text"), F.col("tool_name")).alias("kind"),
        tx.command_text(F.col("normalized_action_text"), F.col("tool_name"), F.col("command_text")).alias("command"), tx.short_hash(tx.normal(F.col("observation_text"))).alias("observation_hash"),
    )


_E = "coalesce(nullif(trim(error_text), ''), nullif(trim(output_text), ''), nullif(trim(observation_text), ''), '')"
_HITS = ", ".join(f"nullif(regexp_extract({_E}, '{p}', 0), '')" for p in tx.ERROR_LINES)
_FALL = rf"CASE WHEN regexp_matches({_E}, '{tx.ERROR_WORDS}') THEN substr(trim(regexp_replace({_E}, '\s+', ' ', 'g')), 1, 240) END"
_KIND = r"lower(regexp_split_to_array(coalesce(nullif(trim(tool_name), ''), nullif(trim(normalized_action_text), '')), '\s+')[1])"
_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.STEP_TYPES.items())
TEXT_FORMS_SQL = f"""WITH {ONCE_SQL}, x AS (SELECT *, coalesce({_HITS}, {_FALL}) AS sig, {_KIND} AS k0 FROM s0)
SELECT dataset, trajectory_id, step_index, substr({norm_sql('sig')}, 1, 240) AS signature, coalesce(CASE k0 {_TYPES} END, k0, '') AS kind,
  CASE WHEN {norm_sql('tool_name')} IN ({', '.join(f"'{x}'" for x in tx.SHELL_TOOLS)}) THEN coalesce(nullif(trim(command_text), ''), nullif(trim(normalized_action_text), ''), '')
    WHEN regexp_matches({norm_sql('normalized_action_text')}, '^({'|'.join(tx.COMMAND_STARTS)}) ') THEN normalized_action_text ELSE '' END AS command,
  CASE WHEN {norm_sql('observation_text')} <> '' THEN substr(sha1({norm_sql('observation_text')}), 1, 16) ELSE '' END AS observation_hash FROM x"""


def file_mentions(spark, folder: str) -> DataFrame:
    """Files named in commands, with the steps and trajectories that name them."""
    s = seq.steps_once(read_table(spark, folder, "enriched_steps", "dataset", "trajectory_id", "step_index", "normalized_action_text"))
    e = s.select(*KEYS, F.explode(tx.file_names(F.col("normalized_action_text"))).alias("file"))
    by = e.groupBy("file", *KEYS).agg(F.count(F.lit(1)).alias("n"))  # counted before the file alone is the key
    return by.groupBy("file").agg(F.sum("n").alias("steps"), F.count(F.lit(1)).alias("trajectories"))


_NAME_SQL, _EDGES_SQL = tx.FILE_NAME.replace("'", "''"), tx.FILE_EDGES.replace("'", "''")
FILE_MENTIONS_SQL = f"""WITH {ONCE_SQL}, e AS (SELECT dataset, trajectory_id, unnest(list_distinct(list_filter(list_transform(
  regexp_extract_all(coalesce(normalized_action_text, ''), '{_NAME_SQL}', 0), lambda x: trim(x, '{_EDGES_SQL}')), lambda x: x <> ''))) AS file FROM s0)
SELECT file, count(*) AS steps, count(DISTINCT (dataset, trajectory_id)) AS trajectories FROM e GROUP BY 1"""


def scrubbed_prefixes(spark, folder: str) -> DataFrame:
    """The whole summaries of prefixes without tokens, quoted secrets, e-mails, URLs, paths and trajectory ids."""
    p = read_table(spark, folder, "prefix_replan_sample", "released_prefix_id", "recent_actions_summary", "recent_observations_summary")
    return p.select("released_prefix_id", tx.scrubbed(F.col("recent_actions_summary")).alias("actions"), tx.scrubbed(F.col("recent_observations_summary")).alias("observations")).distinct()


# RE2 has no look-around: the one character before a path, and the one behind a bare folder, is matched and put back.
_FOR_RE2 = {
    r"(?<!:)/[A-Za-z0-9_.-]+/([A-Za-z0-9_./-]+)": (r"(^|[^:])/[A-Za-z0-9_.-]+/([A-Za-z0-9_./-]+)", "\\1<PROJECT_PATH>/\\2"),
    r"(?<!:)/[A-Za-z0-9_.-]+(?=[\s),;]|$)": (r"(^|[^:])/[A-Za-z0-9_.-]+([\s),;]|$)", "\\1<PROJECT_PATH>\\2"),
}


def _scrub_sql(x: str) -> str:
    t = f"coalesce({x}, '')"
    for pattern, sign in (*tx.SCRUB[:-1], *tx.SCRUB_PATHS, tx.SCRUB[-1]):
        times = 2 if "(?=" in pattern else 1  # two bare folders that share a blank
        pattern, sign = _FOR_RE2.get(pattern, (pattern, sign))
        for _ in range(times):
            t = "regexp_replace({}, '{}', '{}', 'g')".format(t, pattern.replace("'", "''"), sign.replace("'", "''"))
    return f"trim({t})"


SCRUBBED_PREFIXES_SQL = f"SELECT DISTINCT released_prefix_id, {_scrub_sql('recent_actions_summary')} AS actions, {_scrub_sql('recent_observations_summary')} AS observations FROM prefix_replan_sample"


def guard_events(spark, folder: str) -> DataFrame:
    """Batch twin of the streaming guard: the event of each step that has one, with its target.

    All targets of a step are taken in, the last five of the run stay, and of the step's targets from the
    last to the first the one counts that fills three of the five.
    """
    s = seq.prepared(spark, folder).where("dataset IS NOT NULL").select(*KEYS, "step_index", "position", _targets().alias("targets")).withColumn("size", F.size("targets"))
    # The last five targets of the run end with this step's own.
    mine = s.withColumn("tail", F.when(F.col("size") >= 5, F.slice("targets", -5, 5)).otherwise(F.col("targets")))
    h = seq.with_halo(mine)
    before = F.flatten(F.collect_list("tail").over(seq.over_block().rowsBetween(-4, 0)))  # every step has a target, so five steps are enough
    last = F.slice(before, -F.least(F.size(before), F.lit(5)), 5)
    hit = lambda c: F.filter(F.reverse("targets"), lambda t: F.size(F.filter(c, lambda x: x == t)) >= 3)
    out = h.withColumn("last", last).where("own")
    out = out.withColumn("target", F.get(hit(F.col("last")), F.lit(0))).where("target IS NOT NULL")
    return out.select(*KEYS, "step_index", "target", F.size(F.filter("last", lambda x: x == F.col("target"))).alias("times"))


# For each step the last five targets up to its last one; then its own targets, the last first.
GUARD_EVENTS_SQL = PREPARED_SQL + _TARGETS_SQL + """,
w AS (SELECT *, list(target) OVER (PARTITION BY dataset, trajectory_id ORDER BY position, k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last,
  row_number() OVER (PARTITION BY dataset, trajectory_id, position ORDER BY k DESC) AS back FROM fl),
e AS (SELECT dataset, trajectory_id, position, last FROM w WHERE back = 1),
c AS (SELECT w.dataset, w.trajectory_id, w.step_index, w.target, w.back, len(list_filter(e.last, lambda x: x = w.target)) AS times
  FROM w JOIN e ON e.dataset = w.dataset AND e.trajectory_id = w.trajectory_id AND e.position = w.position)
SELECT dataset, trajectory_id, step_index, target, times::INTEGER AS times FROM c WHERE times >= 3
QUALIFY row_number() OVER (PARTITION BY dataset, trajectory_id, step_index ORDER BY back) = 1"""

_VALUES_SQL = " UNION ALL ".join(
    f"SELECT dataset, trajectory_id, detector, config, trigger_step, '{c}' AS field, {_scrub_sql(c)} AS value FROM six" for c in PATTERN_FIELDS
)
REPEATED_PATTERNS_SQL = _FIRST_CTE + f""", six AS (SELECT s.*, detector, config, trigger_step FROM steps s JOIN ft ON ft.dataset = s.dataset AND ft.trajectory_id = s.trajectory_id
  WHERE step_index > trigger_step - {RECENT_INDEXES} AND step_index <= trigger_step
  QUALIFY row_number() OVER (PARTITION BY s.dataset, s.trajectory_id, detector, config ORDER BY step_index DESC) <= {RECENT}),
vl AS ({_VALUES_SQL}), n AS (SELECT *, count(*) AS times FROM vl WHERE value <> '' GROUP BY ALL HAVING count(*) >= 2)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY dataset, trajectory_id, detector, config, field ORDER BY times DESC, value DESC) = 1"""

NAMES = [
    "stratified_sample", "recent_steps", "repeated_patterns", "next_actions", "repetition_counts", "text_forms", "file_mentions", "scrubbed_prefixes", "guard_events",
]
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[f"{n.upper()}_SQL"] for n in NAMES}
