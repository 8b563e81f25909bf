"""Ordered step sequences: deduplicated, positioned, keyed and flagged, without one task per trajectory.

Windows run over (trajectory, block of positions). Every block also holds copies of the last HALO rows
of the block before, so a look-back of up to HALO rows is whole; longer look-backs take the last value
of the blocks before from a table with one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.functions.parse import bool_known, file_list, first_filled, json_score, span_label
from steploom.functions.text import normal, short_hash
from steploom.operators.ranking import running_total, running_totals
from steploom.sources.tables import read_table

#: Rows of a block, and the longest look-back in rows.
ROWS = 2048
HALO = 16
KEYS = ["dataset", "trajectory_id"]
COLUMNS = [
    "dataset", "dataset_role", "row_number", "trajectory_id", "step_index", "label_norm", "span_label_norm", "hard_negative",
    "productive_iteration_flag", "unproductive_cycle_flag", "uncertain_flag", "unresolved_flag", "raw_action_text",
    "normalized_action_text", "tool_name", "command_text", "observation_text", "output_text", "error_text",
    "error_signature", "file_path", "mentioned_files", "step_type", "signal_fields",
]


def steps_once(steps: DataFrame) -> DataFrame:
    """Each step once: rows without trajectory or step_index are left out, re-sent rows count once.

    Re-sent rows differ in row_number and arrival time only, which are not kept.
    """
    return (
        steps.where(F.col("trajectory_id").isNotNull() & F.col("step_index").isNotNull())
        .withColumn("dataset", F.coalesce("dataset", F.lit("")))
        .drop("row_number", "ingested_at")
        .dropDuplicates([*KEYS, "step_index"])
    )


def positioned(steps: DataFrame) -> DataFrame:
    """Adds `position`, from 1, by step_index inside the trajectory."""
    return running_total(steps, KEYS, "step_index", None, "position")


def coverage(steps: DataFrame, spans: DataFrame, flags: list[str]) -> DataFrame:
    """(dataset, trajectory_id, step_index, flags): how many spans with each flag hold the step.

    `spans` has inclusive start/end and a boolean per flag. No range join: a span adds one at its
    start and takes one away behind its end, and a running total over the positions gives the count.
    """
    zero = [F.lit(0).cast("long").alias(f) for f in flags]
    marks = steps.select(*KEYS, F.col("step_index").cast("long").alias("pos"), F.lit(1).alias("is_step"), *zero)
    for at, sign in ((F.col("start"), 1), (F.col("end") + 1, -1)):
        marks = marks.unionByName(
            spans.select(*KEYS, at.cast("long").alias("pos"), F.lit(0).alias("is_step"), *[(F.col(f).cast("long") * sign).alias(f) for f in flags])
        )
    summed = marks.groupBy(*KEYS, "pos").agg(F.max("is_step").alias("is_step"), *[F.sum(f).alias(f) for f in flags])
    total = running_totals(summed, KEYS, "pos", {f"n_{f}": f for f in flags})
    return total.where("is_step = 1").select(*KEYS, F.col("pos").cast("int").alias("step_index"), *[(F.col(f"n_{f}") > 0).alias(f) for f in flags])


def ordered_spans(spans: DataFrame) -> DataFrame:
    """Spans with known bounds in order, once each, with their normalised label and flags."""
    return spans.where(
        F.col("trajectory_id").isNotNull() & F.col("start_step_index").isNotNull() & F.col("end_step_index").isNotNull()
    ).select(
        F.coalesce("dataset", F.lit("")).alias("dataset"),
        "trajectory_id",
        "span_id",
        F.least("start_step_index", "end_step_index").alias("start"),
        F.greatest("start_step_index", "end_step_index").alias("end"),
        F.coalesce(span_label(F.col("span_label_norm")), F.lit("")).alias("label"),
        *[bool_known(F.col(c)).alias(c) for c in ("hard_negative", "productive_iteration_flag", "unproductive_cycle_flag", "uncertain_flag")],
    ).distinct()


def flagged(steps: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds in_pi, in_uc, in_hn, in_uncertain: the step's own flags or those of a span that holds it."""
    label = F.col("label")
    marked = ordered_spans(spans).select(
        *KEYS, "start", "end",
        ((label == "productive_iteration") | F.col("productive_iteration_flag")).alias("s_pi"),
        ((label == "unproductive_cycle") | F.col("unproductive_cycle_flag")).alias("s_uc"),
        F.col("hard_negative").alias("s_hn"),
        (label.isin("uncertain", "unresolved") | F.col("uncertain_flag")).alias("s_un"),
    )
    held = coverage(steps, marked, ["s_pi", "s_uc", "s_hn", "s_un"])
    own = F.coalesce(span_label(F.col("span_label_norm")), F.lit(""))
    return (
        steps.join(held, [*KEYS, "step_index"])
        .withColumn("in_pi", (own == "productive_iteration") | bool_known(F.col("productive_iteration_flag")) | F.col("s_pi"))
        .withColumn("in_uc", (own == "unproductive_cycle") | bool_known(F.col("unproductive_cycle_flag")) | F.col("s_uc"))
        .withColumn("in_hn", bool_known(F.col("hard_negative")) | F.col("s_hn"))
        .withColumn(
            "in_uncertain",
            own.isin("uncertain", "unresolved") | bool_known(F.col("uncertain_flag")) | bool_known(F.col("unresolved_flag")) | F.col("s_un"),
        )
        .drop("s_pi", "s_uc", "s_hn", "s_un")
    )


def keyed(steps: DataFrame) -> DataFrame:
    """Adds the keys the detectors compare; '' where there is nothing to compare."""
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    obs = F.coalesce(filled("observation_text"), F.col("output_text"), F.lit(""))
    text = lambda c: F.nullif(normal(F.col(c)), F.lit(""))
    out = (
        steps.withColumn("action_key", F.coalesce(filled("normalized_action_text"), text("raw_action_text"), text("command_text"), F.lit("")))
        .withColumn("tool_key", normal(F.col("tool_name")))
        .withColumn("obs_text", obs)
        .withColumn("obs_key", short_hash(normal(F.col("obs_text"))))
        .withColumn("error_key", F.coalesce(filled("error_signature"), text("error_text"), text("output_text"), F.lit("")))
        .withColumn("files", file_list(F.col("mentioned_files"), F.col("file_path")))
        .withColumn("p_score", json_score(F.col("signal_fields"), "progress"))
        .withColumn("n_score", json_score(F.col("signal_fields"), "novelty"))
        .withColumn("kind_key", F.coalesce(first_filled(F.col("step_type")), F.lit("")))
    )
    pair = F.concat_ws(" || ", "action_key", "obs_key")
    return out.withColumn("action_obs_key", F.when((F.col("action_key") != "") & (F.col("obs_key") != ""), pair).otherwise(""))


def prepared(spark, folder: str) -> DataFrame:
    """The steps of a folder, once each, positioned, flagged and keyed; only columns in use are read."""
    columns = [c for c in COLUMNS if c != "row_number"]
    steps = steps_once(read_table(spark, folder, "enriched_steps", *columns))
    spans = read_table(spark, folder, "normalized_spans")
    return keyed(flagged(positioned(steps), spans))


def with_halo(df: DataFrame, rows: int = ROWS, halo: int = HALO) -> DataFrame:
    """Adds `blk` and `own`: each row in its block, and the last rows of a block again in the next one."""
    block = F.floor((F.col("position") - 1) / rows).cast("long")
    late = (F.col("position") - 1) % rows >= rows - halo
    copies = F.when(late, F.array(block, block + 1)).otherwise(F.array(block))
    return df.select("*", F.explode(copies).alias("blk")).withColumn("own", F.col("blk") == block)


def over_block() -> Window:
    return Window.partitionBy(*KEYS, "blk").orderBy("position")


def repeated(key: str, k: int) -> Column:
    """The step and the k - 1 before it have the same non-empty key. k is at most HALO."""
    c, w = F.col(key), over_block()
    out = c != ""
    for j in range(1, k):
        out = out & F.coalesce(F.lag(c, j).over(w) == c, F.lit(False))
    return out


def sequence_repeated(key: str, width: int) -> Column:
    """The last `width` keys equal the `width` before them, which are all filled."""
    c, w = F.col(key), over_block()
    out = F.lit(True)
    for j in range(width):
        later = F.lag(c, j).over(w) if j else c
        earlier = F.lag(c, j + width).over(w)
        out = out & F.coalesce((later == earlier) & (earlier != ""), F.lit(False))
    return out


def earlier_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds prev_{c}: the last non-empty value of `c` in an earlier step; null if there is none."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    back = over_block().rowsBetween(Window.unboundedPreceding, -1)
    per_block = (
        df.where("own")
        .groupBy(*KEYS, "blk")
        .agg(*[F.max(F.when(filled(c).isNotNull(), F.struct("position", filled(c).alias("v")))).alias(c) for c in columns])
    )
    blocks = Window.partitionBy(*KEYS).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(*KEYS, "blk", *[F.last(F.col(c)["v"], ignorenulls=True).over(blocks).alias(f"_c_{c}") for c in columns])
    out = df.select("*", *[F.last(filled(c), ignorenulls=True).over(back).alias(f"_p_{c}") for c in columns])
    joined = out.join(carried, [*KEYS, "blk"])
    return joined.select(*df.columns, *[F.coalesce(f"_p_{c}", f"_c_{c}").alias(f"prev_{c}") for c in columns])


def file_features(df: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """(dataset, trajectory_id, position, seen_{w}..., new_file) of the steps that name a file.

    seen_{w}: in how many of the last w steps some file of this step is named, at most over its files;
    new_file: a file of the step is named for the first time. `df` has the halo.
    """
    each = df.select(*KEYS, "blk", "own", "position", F.explode("files").alias("file"))
    by = Window.partitionBy(*KEYS, "blk", "file").orderBy("position")
    counts = [F.count(F.lit(1)).over(by.rangeBetween(-(w - 1), 0)).alias(f"seen_{w}") for w in windows]
    seen = each.select("*", *counts).where("own").groupBy(*KEYS, "position").agg(*[F.max(f"seen_{w}").alias(f"seen_{w}") for w in windows])
    first = (
        each.where("own").groupBy(*KEYS, "file").agg(F.min("position").alias("position")).select(*KEYS, "position").distinct().withColumn("new_file", F.lit(True))
    )
    return seen.join(first, [*KEYS, "position"], "left").withColumn("new_file", F.coalesce("new_file", F.lit(False)))


# ---------------------------------------------------------------- SQL twins


def norm_sql(x: str) -> str:
    # Here a word bound knows ASCII letters only, so a mark joins digits to other letters for a while.
    letter = r"[ªº\x{00c0}-\x{024f}\x{0400}-\x{04ff}\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]"
    t = rf"regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '(\d)({letter})', '\1_joined_\2', 'g'), '({letter})(\d)', '\1_joined_\2', 'g')"
    t = rf"replace(regexp_replace({t}, '\b\d+\b', '<num>', 'g'), '_joined_', '')"
    return f"trim(regexp_replace({t}, '0x[0-9a-f]+', '<hex>', 'g'))"


def label_sql(x: str) -> str:
    return rf"""CASE regexp_replace(regexp_replace(lower(trim({x})), '[^a-z]+', '_', 'g'), '_?spans?$|^_+|_+$', '', 'g')
    WHEN 'productive_iteration' THEN 'productive_iteration' WHEN 'pi' THEN 'productive_iteration'
    WHEN 'unproductive_cycle' THEN 'unproductive_cycle' WHEN 'uc' THEN 'unproductive_cycle'
    WHEN 'uncertain' THEN 'uncertain' WHEN 'unresolved' THEN 'unresolved' WHEN 'none' THEN 'none' WHEN 'no' THEN 'none' ELSE '' END"""


def score_sql(name: str) -> str:
    path = [f"TRY_CAST(json_extract_string(TRY_CAST(signal_fields AS JSON), '$.{p}{name}.score') AS DOUBLE)" for p in ("", "signals.")]
    return f"coalesce({', '.join(path)})"


ONCE_SQL = """s0 AS (
  SELECT * REPLACE (coalesce(dataset, '') AS dataset) FROM enriched_steps
  WHERE trajectory_id IS NOT NULL AND step_index IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY coalesce(dataset, ''), trajectory_id, step_index ORDER BY row_number) = 1)"""

SPANS_SQL = f"""sp AS (
  SELECT DISTINCT coalesce(dataset, '') AS dataset, trajectory_id, span_id,
    least(start_step_index, end_step_index) AS a, greatest(start_step_index, end_step_index) AS b,
    {label_sql('span_label_norm')} AS label, coalesce(hard_negative, false) AS hn,
    coalesce(productive_iteration_flag, false) AS pi, coalesce(unproductive_cycle_flag, false) AS uc, coalesce(uncertain_flag, false) AS un
  FROM normalized_spans WHERE trajectory_id IS NOT NULL AND start_step_index IS NOT NULL AND end_step_index IS NOT NULL)"""

_NAMED_SQL = """list_filter(list_concat(list_transform(coalesce(
        CASE WHEN trim(mentioned_files) LIKE '[%' THEN TRY_CAST(TRY_CAST(mentioned_files AS JSON) AS VARCHAR[]) END,
        regexp_split_to_array(coalesce(mentioned_files, ''), '[;,|]')), lambda x: trim(x)), [trim(coalesce(file_path, ''))]),
      lambda x: x IS NOT NULL AND x <> '')"""
#: Each name once, in the order of its first mention.
_FILES_SQL = f"list_filter({_NAMED_SQL}, lambda x, i: list_position({_NAMED_SQL}, x) = i)"

PREPARED_SQL = rf"""
WITH {ONCE_SQL}, {SPANS_SQL},
held AS (
  SELECT s.dataset, s.trajectory_id, s.step_index,
    bool_or(p.label = 'productive_iteration' OR p.pi) AS s_pi, bool_or(p.label = 'unproductive_cycle' OR p.uc) AS s_uc,
    bool_or(p.hn) AS s_hn, bool_or(p.label IN ('uncertain', 'unresolved') OR p.un) AS s_un
  FROM s0 s JOIN sp p ON s.dataset = p.dataset AND s.trajectory_id = p.trajectory_id AND s.step_index BETWEEN p.a AND p.b
  GROUP BY 1, 2, 3),
s1 AS (
  SELECT s0.*, row_number() OVER (PARTITION BY s0.dataset, s0.trajectory_id ORDER BY s0.step_index) AS position,
    {label_sql('span_label_norm')} AS own,
    {label_sql('span_label_norm')} = 'productive_iteration' OR coalesce(productive_iteration_flag, false) OR coalesce(s_pi, false) AS in_pi,
    {label_sql('span_label_norm')} = 'unproductive_cycle' OR coalesce(unproductive_cycle_flag, false) OR coalesce(s_uc, false) AS in_uc,
    coalesce(hard_negative, false) OR coalesce(s_hn, false) AS in_hn,
    {label_sql('span_label_norm')} IN ('uncertain', 'unresolved') OR coalesce(uncertain_flag, false) OR coalesce(unresolved_flag, false) OR coalesce(s_un, false) AS in_uncertain,
    coalesce(CASE WHEN trim(normalized_action_text) <> '' THEN normalized_action_text END,
      nullif({norm_sql('raw_action_text')}, ''), nullif({norm_sql('command_text')}, ''), '') AS action_key,
    {norm_sql('tool_name')} AS tool_key,
    coalesce(CASE WHEN trim(observation_text) <> '' THEN observation_text END, output_text, '') AS obs_text,
    coalesce(CASE WHEN trim(error_signature) <> '' THEN error_signature END, nullif({norm_sql('error_text')}, ''), nullif({norm_sql('output_text')}, ''), '') AS error_key,
    {_FILES_SQL} AS files,
    {score_sql('progress')} AS p_score, {score_sql('novelty')} AS n_score, coalesce(nullif(trim(step_type), ''), '') AS kind_key
  FROM s0 LEFT JOIN held USING (dataset, trajectory_id, step_index)),
s2 AS (SELECT *, CASE WHEN {norm_sql('obs_text')} <> '' THEN substr(sha1({norm_sql('obs_text')}), 1, 16) ELSE '' END AS obs_key FROM s1),
steps AS (SELECT *, CASE WHEN action_key <> '' AND obs_key <> '' THEN action_key || ' || ' || obs_key ELSE '' END AS action_obs_key FROM s2)
"""
