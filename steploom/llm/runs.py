"""Runs of the same action in ordered event sequences (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.operators.ranking import BLOCK, block_of, running_total
from steploom.sources.tables import broadcast_if_small, checkpointed, read_table

#: A first word is a slip of another one with the same letters that is so many times as frequent.
SLIP = 8

# What may stand around an action without changing it. Java and RE2 syntax.
QUOTES = "[`'\"‘’“”]"
SPACES = "[\\s ​﻿]+"
STAMP = r"^\[?\d{4}-\d\d-\d\d[t ][\d:.]+z?\]?\s+"
LEAD_IN = r"^((please|now|again|retry|retrying|once more|next|then|ok|okay|and|so|just)[:,]?\s+)+"
OUTPUT_HANDLING = (
    r"\s+(2>&1|2>\s*/dev/null|>\s*/dev/null|\|\s*(tail|head|cat|less|tee)\b[^|]*"
    r"|--(basetemp|run-id|junitxml|color|log-file|rootdir)[= ]\S+)"
)
REMARK = r"\s*(#.*|\((attempt|try|retry|take)\b[^)]*\)|\[[0-9a-f]{4,}\])$"
HEX_WORD = r"\b(0x[0-9a-f]+|[0-9a-f]*\d[0-9a-f]*[a-f][0-9a-f]*\d[0-9a-f]*)\b"
NUMBER = r"<num>|<hex>|\b\d+(p?)\b"
PREFIX_OF_PATH = r"(^|\s)(/(workspace|work|repo|home|app|testbed|tmp)/[^/\s]+/|\./)"
FILE_IN_TEXT = r"((?:[a-z0-9_.-]+/)+[a-z0-9_.-]+\.[a-z]{1,5}|[a-z0-9_-][a-z0-9_.-]*\.(?:py|go|ts|js|tsx|jsx|json|ya?ml|toml|ini|cfg|md|txt|csv|sh|sql|java|rs|cpp|c|h))\b"


def plain_path(c: Column) -> Column:
    """A path in lower case with forward slashes and without workspace or ./ in front."""
    low = F.regexp_replace(F.lower(F.trim(c)), r"\\+", "/")
    return F.regexp_replace(low, r"^(/(workspace|work|repo|home|app|testbed|tmp)/[^/]+/|\./)+", "")


def plain_action(c: Column) -> Column:
    """The action text without case, quotes, numbers, times, ids, lead-ins and output handling."""
    t = F.lower(c)
    t = F.trim(F.regexp_replace(t, SPACES, " "))
    t = F.regexp_replace(t, QUOTES, "")
    t = F.regexp_replace(t, r"\\+", "/")
    t = F.regexp_replace(t, STAMP, "")
    t = F.regexp_replace(t, LEAD_IN, "")
    t = F.regexp_replace(t, OUTPUT_HANDLING, "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s.;,!]+$", ""), REMARK, "")
    t = F.regexp_replace(t, PREFIX_OF_PATH, "$1")
    t = F.regexp_replace(F.regexp_replace(t, HEX_WORD, "#"), NUMBER, "#$1")
    return F.regexp_replace(t, r"[\s.;,!]+$", "")


def spelled(steps: DataFrame, word: str) -> DataFrame:
    """`steps` with each `word` whose inner letters change places in a far more frequent word replaced by that one.

    Two words are compared if they begin alike and have the same letters; the more frequent one counts
    from SLIP times the occurrences on. `steps` is read twice. Distinct words are few against the steps.
    """
    letters = F.concat(F.substring(word, 1, 1), F.array_join(F.array_sort(F.split(F.expr(f"substring({word}, 2)"), "")), ""))
    n = steps.where(F.col(word) != "").groupBy(word).agg(F.count(F.lit(1)).alias("_n")).withColumn("_letters", letters)
    most = Window.partitionBy("_letters")  # arrangements of the same letters
    top = F.max(F.struct("_n", F.col(word).alias("_word"))).over(most)
    slips = n.withColumn("_top", top).where(F.col("_top._n") >= SLIP * F.col("_n")).select(word, F.col("_top._word").alias("_right"))
    return steps.join(broadcast_if_small(slips), word, "left").withColumn(word, F.coalesce("_right", word)).drop("_right")


def action_parts(action: Column, plain: Column, tool: Column, file: Column) -> tuple[Column, Column]:
    """The first word of an action, given also in its plain form, and a 64-bit key of tool, file and the rest of the request; null for a null or blank action."""
    tool_key = F.coalesce(F.regexp_replace(F.lower(F.trim(tool)), r"[\s_-]+", "_"), F.lit(""))
    named = F.regexp_extract(F.regexp_replace(F.lower(action), r"\\+", "/"), FILE_IN_TEXT, 1)
    own = F.nullif(plain_path(file), F.lit(""))
    file_key = F.coalesce(own, F.regexp_replace(named, r"^((workspace|work|repo|home|app|testbed|tmp)/[^/]+/|\./)", ""))
    blank = F.regexp_replace(action, SPACES, "") == ""
    there = action.isNotNull() & ~blank
    rest = F.xxhash64(F.regexp_replace(plain, "^[a-z]+", ""), tool_key, file_key)
    return F.when(there, F.regexp_extract(plain, "^[a-z]+", 0)), F.when(there, rest)


def runs(
    steps: DataFrame,
    entity: str = "trajectory_id",
    order: str = "step_index",
    key: str = "_key",
    at: str = "recorded_at",
    least: int = 2,
) -> DataFrame:
    """Maximal runs of equal `key` inside `entity` by `order`.

    Result: entity, first_step_index, last_step_index, n_steps, duration_s, run_key. Rows with a null
    entity or order are left out; rows with the same (entity, order) count once (the smallest key,
    nulls last); a null key is in no run and ends one; missing orders do not end a run; a null time
    gives a null duration only if the whole run has none.

    Method: the row number inside the entity minus the row number inside (entity, key) is constant
    exactly in a run. Both numbers are counted in blocks of the order, so a long entity is split.
    """
    rows = (
        steps.where(F.col(entity).isNotNull() & F.col(order).isNotNull())
        .select(F.col(entity).alias("_e"), F.col(order).alias("_o"), F.col(key).alias("_v"), F.col(at).cast("timestamp").alias("_t"))
        .withColumn("_block", block_of(F.col("_o"), BLOCK))
        .repartition("_e", "_block")
    )
    # The exchange above serves the deduplication and both numberings.
    once = rows.groupBy("_e", "_block", "_o").agg(F.min("_v").alias("_v"), F.min("_t").alias("_t"))
    in_entity = running_total(once, ["_e"], "_o", None, "_all", block="_block")
    keyed = in_entity.where(F.col("_v").isNotNull())
    in_value = running_total(keyed, ["_e", "_v"], "_o", None, "_same", block="_block")
    return (
        in_value.groupBy("_e", "_v", (F.col("_all") - F.col("_same")).alias("_run"))
        .agg(
            F.min("_o").alias("first_step_index"),
            F.max("_o").alias("last_step_index"),
            F.count(F.lit(1)).alias("n_steps"),
            ((F.unix_micros(F.max("_t")) - F.unix_micros(F.min("_t"))) / F.lit(1e6)).alias("duration_s"),
        )
        .where(F.col("n_steps") >= least)
        .select(
            F.col("_e").alias(entity), "first_step_index", "last_step_index", "n_steps",
            "duration_s", F.col("_v").alias("run_key"),
        )
    )


def keyed_steps(steps: DataFrame) -> DataFrame:
    """trajectory_id, step_index, recorded_at and _key of each step once: equal keys are the same action, null none."""
    first, rest = action_parts(F.col("normalized_action_text"), F.col("_plain"), F.col("tool_name"), F.col("file_path"))
    rows = steps.where(F.col("trajectory_id").isNotNull() & F.col("step_index").isNotNull())
    # A column of its own, so that it is worked out once for both parts.
    rows = rows.withColumn("_plain", plain_action(F.col("normalized_action_text")))
    rows = rows.select("trajectory_id", "step_index", "recorded_at", first.alias("_first"), rest.alias("_rest"))
    # Written once, as the words are counted before they are compared; the texts stay behind.
    once = checkpointed(
        rows.groupBy("trajectory_id", "step_index")
        .agg(F.min(F.when(F.col("_rest").isNotNull(), F.struct("_first", "_rest"))).alias("_a"), F.min("recorded_at").alias("recorded_at"))
        .select("trajectory_id", "step_index", "recorded_at", "_a._first", "_a._rest")
    )
    s = spelled(once, "_first")
    return s.select("trajectory_id", "step_index", "recorded_at", F.when(F.col("_rest").isNotNull(), F.xxhash64("_first", "_rest")).alias("_key"))


def collapsed(steps: DataFrame) -> DataFrame:
    """Every step once, with each run of the same action as one event with count and duration."""
    return runs(keyed_steps(steps), least=1)


def _steps(spark, folder: str) -> DataFrame:
    return read_table(
        spark, folder, "enriched_steps",
        "trajectory_id", "step_index", "normalized_action_text", "tool_name", "file_path", "recorded_at",
    )


def p1_found(spark, folder: str) -> DataFrame:
    return runs(keyed_steps(_steps(spark, folder))).select("trajectory_id", "first_step_index", "last_step_index")


def p1_events(spark, folder: str) -> DataFrame:
    """The collapsed sequences: one row per event, without the engine's own key."""
    return collapsed(_steps(spark, folder)).drop("run_key")


_ACTION_SQL = r"""
WITH a AS (
  SELECT DISTINCT trajectory_id, step_index, recorded_at, lower(tool_name) AS tool, file_path,
    regexp_replace(lower(normalized_action_text), '[\s\x{00a0}\x{200b}\x{feff}]+', ' ', 'g') AS t
  FROM enriched_steps WHERE step_index IS NOT NULL AND trajectory_id IS NOT NULL),
b AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(t),
      '[`''"\x{2018}\x{2019}\x{201c}\x{201d}]', '', 'g'), '\\+', '/', 'g'),
      '@STAMP', ''), '@LEAD', ''), '@OUT', '', 'g') AS u,
    regexp_extract(regexp_replace(t, '\\+', '/', 'g'), '@FILE', 1) AS named,
    nullif(regexp_replace(regexp_replace(lower(trim(file_path)), '\\+', '/', 'g'),
      '^(/(workspace|work|repo|home|app|testbed|tmp)/[^/]+/|\./)+', ''), '') AS own
  FROM a),
c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u,
      '[\s.;,!]+$', ''), '@REMARK', ''), '@PREFIX', '\1', 'g'), '@HEX', '#', 'g'), '@NUM', '#\1', 'g'),
      '[\s.;,!]+$', '') AS v
  FROM b),
g AS (
  SELECT trajectory_id, step_index, recorded_at, CASE WHEN trim(t) <> '' THEN regexp_extract(v, '^[a-z]+') END AS w,
    CASE WHEN trim(t) <> '' THEN concat_ws('|', substr(v, length(regexp_extract(v, '^[a-z]+')) + 1), regexp_replace(trim(coalesce(tool, '')), '[\s_-]+', '_', 'g'),
      coalesce(own, regexp_replace(named, '^((workspace|work|repo|home|app|testbed|tmp)/[^/]+/|\./)', ''))) END AS rest
  FROM c),
n AS (SELECT w, w[1] || coalesce(list_aggregate(list_sort(string_split(substr(w, 2), '')), 'string_agg', ''), '') AS letters, count(DISTINCT (trajectory_id, step_index)) AS n
  FROM g WHERE w <> '' GROUP BY 1),
slip AS (SELECT a.w, arg_max(b.w, (b.n, b.w)) AS better FROM n a JOIN n b USING (letters) GROUP BY a.w, a.n HAVING max(b.n) >= @SLIP * a.n),
d AS (SELECT trajectory_id, step_index, recorded_at, coalesce(better, g.w) || '|' || rest AS k FROM g LEFT JOIN slip ON slip.w = g.w),
e AS (SELECT trajectory_id, step_index, min(k) AS k, min(recorded_at) AS recorded_at FROM d GROUP BY 1, 2),
f AS (
  SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_index)
          - row_number() OVER (PARTITION BY trajectory_id, k ORDER BY step_index) AS g FROM e)
"""
for _name, _value in (
    ("STAMP", STAMP), ("LEAD", LEAD_IN), ("OUT", OUTPUT_HANDLING), ("FILE", FILE_IN_TEXT),
    ("REMARK", REMARK), ("PREFIX", PREFIX_OF_PATH), ("HEX", HEX_WORD), ("NUM", NUMBER), ("SLIP", str(SLIP)),
):
    _ACTION_SQL = _ACTION_SQL.replace(f"@{_name}", _value.replace("'", "''"))

P1_FOUND_SQL = _ACTION_SQL + """
SELECT trajectory_id, min(step_index) AS first_step_index, max(step_index) AS last_step_index
FROM f WHERE k IS NOT NULL GROUP BY trajectory_id, k, g HAVING count(*) >= 2"""

P1_EVENTS_SQL = _ACTION_SQL + """
SELECT trajectory_id, min(step_index) AS first_step_index, max(step_index) AS last_step_index, count(*) AS n_steps,
  (epoch_us(max(recorded_at)) - epoch_us(min(recorded_at))) / 1e6 AS duration_s
FROM f WHERE k IS NOT NULL GROUP BY trajectory_id, k, g"""
