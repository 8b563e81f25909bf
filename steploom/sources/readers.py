"""Readers and writers of step logs: CSV, JSON lines, review packets in JSON and Markdown, sinks.

Every value is read as text and parsed later, so a file's own types never decide. Column names are
found by candidate lists, exact first, then without case.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.functions.parse import bool_or_null, lenient_int, recovered_json, span_label, step_label
from steploom.operators.ranking import range_totals

# Names that the columns have in the sources, in order of preference.
STEP_COLUMNS = {
    "trajectory_id": ["trajectory_id", "traj_id", "trajectory", "run_id", "instance_id"],
    "step_index": ["step_index", "step_idx", "step", "index", "step_id"],
    "label": ["label_norm", "step_label", "label", "final_label"],
    "span_label": ["span_label_norm", "span_label", "span"],
    "hard_negative": ["hard_negative", "is_hard_negative", "hn"],
    "action": ["raw_action_text", "action", "action_text", "command"],
    "observation": ["observation_text", "observation", "output"],
}
SPAN_COLUMNS = {
    "span_id": ["span_id", "id"],
    "start": ["start_step_index", "start_step", "span_start", "start"],
    "end": ["end_step_index", "end_step", "span_end", "end"],
    "confidence": ["confidence", "annotator_confidence"],
    "evidence": ["evidence_text", "evidence", "rationale", "evidence_summary"],
}
#: Fields of review files that go into the evidence and the signals of a step.
EVIDENCE_FIELDS = [
    "evidence_note", "schema_deviation_note", "evidence_summary", "evidence_quotes", "manual_rationale", "adjudication_rationale", "notes",
]
SKIP_WORDS = ("backup", "draft", "old", "tmp", "archive")


def first_present(df: DataFrame, candidates: list[str]) -> Column:
    """The first of `candidates` among the columns, exact, then without case; null text if none."""
    low = {c.lower(): c for c in reversed(df.columns)}
    for name in candidates:
        if name in df.columns:
            return F.col(f"`{name}`")
    for name in candidates:
        if name.lower() in low:
            return F.col(f"`{low[name.lower()]}`")
    return F.lit(None).cast("string")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text, quoted line breaks kept, a byte order mark taken off."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with each field as text; blank and broken lines are left out. `broken_lines` has the broken ones."""
    return spark.read.option("primitivesAsString", True).option("mode", "DROPMALFORMED").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, row_number from 1 and value of every line of text files, blank ones included.

    Files are read in parts; a line's number is its place in the part plus the lines of the parts before.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    return range_totals(lines, ["file"], ["_start", "_id"], None, "row_number").select("file", F.col("row_number").cast("long").alias("row_number"), "value")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, row_number and value of the lines that are neither blank nor a JSON object."""
    return numbered_lines(spark, path).where((F.trim("value") != "") & (recovered_json(F.col("value"))["way"] != "whole"))


def json_records(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """file, row_number and `fields` as text of every JSON line that is an object."""
    each = numbered_lines(spark, path).where(recovered_json(F.col("value"))["way"] == "whole")
    return each.select("file", "row_number", *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])


def normalised_steps(df: DataFrame, dataset: str, role: str = "") -> DataFrame:
    """The canonical step columns of a raw table."""
    at = lambda key: first_present(df, STEP_COLUMNS[key]).cast("string")
    return df.select(
        F.lit(dataset).alias("dataset"), F.lit(role).alias("dataset_role"), at("trajectory_id").alias("trajectory_id"),
        lenient_int(at("step_index")).alias("step_index"), at("step_index").alias("step_id_raw"), step_label(at("label")).alias("label_norm"),
        span_label(at("span_label")).alias("span_label_norm"), bool_or_null(at("hard_negative")).alias("hard_negative"),
        at("action").alias("raw_action_text"), at("observation").alias("observation_text"),
    )


def normalised_spans(df: DataFrame, dataset: str, role: str = "") -> DataFrame:
    """The canonical span columns of a raw table; flags follow from the label."""
    names = STEP_COLUMNS | SPAN_COLUMNS
    at = lambda key: first_present(df, names[key]).cast("string")
    label = span_label(at("span_label"))
    is_ = lambda v: F.coalesce(label == v, F.lit(False))
    return df.select(
        F.lit(dataset).alias("dataset"), F.lit(role).alias("dataset_role"), F.lit("explicit_span_csv").alias("span_source"), at("trajectory_id").alias("trajectory_id"),
        at("span_id").alias("span_id"), lenient_int(at("start")).alias("start_step_index"), lenient_int(at("end")).alias("end_step_index"), label.alias("span_label_norm"),
        bool_or_null(at("hard_negative")).alias("hard_negative"), is_("productive_iteration").alias("productive_iteration_flag"),
        is_("unproductive_cycle").alias("unproductive_cycle_flag"), is_("uncertain").alias("uncertain_flag"), is_("unresolved").alias("unresolved_flag"),
        at("confidence").try_cast("double").alias("confidence"), at("evidence").alias("evidence_text"),
    )


def discovered(spark: SparkSession, folder: str, patterns: list[str]) -> list[str]:
    """Files under `folder` in the order of `patterns`, each once, at any depth."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        found.append(files.next().getPath().toString())
    found.sort()
    return list(dict.fromkeys(f for p in patterns for f in found if fnmatch(os.path.basename(f), p)))


def union_pools(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def loaded_pools(spark: SparkSession, pools: dict[str, tuple[str, str]], patterns: list[str]) -> DataFrame:
    """The steps of all pools: name -> (role, folder). Of a folder the best label file is read, CSV or JSON lines; a folder without one adds nothing."""
    parts = []
    for name, (role, folder) in pools.items():
        best = best_label_file(discovered(spark, folder, patterns), patterns)
        if best:
            raw = read_json_lines(spark, best) if best.endswith(("jsonl", "ndjson")) else read_csv(spark, best)
            parts.append(normalised_steps(raw, name, role))
    return union_pools(parts or [normalised_steps(spark.createDataFrame([], "trajectory_id string"), "")])


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at `path`, built first if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.parquet(path)
    return spark.read.parquet(path)


def review_records(df: DataFrame, dataset: str) -> DataFrame:
    """Reviewer rows and label sidecars as (dataset, trajectory_id, step_index, signal_fields, evidence_fields): the fields that are there, as JSON."""
    at = lambda names: first_present(df, names).cast("string")
    there = [c for c in EVIDENCE_FIELDS if c in df.columns]
    evidence = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in there])) if there else F.lit("{}")
    rows = df.select(
        F.lit(dataset).alias("dataset"), at(["pilot_id", "trajectory_id"]).alias("trajectory_id"), lenient_int(at(["step_index", "step_id"])).alias("step_index"),
        at(["signals"]).alias("signal_fields"), evidence.alias("evidence_fields"),
    )
    return rows.where("trajectory_id IS NOT NULL AND step_index IS NOT NULL")


def enriched(steps: DataFrame, records: DataFrame) -> DataFrame:
    """`steps` with the raw fields of `records` at the same (dataset, trajectory_id, step_index); of several records the first filled value counts.

    A step without record keeps its own values; a field that the steps have already is filled where it is blank.
    """
    keys = ["dataset", "trajectory_id", "step_index"]
    fields = [c for c in records.columns if c not in keys]
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    once = records.groupBy(*keys).agg(*[F.min(filled(c)).alias(f"_r_{c}") for c in fields])
    joined = steps.join(once, keys, "left")
    own = lambda c: filled(c) if c in steps.columns else F.lit(None).cast("string")
    kept = [c for c in steps.columns if c not in fields]
    return joined.select(*kept, *[F.coalesce(own(c), F.col(f"_r_{c}")).alias(c) for c in fields])


def json_packets(spark: SparkSession, path: str) -> DataFrame:
    """One row per step of review packets: JSON documents with an array `steps`."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if "steps" not in df.columns:
        return spark.createDataFrame([], "trajectory_id string, position int, step struct<action:string>")
    return df.select(first_present(df, STEP_COLUMNS["trajectory_id"]).alias("trajectory_id"), F.posexplode("steps").alias("position", "step"))


def markdown_packets(spark: SparkSession, path: str) -> DataFrame:
    """One row per '## Step N' block of Markdown packets: file, step_index, action, observation."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    blocks = text.select("file", F.split("value", r"(?m)^#{1,4} +Step +(?=\d)").alias("p"))
    blocks = blocks.select("file", F.explode(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))).alias("b"))
    part = lambda name: F.regexp_extract("b", rf"(?ms)^\**{name}\**:\s*(.*?)(?=^\**(?:Action|Observation|Thought|Error)\**:|\z)", 1)
    field = lambda name: F.regexp_replace(part(name), r"^\s+|\s+$", "")
    return blocks.select(
        "file", lenient_int(F.regexp_extract("b", r"^(\d+)", 1)).alias("step_index"), field("Action").alias("action"), field("Observation").alias("observation")
    )


def best_label_file(paths: list[str], preferred: list[str]) -> str | None:
    """Of listed paths the one to read: no skip word, then the order of `preferred` patterns, then the shallowest."""
    good = [p for p in paths if not any(w in os.path.basename(p).lower() for w in SKIP_WORDS)]
    rank = lambda p: next((i for i, x in enumerate(preferred) if fnmatch(os.path.basename(p), x)), len(preferred))
    return min(good, key=lambda p: (rank(p), p.count("/"), p), default=None)


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Parquet, and CSV with nested values as JSON text."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("escape", '"').csv(f"{folder}/{name}.csv", header=True)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, folder: str) -> None:
    """Adds rows to a folder of CSV files; each has its header, which readers take once."""
    df.write.mode("append").option("escape", '"').csv(folder, header=True)


def latex_table(df: DataFrame, caption: str, label: str, most: int = 200) -> str:
    """A report table as LaTeX, with numbers to three places; it fails on more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table instead")
    escape = lambda s: re.sub(r"([&%$#_{}])", r"\\\1", str(s))
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else escape(v)
    name = re.sub(r"[^A-Za-z0-9]+", "_", label).strip("_").lower()
    body = [" & ".join(cell(v) for v in r) + r" \\" for r in rows]
    head = " & ".join(escape(c) for c in df.columns) + r" \\"
    lines = [r"\begin{table}", rf"\caption{{{escape(caption)}}}", rf"\label{{tab:{name}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", head, r"\midrule"]
    return "\n".join([*lines, *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"]) + "\n"


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A report table as Markdown. It fails on more than `most` rows: reports are small, tables are written."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table instead")
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else re.sub(r"\|", "\\|", str(v))
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]]) + "\n"


def without_private_columns(df: DataFrame, pattern: str = r"(?i)path|host|user|secret|local") -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])
