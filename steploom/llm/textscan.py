"""What the text scanners share: fields of a table as records, spans, splicing, result forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.sources.tables import read_table

Span = tuple[int, int, str]


def step_key() -> Column:
    return F.concat(F.col("trajectory_id"), F.lit("#"), F.col("step_index").cast("string"))


def records(spark, folder: str, step_fields: list[str]) -> DataFrame:
    """source_table, record_key and the text columns of both tables; a re-sent row stays a row.

    Rows without a key have a null record_key: they are scanned and redacted all the same.
    """
    steps = read_table(spark, folder, "enriched_steps", "trajectory_id", "step_index", *step_fields).select(
        F.lit("enriched_steps").alias("source_table"), step_key().alias("record_key"), *step_fields
    )
    prefixes = read_table(spark, folder, "prefix_replan_sample", "released_prefix_id", "recent_context_text").select(
        F.lit("prefix_replan_sample").alias("source_table"),
        F.col("released_prefix_id").alias("record_key"),
        "recent_context_text",
    )
    return steps.unionByName(prefixes, allowMissingColumns=True)


def settle(spans: list[Span]) -> list[Span]:
    """Spans without overlap, in order: the earlier one stays, of equal starts the longer one."""
    kept: list[Span] = []
    for s in sorted(set(spans), key=lambda x: (x[0], -x[1], x[2])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def splice(text: str, spans: list[Span], mask: Callable[[str, str], str]) -> str:
    """`text` with each span replaced by mask(value, type) and all else unchanged."""
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], mask(text[a:b], kind)]
        at = b
    return "".join([*parts, text[at:]])


def found(df: DataFrame, fields: list[str], finder: Callable[[], Callable[[str], list[Span]]], type_name: str) -> DataFrame:
    """One row per record, field and type that `finder()` finds; texts stay on their executor."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            tables, keys = batch.column(0), batch.column(1)
            out: list[tuple] = []
            for n, field in enumerate(fields):
                for row, text in enumerate(batch.column(2 + n).to_pylist()):
                    if text:
                        for kind in {s[2] for s in find(text)}:
                            out.append((tables[row].as_py(), keys[row].as_py(), field, kind))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in columns], ["source_table", "record_key", "field_name", type_name]
            )

    schema = f"source_table string, record_key string, field_name string, {type_name} string"
    return (
        df.select("source_table", "record_key", *fields)
        .mapInArrow(scan, schema)
        .where(F.col("record_key").isNotNull())
        .distinct()
    )


def redacted(
    df: DataFrame,
    fields: list[str],
    finder: Callable[[], Callable[[str], list[Span]]],
    masker: Callable[[], Callable[[str, str], str]],
) -> DataFrame:
    """`df` with every text of `fields` redacted, and n_redacted, the number of masked spans.

    Further columns pass unchanged; a column n_redacted that `df` has already is replaced.
    """
    df = df.drop("n_redacted")
    names = df.columns
    schema = df.select(*names, F.lit(0).alias("n_redacted")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, mask = finder(), masker()
        for batch in batches:
            arrays, counts = dict(zip(names, batch.columns)), [0] * batch.num_rows
            for field in fields:
                texts = arrays[field].to_pylist()
                for row, text in enumerate(texts):
                    if text and (spans := find(text)):
                        texts[row] = splice(text, spans, mask)
                        counts[row] += len(spans)
                arrays[field] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*arrays.values(), pa.array(counts, pa.int32())], [*names, "n_redacted"]
            )

    return df.mapInArrow(scan, schema)
