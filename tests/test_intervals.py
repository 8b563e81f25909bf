import random

from pyspark.sql import functions as F

from steploom.operators.intervals import clean_spans, periods_and_gaps

SCHEMA = "k string, s int, e int"


def brute(rows):
    out = set()
    for key in {r[0] for r in rows if r[0] is not None}:
        covered = set()
        for _, a, b in (r for r in rows if r[0] == key and r[1] is not None and r[2] is not None):
            covered |= set(range(min(a, b), max(a, b) + 1))
        last = None
        for p in sorted(covered):
            if p - 1 not in covered:
                if last is not None:
                    out.add((key, "gap", last + 1, p - 1))
                start = p
            if p + 1 not in covered:
                out.add((key, "period", start, p))
                last = p
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force_with_blocks(spark):
    r = random.Random(5)
    rows = [(r.choice("abc"), r.choice([0, 4090, 8190, 20000]) + r.randint(0, 60), None) for _ in range(150)]
    rows = [(k, s, s + r.randint(-3, 9)) for k, s, _ in rows] + [("a", None, 3), ("b", 4, None), (None, 1, 2)]
    rows += rows[:20]
    assert got(periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ["k"], "s", "e")) == brute(rows)


def test_nested_adjoining_swapped_and_single(spark):
    rows = [("x", 1, 9), ("x", 2, 3), ("x", 10, 12), ("x", 20, 15), ("y", 7, 7)]
    assert got(periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ["k"], "s", "e")) == {
        ("x", "period", 1, 12), ("x", "gap", 13, 14), ("x", "period", 15, 20), ("y", "period", 7, 7),
    }


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(periods_and_gaps(empty, ["k"], "s", "e")) == set()
    df = spark.createDataFrame([("x", 1, 2), ("x", 5, 6)], SCHEMA)
    for c in ("_e0", "_s", "_block", "pos", "side", "rank", "kind", "n"):
        df = df.withColumn(c, F.lit("z"))
    assert got(periods_and_gaps(df, ["k"], "s", "e")) == {("x", "period", 1, 2), ("x", "gap", 3, 4), ("x", "period", 5, 6)}


def test_open_ends_and_labels(spark):
    spans = spark.createDataFrame(
        [("t", 3, None, " Productive-Iteration "), ("t", 1, 2, "productive_iteration_span"), ("u", 1, None, "none"), ("t", 1, 2, " "), (" ", 1, 2, "none"), ("t", None, 4, "none")],
        "trajectory_id string, start_step_index int, end_step_index int, span_label_norm string",
    )
    steps = spark.createDataFrame([("t", 8), ("t", None), ("t", 2)], "trajectory_id string, step_index int")
    rows = got(clean_spans(spans, steps).select("trajectory_id", "span_label", "start_step_index", "end_step_index"))
    assert rows == {("t", "productive_iteration", 3, 8), ("t", "productive_iteration", 1, 2)}
