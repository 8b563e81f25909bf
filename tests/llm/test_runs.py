import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from steploom.llm import runs as R
from steploom.llm.queries import ORACLES, QUERIES

T0 = datetime(2026, 1, 1)
SCHEMA = "trajectory_id string, step_index int, normalized_action_text string, tool_name string, file_path string, recorded_at timestamp"


def step(i, action, tool="bash", path=None, t="t"):
    return (t, i, action, tool, path, T0 + timedelta(seconds=i))


def found(spark, rows):
    df = R.runs(R.keyed_steps(spark.createDataFrame(rows, SCHEMA)))
    return {(r.trajectory_id, r.first_step_index, r.last_step_index, r.n_steps, r.duration_s) for r in df.collect()}


def test_noise_makes_no_difference(spark):
    variants = [
        "grep -rn \"a_b\" src/io", "gerp -rn 'a_b' src/io", "GREP  -RN \"A_B\" SRC/IO\t", "`grep -rn \"a_b\" src/io`", "[2026-10-15t10:54:21z] grep -rn \"a_b\" src/io",
        "please grep -rn \"a_b\" ./src/io", "once more, grep -rn \"a_b\" src/io # try 3", "grep -rn \"a_b\" src/io 2>&1 | tail -n <num>", "grep -rn \"a_b\" src/io [35de753c]",
        "grep -rn \"a_b\" src/io --run-id 0x12af", "grep -rn \"a_b\" src/io...", "grep\xa0-rn \"a_b\" src/io (attempt 2)", "grep -rn \"a_b\" /workspace/x/src/io;",
    ]
    rows = [step(i * 3, v, tool=["bash", "Bash ", "bash"][i % 3]) for i, v in enumerate(variants)]
    assert found(spark, rows) == {("t", 0, 36, 13, 36.0)}


def test_arguments_tools_files_blanks_and_gaps(spark):
    rows = [
        step(0, "view src/a.py", path="src/a.py"), step(5, "view src/a.py", path=None), step(6, "view src/b.py", path=None),
        step(7, " "), step(8, None), step(9, "rerun", path="x/a.py"), step(10, "rerun", path="x/b.py"), step(11, "rerun", path="x\\b.py"),
        step(12, "rerun", path=None), step(13, "ls", "a-b"), step(14, "ls", "A_b"), step(15, "ls", "c"),
    ]
    assert {x[:4] for x in found(spark, rows)} == {("t", 0, 5, 2), ("t", 10, 11, 2), ("t", 13, 14, 2)}


def test_pairs_of_actions(spark):
    many = [step(1000 + 2 * k, w, t=f"m{i}") for i in range(20) for k, w in enumerate(("cat a.py", "tar x", "form y", "from y", "view b"))]
    same = [("view setup.py", None, "view setup.py", "setup.py"), ("viwe b", None, "view b", None), ("pytest tests/a.py::t", "tests/a.py", "pytest tests/a.py::t", None)]
    other = [
        ("act a.py", None, "cat a.py", None), ("rat x", None, "tar x", None), ("form y", None, "from y", None), ("view setup.py", None, "view conf.py", None),
        ("ls a", None, "ls b", None), ("grep -n x a", None, "grep -n y a", None), ("pytest a.py::t", "a.py", "pytest a.py::u", "a.py"),
    ]
    rows = [s for n, (a, p, b, q) in enumerate(same + other) for s in (step(1, a, path=p, t=str(n)), step(2, b, path=q, t=str(n)))]
    got = {x[0] for x in found(spark, rows + many)}
    assert {t for t in got if not t.startswith("m")} == {str(n) for n in range(len(same))}


def test_resent_null_and_empty(spark):
    rows = [step(1, "ls"), step(1, "ls"), ("t", None, "ls", "bash", None, None), (None, 1, "ls", None, None, None), (None, 2, "ls", None, None, None), step(2, "pwd")]
    assert found(spark, rows) == set()
    assert found(spark, [("t", 1, "ls", None, None, None), ("t", 2, "ls", None, None, None)]) == {("t", 1, 2, 2, None)}
    assert R.runs(R.keyed_steps(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_trajectory_against_brute_force(spark):
    r = random.Random(3)
    index = sorted(r.sample(range(20_000), 3_000))
    keys = [r.choice([1, 1, 1, 2, None]) for _ in index]
    df = spark.createDataFrame(list(zip(["t"] * 3000, index, keys, [T0] * 3000)), "trajectory_id string, step_index int, _key long, recorded_at timestamp")
    want, start = set(), 0
    for i in range(1, len(index) + 1):
        if i == len(index) or keys[i] != keys[start] or keys[start] is None:
            if i - start >= 2 and keys[start] is not None:
                want.add((index[start], index[i - 1]))
            start = i
    clash = df.withColumn("_block", F.lit("x")).withColumn("_e", F.lit(1))
    assert {(x.first_step_index, x.last_step_index) for x in R.runs(clash).collect()} == want


def test_against_sql(spark, data, same):
    for name in ("p1_found", "p1_events"):
        same(QUERIES[name](spark, data), ORACLES[name])
