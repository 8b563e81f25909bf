from pyspark.sql import functions as F

from steploom.functions import parse, text
from steploom.operators import sequence as seq
from steploom.operators.ranking import running_total, running_totals

STEPS = "dataset string, trajectory_id string, step_index int, key string"


def steps(spark, keys, t="t"):
    return seq.positioned(spark.createDataFrame([("d", t, i * 2, k) for i, k in enumerate(keys)], STEPS))


def test_running_total_over_blocks(spark):
    rows = [("a", i * 3, i % 5) for i in range(300)] + [("b", 7, 1)]
    df = spark.createDataFrame(rows, "k string, o int, w int")
    out = {(r.k, r.o): r.t for r in running_total(df, ["k"], "o", "w", "t", width=64).collect()}
    total = 0
    for _, o, w in rows[:300]:
        total += w
        assert out["a", o] == total
    assert out["b", 7] == 1
    both = running_totals(df, ["k"], "o", {"n": None, "t": "w"}, width=64).where("k = 'a'").agg(F.max("n"), F.max("t")).first()
    assert tuple(both) == (300, total)


def test_repeats_cross_blocks_and_stop_at_empty_keys(spark):
    keys = ["x", "x", "x", "", "", "y", "y", "x", "x", "x", "x"]
    h = seq.with_halo(steps(spark, keys), rows=4, halo=3)
    rows = h.select("position", "own", seq.repeated("key", 3).alias("r")).where("own").orderBy("position").collect()
    assert [r.position for r in rows if r.r] == [3, 10, 11]


def test_sequence_repeat(spark):
    h = seq.with_halo(steps(spark, ["a", "b", "a", "b", "", "b", "", "b"]))
    rows = h.select("position", seq.sequence_repeated("key", 2).alias("r")).where("r").collect()
    assert [r.position for r in rows] == [4]


def test_earlier_filled_is_carried_over_blocks(spark):
    h = seq.with_halo(steps(spark, ["p", "", "", "", "", "", "", "q", ""]), rows=2, halo=1)
    rows = seq.earlier_filled(h, ["key"]).where("own").orderBy("position").collect()
    assert [r.prev_key for r in rows] == [None, "p", "p", "p", "p", "p", "p", "p", "q"]


def test_coverage_counts_inclusive_ends(spark):
    s = spark.createDataFrame([("d", "t", i) for i in (0, 1, 3, 4, 5, 9000)], "dataset string, trajectory_id string, step_index int")
    sp = spark.createDataFrame([("d", "t", 1, 4, True), ("d", "t", 4, 4, True), ("d", "t", 8999, 9001, True), ("d", "u", 0, 9, True)], "dataset string, trajectory_id string, start int, end int, f boolean")
    assert {r.step_index: r.f for r in seq.coverage(s, sp, ["f"]).collect()} == {0: False, 1: True, 3: True, 4: True, 5: False, 9000: True}


def test_resent_steps_count_once(spark):
    df = spark.createDataFrame([("d", "t", 1, "a", 1), ("d", "t", 1, "a", 2), ("d", None, 1, "a", 3), ("d", "t", None, "a", 4)], STEPS + ", row_number long")
    assert seq.steps_once(df).count() == 1


def test_parsers(spark):
    df = spark.createDataFrame([(x,) for x in ["True", "1", " yes ", "t", "", "maybe", None, "no"]], "v string")
    c = F.col("v")
    rows = df.select(parse.bool_or_null(c).alias("a"), parse.bool_known(c).alias("b"), parse.bool_permissive(c).alias("p"), parse.bool_strict(c).alias("s")).collect()
    assert [r.a for r in rows] == [True, True, True, True, None, None, None, False]
    assert [r.p for r in rows] == [True, True, True, True, False, True, False, False]
    assert [r.s for r in rows] == [True, True, True, False, False, False, False, False]
    n = spark.createDataFrame([("3.9",), ("x",), (None,), ("-2",), ("1e99",)], "v string").select(parse.lenient_int(c).alias("n")).collect()
    assert [r.n for r in n] == [3, None, None, -2, None]
    f = spark.createDataFrame([('["a", "b"]', "b"), ("a; c|d", None), (None, " e "), ("", ""), ("[broken", None)], "m string, p string")
    got = [r.f for r in f.select(parse.file_list(F.col("m"), F.col("p")).alias("f")).collect()]
    assert got == [["a", "b"], ["a", "c", "d"], ["e"], [], ["[broken"]]


def test_text_functions(spark):
    df = spark.createDataFrame([("  Run 12  of 0xAF\n now ", "KeyError: x 12\nmore", "view src/a.py and b.md, src/a.py")], "a string, e string, f string")
    r = df.select(text.normal(F.col("a")).alias("n"), text.error_signature(F.col("e")).alias("e"), text.file_names(F.col("f")).alias("f"), text.short_hash(F.lit(" ")).alias("h")).first()
    assert (r.n, r.e, r.f, r.h) == ("run <num> of <hex> now", "keyerror: x <num>", ["src/a.py", "b.md"], "")
    s = spark.createDataFrame([("mail a@b.cz token sk-abcdefgh12 /home/me/x",)], "t string").select(text.scrubbed(F.col("t")).alias("s")).first().s
    assert s == "mail <EMAIL> token <TOKEN> <LOCAL_PATH>"
