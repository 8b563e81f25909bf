import random

import shutil

from steploom.operators.joins import spread_join
from steploom.sources import tables


def test_hot_keys_are_split_and_nothing_else_changes(spark):
    r = random.Random(5)
    left = [(r.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(400)]
    right = [("hot", 1), ("hot", 1), ("a", 2), ("c", 3), (None, 4)]
    L, R = spark.createDataFrame(left, "k string, i int"), spark.createDataFrame(right, "k string, v int")
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(str, L.join(R, "k", how).collect()))
        assert sorted(map(str, spread_join(L, R, ["k"], "i", how, rows=20).collect())) == want
        assert sorted(map(str, spread_join(L, R, ["k"], "i", how).collect())) == want
        assert spread_join(L.limit(0), R, ["k"], "i", how).count() == 0


def test_shared_tables_follow_their_sources(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return tables.read_table(spark, str(tmp_path), "t").selectExpr("sum(id) AS s")

    get = lambda: tables.shared_table(spark, str(tmp_path), "sums", ["t"], build).first().s
    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    assert (get(), get(), len(made)) == (10, 10, 1)
    spark.range(6).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert (get(), get(), len(made)) == (15, 15, 2)
    for path, _ in list(tables._SHARED.values()):
        if "/sums-" in path:
            shutil.rmtree(path.removeprefix("file:"))
    assert (get(), len(made)) == (15, 3)


def test_broadcasts_are_counted(spark):
    plan = lambda n: spark.range(10).join(tables.broadcast_if_small(spark.range(n), 100), "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(100) and "broadcast" not in plan(101)
