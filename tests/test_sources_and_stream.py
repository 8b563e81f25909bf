import json

from steploom.sources import readers
from steploom.streaming.guard import guard_stream, observe


def test_csv_with_byte_order_mark_and_candidates(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Traj_ID,step,label,hn,action\nt,1.0,P,yes,"run ""x"",\nnext"\nt,x,odd,,\n', encoding="utf-8")
    rows = readers.normalised_steps(readers.read_csv(spark, str(tmp_path / "a.csv")), "pool").orderBy("step_index").collect()
    assert [(r.trajectory_id, r.step_index, r.label_norm, r.hard_negative) for r in rows] == [("t", None, "odd", None), ("t", 1, "productive", True)]
    assert rows[1].raw_action_text == 'run "x",\nnext'


def test_json_lines_skip_blank_and_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"trajectory_id": "t", "step_index": 2}\n\n{broken\n{"trajectory_id": "t", "step_index": 3}\n')
    df = readers.normalised_steps(readers.read_json_lines(spark, str(tmp_path / "a.jsonl")), "p")
    assert sorted(r.step_index for r in df.collect()) == [2, 3]


def test_packets(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"trajectory_id": "t", "steps": [{"action": "a"}, {"action": "b"}]}))
    assert [(r.position, r.step.action) for r in readers.json_packets(spark, str(tmp_path / "p.json")).orderBy("position").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "p.md").write_text("# Packet\n## Step 1\nAction: ls\nObservation: one\ntwo\n## Step 12\nAction: cat\n")
    rows = readers.markdown_packets(spark, str(tmp_path / "p.md")).orderBy("step_index").collect()
    assert [(r.step_index, r.action, r.observation) for r in rows] == [(1, "ls", "one\ntwo"), (12, "cat", "")]


def test_label_file_choice_and_tables(spark, tmp_path):
    assert readers.best_label_file(["a/old_labels.csv", "a/b/labels.csv", "a/labels.csv", "a/final_labels.csv"], ["final*", "*.csv"]) == "a/final_labels.csv"
    assert readers.best_label_file([], []) is None
    df = spark.createDataFrame([(1, "a|b", ["x"])], "n int, t string, l array<string>")
    readers.write_table(df, str(tmp_path), "t")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 1
    assert "| 1 | a\\|b |" in readers.markdown_table(df.select("n", "t"))
    assert readers.without_private_columns(df.withColumnRenamed("t", "local_path")).columns == ["n", "l"]


def test_lines_are_numbered_and_broken_ones_kept(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": {"z": 2}}\n\n{broken\n[1]\n{"x": 3}\n')
    path = str(tmp_path / "a.jsonl")
    assert [(r.row_number, r.value) for r in readers.broken_lines(spark, path).orderBy("row_number").collect()] == [(3, "{broken"), (4, "[1]")]
    assert [(r.row_number, r.x, r.y) for r in readers.json_records(spark, path, ["x", "y"]).orderBy("row_number").collect()] == [(1, "1", '{"z":2}'), (5, "3", None)]
    (tmp_path / "b.txt").write_text("".join(f"line {i}\n" for i in range(1, 3001)))
    rows = readers.numbered_lines(spark, str(tmp_path / "b.txt")).collect()
    assert len(rows) == 3000 and all(r.value == f"line {r.row_number}" for r in rows)


def test_spans_pools_and_cache(spark, tmp_path):
    (tmp_path / "s.csv").write_text("trajectory_id,span_id,start_step,end_step,span_label,hn,confidence\nt,1,2.0,5,UC,yes,0.5\nt,2,x,,,,\n")
    rows = readers.normalised_spans(readers.read_csv(spark, str(tmp_path / "s.csv")), "p").orderBy("span_id").collect()
    got = [(r.start_step_index, r.end_step_index, r.span_label_norm, r.hard_negative, r.unproductive_cycle_flag, r.confidence) for r in rows]
    assert got == [(2, 5, "unproductive_cycle", True, True, 0.5), (None, None, None, None, False, None)]
    for pool, name in (("a", "final_labels.csv"), ("b", "x/labels.csv"), ("c", "notes.txt")):
        (tmp_path / pool / "x").mkdir(parents=True)
        (tmp_path / pool / name).write_text(f"trajectory_id,step,label\n{pool},1,P\n")
    found = [f.rsplit("/", 1)[1] for f in readers.discovered(spark, str(tmp_path), ["final*", "*.csv"])]
    assert found[0] == "final_labels.csv" and sorted(found) == ["final_labels.csv", "labels.csv", "s.csv"]
    pools = {p: ("role", str(tmp_path / p)) for p in "abc"}
    build = lambda: readers.loaded_pools(spark, pools, ["final*", "*.csv"])
    assert {(r.dataset, r.trajectory_id) for r in build().collect()} == {("a", "a"), ("b", "b")}
    assert readers.loaded_pools(spark, {}, []).count() == 0
    kept = readers.cached(spark, str(tmp_path / "kept.parquet"), build)
    assert kept.count() == 2 and readers.cached(spark, str(tmp_path / "kept.parquet"), lambda: 1 / 0).count() == 2


def test_review_records_fill_steps(spark):
    review = spark.createDataFrame([("t", "1", "seen", None), ("t", "1", "seen", "n"), ("t", None, "x", None)], "pilot_id string, step_id string, evidence_note string, notes string")
    records = readers.review_records(review, "p")
    steps = spark.createDataFrame([("p", "t", 1, " "), ("p", "t", 2, "own")], "dataset string, trajectory_id string, step_index int, evidence_fields string")
    got = {r.step_index: r for r in readers.enriched(steps, records).collect()}
    assert '"evidence_note":"seen"' in got[1].evidence_fields and got[2].evidence_fields == "own" and got[1].signal_fields is None and len(got) == 2
    assert readers.enriched(steps, records.limit(0)).count() == 2


def test_reports_and_checks(spark, tmp_path):
    import pytest

    from steploom.functions.parse import recovered_json
    from steploom.operators import release

    df = spark.createDataFrame([("a_b", 0.12345, 3)], "name string, value double, n int")
    tex = readers.latex_table(df, "All & more", "My table")
    assert "a\\_b & 0.123 & 3 \\\\" in tex and "tab:my_table" in tex
    readers.append_csv(df, str(tmp_path / "c"))
    readers.append_csv(df, str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c")).count() == 2
    checked = {r.name: r.passed for r in release.within_tolerance(df, {"a_b": 0.124, "zz": 1.0}).collect()}
    assert checked == {"a_b": True, "zz": False}
    assert release.exactly_one(df, df.n == 3).name == "a_b"
    with pytest.raises(ValueError):
        release.exactly_one(df, df.n == 4)
    with pytest.raises(ValueError):
        release.one_to_one(df, df.union(df), ["name"])
    cell = df.select(release.count_and_rate(df.n, df.value).alias("c"))
    assert cell.select("c", release.count_of(cell.c), release.rate_of(cell.c)).first()[:] == ("3 (0.123)", 3, 0.123)
    texts = spark.createDataFrame([(' {"a": 1} ',), ('so:\n```json\n{"a": 1}\n```',), ('it is {"a": {"b": 1}} now',), ("{a: 1}",), ("",), (None,), ('{"a": 1} and more',), ('{"a": 1}, {"b": 2}',)], "t string")
    assert [r[0] for r in texts.select(recovered_json(texts.t)["way"]).collect()] == ["whole", "fenced", "braces", "none", "none", "none", "braces", "none"]


def test_guard_rules():
    recent, warned, stopped = [], False, False
    events = []
    for target in ["a", "b", "a", "a", "a"]:
        recent, warned, stopped, e = observe(recent, warned, stopped, "WARN_REPLAN_GUARD", [target])
        events.append(e and e[2])
    assert events == [None, None, None, "warn_replan", "guard_trigger_observed"]
    assert observe(["x", "x"], False, False, "HARD_STOP_GUARD", ["x"])[3] == ("x", 3, "hard_stop")
    assert observe([], False, False, "NO_GUARD", [])[0] == ["<no-target>"]


def test_guard_stream_keeps_state_over_batches(spark, tmp_path):
    schema = "run_id string, arm string, step int, targets array<string>"
    src = tmp_path / "in"
    first = spark.createDataFrame([("r", "HARD_STOP_GUARD", 1, ["a"]), ("r", "HARD_STOP_GUARD", 2, ["a"]), ("q", "NO_GUARD", 1, ["z"])], schema)
    second = spark.createDataFrame([("r", "HARD_STOP_GUARD", 3, ["a"]), ("r", "HARD_STOP_GUARD", 4, ["a"]), ("q", "NO_GUARD", 2, [])], schema)
    first.coalesce(1).write.mode("append").parquet(str(src))
    stream = guard_stream(spark.readStream.schema(schema).parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("guarded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.table("guarded").count() == 0
        second.coalesce(1).write.mode("append").parquet(str(src))
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("guarded").collect()] == [("r", "HARD_STOP_GUARD", 3, "a", 3, "hard_stop")]
    finally:
        q.stop()
