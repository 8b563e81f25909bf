from steploom.operators import agreement, detectors, experiments, prefixes


def test_confusion_counts_add_up(spark, data):
    m = {(r.dataset, r.detector, r.config): r for r in detectors.metrics(spark, data).collect()}
    n = {(r.dataset, r.detector, r.config): r.n_triggers for r in detectors.detector_triggers(spark, data).collect()}
    assert all(m[k].n_triggers == n.get(k, 0) for k in m)
    assert all(0 <= r.f1 <= 1 for r in m.values() if r.f1 is not None)
    place = {}
    for r in detectors.trigger_location(spark, data).collect():
        key = (r.dataset, r.detector, r.config)
        place[key] = place.get(key, 0) + r.trigger_count
    assert place == n


def test_empty_tables(spark, data, tmp_path):
    for t in ("enriched_steps", "normalized_spans", "run_log", "api_replan_parsed_responses", "prefix_replan_sample", "documents"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    from steploom.plans.registry import QUERIES

    for name in ("p3_found", "detector_triggers", "detector_metrics", "stop_summary", "missing_indexes", "arm_summary", "label_kappa", "id_overlap", "stratified_sample", "span_matches"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name


def _spans(spark, rows):
    return spark.createDataFrame([("d", "t", i, f"s{i}", a, b, "x") for i, (a, b) in enumerate(rows)], "dataset string, trajectory_id string, row int, id string, start int, end int, label string")


def test_greedy_match_takes_best_overlap_first_and_ties_by_row(spark):
    a, b = _spans(spark, [(0, 9), (100, 109), (300, 303)]), _spans(spark, [(0, 8), (1, 9), (100, 119), (302, 305)])
    got = {(r.a_id, r.b_id): round(r.iou, 3) for r in agreement.match_spans(a, b).collect()}
    assert got == {("s0", "s0"): 0.9, ("s1", "s2"): 0.5}


def test_kappa_of_perfect_and_constant_labels(spark):
    df = spark.createDataFrame([("p", "x", "x"), ("p", "y", "y"), ("c", "x", "x"), ("c", "x", "x")], "g string, a string, b string")
    assert {r.g: r.kappa for r in agreement.kappa(df, ["g"]).collect()} == {"p": 1.0, "c": None}


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([(f"u{i}", float(i % 7), "m") for i in range(60)], "u string, v double, g string")
    r = experiments.bootstrap(df, "u", "v", ["g"], 200).first()
    assert r.low < r.mean < r.high and r.units == 60


def test_sample_is_the_same_on_every_run(spark, data):
    one = [tuple(r) for r in prefixes.stratified_sample(spark, data).orderBy("stratum", "selected_order").collect()]
    assert one == [tuple(r) for r in prefixes.stratified_sample(spark, data).orderBy("stratum", "selected_order").collect()]
