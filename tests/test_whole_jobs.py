"""Queries against counts made here, step by step."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from steploom.functions.text import scrubbed
from steploom.operators import experiments, prefixes
from steploom.operators import sequence as seq
from steploom.operators.detectors import first_triggers


def test_scrubbed_prefixes_are_whole(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(900))
    rows = [("a", long + " end", "x"), ("b", r"at \\wsl.localhost\Ubuntu\me, /workspace/proj/src/a.py and /tmp; https://h.io/p/q", "run " + "o__r-12__train-00000-of-00001__row_7__Ab1")]
    cols = "released_prefix_id string, recent_actions_summary string, recent_observations_summary string"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/prefix_replan_sample.parquet")
    got = {r.released_prefix_id: r for r in prefixes.scrubbed_prefixes(spark, str(tmp_path)).collect()}
    assert got["a"].actions == long + " end"
    assert got["b"].actions == "at <LOCAL_PATH>, <PROJECT_PATH>/proj/src<PROJECT_PATH> and <PROJECT_PATH>; <URL>"
    assert got["b"].observations == "run <TRAJECTORY_ID>"


def test_repetition_counts_take_every_target(spark, data):
    runs = defaultdict(list)
    for r in seq.prepared(spark, data).select("dataset", "trajectory_id", "position", "files", "action_key", "tool_key").orderBy("position").collect():
        runs[r.dataset, r.trajectory_id].append(r)
    want = {}
    for key, steps in runs.items():
        targets, tools, files, again = [], [], 0, 0
        for r in steps:
            for t in r.files or [r.action_key[:120] if r.action_key.strip(" ") else "<empty-action>"]:
                files += t in targets[-5:]
                targets.append(t)
            again += r.tool_key != "" and r.tool_key in tools[-5:]
            tools.append(r.tool_key)
        want[key] = (len(steps), files, again, files / len(steps), again / len(steps))
    got = {(r.dataset, r.trajectory_id): tuple(r)[2:] for r in prefixes.repetition_counts(spark, data).collect()}
    assert got == want


def _interval(values, replicates):
    """The interval by Python's own hashes, one replicate after the other."""
    means = []
    for rep in range(replicates):
        w = [sum(int(hashlib.md5(f"{u}|{rep}".encode()).hexdigest()[:8], 16) / 2**32 >= p for p in experiments.POISSON) for u in values]
        if sum(w):
            means.append(np.dot(w, list(values.values())) / sum(w))
    return tuple(np.quantile(means, [0.025, 0.975]))


def _close(row, values, replicates):
    assert row.units == len(values) and np.allclose((row.low, row.high), _interval(values, replicates), atol=2e-9)


def test_response_effects_take_5000_replicates(spark, data):
    pairs = experiments.arm_pairs(experiments.scored_responses(spark, data)).collect()
    for r in experiments.response_effects(spark, data).collect():
        _close(r, {p.released_prefix_id: p.w[r.metric] - p.n[r.metric] for p in pairs}, 5000)


def test_arm_effects_take_1000_replicates(spark, data):
    runs = {(r.released_task_id, r.arm): r for r in experiments._runs(spark, data).collect()}
    got = experiments.arm_effects(spark, data).collect()
    assert len(got) == 8
    for r in got:
        both = {t: (x[r.metric], runs[t, "NO_GUARD"][r.metric]) for (t, arm), x in runs.items() if arm == r.arm and (t, "NO_GUARD") in runs}
        _close(r, {t: float(a) - float(b) for t, (a, b) in both.items() if a is not None and b is not None}, 1000)


def test_prefixes_of_every_configuration(spark, data):
    fields = ["tool_name", "file_path", "error_signature", "normalized_action_text", "command_text"]
    rows = seq.prepared(spark, data).select("dataset", "trajectory_id", "step_index", "tool_key", "action_key", *[scrubbed(F.col(c)).alias(c) for c in fields]).collect()
    runs = defaultdict(dict)
    for r in rows:
        runs[r.dataset, r.trajectory_id][r.step_index] = r
    recent, patterns, following = [], [], []
    for t in first_triggers(spark, data).collect():
        run, key = runs[t.dataset, t.trajectory_id], (t.dataset, t.trajectory_id, t.detector, t.config, t.step_index)
        last = [run[i] for i in range(t.step_index - 9, t.step_index + 1) if i in run]
        recent += [(*key, r.step_index, r.tool_key, r.action_key) for r in last]
        for f in fields:
            n = Counter(r[f] for r in last[-6:] if r[f])
            if n and max(n.values()) >= 2:
                times, value = max((c, v) for v, c in n.items())
                patterns.append((*key, f, value, times))
        if t.step_index + 1 in run:
            following.append((*key, run[t.step_index + 1].action_key))
    for query, want in ((prefixes.recent_steps, recent), (prefixes.repeated_patterns, patterns), (prefixes.next_actions, following)):
        assert want and sorted(map(tuple, query(spark, data).collect())) == sorted(want)


def test_guard_twin_agrees_with_the_stream_step_by_step(spark, data):
    from steploom.streaming.guard import observe

    runs = defaultdict(list)
    for r in seq.prepared(spark, data).select("dataset", "trajectory_id", "step_index", "position", "files", "action_key").orderBy("position").collect():
        runs[r.dataset, r.trajectory_id].append(r)
    want = set()
    for key, steps in runs.items():
        recent = []
        for r in steps:
            targets = r.files or [r.action_key[:120] if r.action_key.strip(" ") else "<empty-action>"]
            recent, _, _, event = observe(recent, False, False, "NO_GUARD", targets)
            if event:
                want.add((*key, r.step_index, event[0], event[1]))
    assert want and {tuple(r) for r in prefixes.guard_events(spark, data).collect()} == want
