"""Detectors over step sequences, and how well and where they fire."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.operators import sequence as seq
from steploom.operators.sequence import KEYS, PREPARED_SQL, prepared
from steploom.sources.tables import checkpointed, read_table, shared_table, written

# The reference's configurations.
STEP_CAPS = (25, 50, 75, 100, 150, 200)
SIMILARITIES = (0.90, 0.95, 0.98)
VOCABULARY = 20_000
NEAR_F1 = 0.02
#: Steps of one bucket in the join of spans with the steps they hold.
BUCKET = 64


@dataclass(frozen=True)
class Config:
    """One detector setting: its Spark condition and its SQL condition over the feature columns."""

    detector: str
    config: str
    family: str
    spark: str
    sql: str
    uses_signal: bool = False
    progress_aware: bool = False


def _repeat_sql(key: str, k: int) -> str:
    w = "OVER (PARTITION BY dataset, trajectory_id ORDER BY position)"
    return f"({key} <> ''" + "".join(f" AND coalesce(lag({key}, {j}) {w} = {key}, false)" for j in range(1, k)) + ")"


def _sequence_sql(key: str, width: int) -> str:
    w = "OVER (PARTITION BY dataset, trajectory_id ORDER BY position)"
    at = lambda j: f"lag({key}, {j}) {w}" if j else key
    return "(" + " AND ".join(f"coalesce({at(j)} = {at(j + width)} AND {at(j + width)} <> '', false)" for j in range(width)) + ")"


_RUNTIME = "new_file OR (error_key <> '' AND error_key <> prev_error) OR (obs_key <> '' AND obs_key <> prev_obs) OR (kind_key <> '' AND prev_kind <> '' AND kind_key <> prev_kind)"
_SIGNAL = "coalesce(p_score >= 2, false) OR coalesce(n_score >= 1, false)"


def configurations() -> list[Config]:
    out = [Config("max_step_guard", f"threshold={t}", "max_step_guard", f"position >= {t}", f"position >= {t}") for t in STEP_CAPS]
    for name, key, ks in (("exact_action_repeat_k", "action_key", (2, 3, 4)), ("tool_repeat_k", "tool_key", (2, 3, 4))):
        out += [Config(name, f"k={k}", name, f"rep_{key}_{k}", f"rep_{key}_{k}") for k in ks]
    out += [Config("tool_sequence_repeat", f"window={w}", "tool_sequence_repeat", f"seq_tool_{w}", f"seq_tool_{w}") for w in (2, 3, 4)]
    out.append(Config("action_observation_repeat_exact", "exact_pair_k=2", "action_observation_repeat", "rep_action_obs_key_2", "rep_action_obs_key_2"))
    out += [
        Config("action_observation_similarity", f"tfidf_adjacent>={t}", "action_observation_similarity", f"coalesce(similarity >= {t}, false)", f"coalesce(similarity >= {t}, false)")
        for t in SIMILARITIES
    ]
    out += [Config("error_signature_repeat_k", f"k={k}", "error_signature_repeat_k", f"rep_error_key_{k}", f"rep_error_key_{k}") for k in (2, 3)]
    out += [
        Config("file_revisit_guard", f"window={w};repeats={r}", "file_revisit_guard", f"seen_{w} >= {r}", f"seen_{w} >= {r}") for w in (5, 10) for r in (3, 5)
    ]
    for signal in (False, True):
        progress = f"({_RUNTIME} OR {_SIGNAL})" if signal else f"({_RUNTIME})"
        for base, key in (("exact_action", "action_key"), ("tool", "tool_key")):
            c = f"rep_{key}_3 AND NOT {progress}"
            name = f"base={base};k=3;progress=" + ("runtime_or_signal_proxy" if signal else "runtime")
            out.append(Config("repeat_without_progress_guard", name, "repeat_without_progress_guard", c, c, signal, True))
    return out


CONFIGS = configurations()
_REPEATS = [("action_key", (2, 3, 4)), ("tool_key", (2, 3, 4)), ("action_obs_key", (2,)), ("error_key", (2, 3))]


def terms_of(text: Column) -> Column:
    """The terms of a step's text: runs of two or more letters, digits or _."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def similarity(rows: DataFrame, positions: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """(dataset, trajectory_id, position, similarity): TF-IDF cosine of a step's terms with the step before.

    `rows` has KEYS, step_index and terms, `positions` KEYS, step_index and position. idf = ln((1 + rows) /
    (1 + df)) + 1 over all rows; the `vocabulary` most frequent terms count (ties by the term), vectors have
    length 1. A step without terms, or whose predecessor has none, has no row. `rows` is read several times.
    """
    all_ = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("all_tf"))
    held = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = rows.count()
    # At most `vocabulary` words, so every executor can hold them.
    words = all_.join(held, "term").orderBy(F.desc("all_tf"), "term").limit(vocabulary).select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    idf = {r.term: r.idf for r in words.collect()}
    vectors = rows.select(*KEYS, "step_index", "terms").mapInArrow(_weighed(rows.sparkSession.sparkContext.broadcast(idf)), "dataset string, trajectory_id string, step_index int, ids array<int>, w array<double>")
    # Only the vectors are shuffled, never the texts.
    vectors = vectors.join(positions.select(*KEYS, "step_index", "position"), [*KEYS, "step_index"])
    w = seq.over_block()
    before = [F.lag(c).over(w).alias(f"p_{c}") for c in ("position", "ids", "w")]
    paired = seq.with_halo(vectors, halo=1).select(*KEYS, "position", "own", "ids", "w", *before)
    near = paired.where(F.col("own") & (F.col("p_position") == F.col("position") - 1) & (F.size("ids") > 0) & (F.size("p_ids") > 0))
    return near.select(*KEYS, "position", "ids", "w", "p_ids", "p_w").mapInArrow(_cosines, "dataset string, trajectory_id string, position bigint, similarity double")


def _weighed(shared):
    """The terms of a step as numbers in order, each once, with weights of length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        number = {t: i for i, t in enumerate(idf)}
        weight = np.array([*idf.values(), 0.0])
        for batch in batches:
            lists = batch.column(3)
            coded = lists.flatten().dictionary_encode()
            ids = np.array([number.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            key, tf = np.unique((row * (len(idf) + 1) + ids)[ids >= 0], return_counts=True)
            row, ids = np.divmod(key, len(idf) + 1)
            w = tf * weight[ids]
            w = w / np.sqrt(np.bincount(row, w * w, minlength=len(lists)))[row]
            offsets = pa.array(np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ids.astype(np.int32), w)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["dataset", "trajectory_id", "step_index", "ids", "w"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of each row's two vectors."""
    for batch in batches:
        sides = []
        for ids, w in ((3, 4), (5, 6)):
            row = np.repeat(np.arange(batch.num_rows), batch.column(ids).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            sides.append((row << 32 | batch.column(ids).flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(w).flatten().to_numpy(zero_copy_only=False)))
        (a, wa), (b, wb) = sides
        at = np.minimum(np.searchsorted(b, a), len(b) - 1) if len(b) else np.zeros(0, np.int64)
        same = b[at] == a if len(b) else np.zeros(0, bool)
        dot = np.bincount(a[same] >> 32, wa[same] * wb[at[same]], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dot)], ["dataset", "trajectory_id", "position", "similarity"])


def features(steps: DataFrame, terms: DataFrame) -> DataFrame:
    """The prepared steps with all columns the configurations ask for. `terms`: KEYS, step_index, terms of each step."""
    haloed = seq.with_halo(steps)
    files = seq.file_features(haloed, (5, 10))
    prev = seq.earlier_filled(haloed, ["error_key", "obs_key", "kind_key"])
    names = {"prev_error_key": "prev_error", "prev_obs_key": "prev_obs", "prev_kind_key": "prev_kind"}
    wide = prev.select(
        "*",
        *[seq.repeated(key, k).alias(f"rep_{key}_{k}") for key, ks in _REPEATS for k in ks],
        *[seq.sequence_repeated("tool_key", w).alias(f"seq_tool_{w}") for w in (2, 3, 4)],
    ).where("own")
    for old, new in names.items():
        wide = wide.withColumn(new, F.coalesce(old, F.lit("")))
    return (
        wide.join(files, [*KEYS, "position"], "left")
        .join(similarity(terms, steps), [*KEYS, "position"], "left")
        .na.fill({"seen_5": 0, "seen_10": 0, "new_file": False})
    )


def with_triggers(feature: DataFrame) -> DataFrame:
    """Adds `fired`: the numbers of the configurations that fire at the step."""
    marks = [F.when(F.expr(c.spark), F.lit(i)) for i, c in enumerate(CONFIGS)]
    fired = F.filter(F.array(*marks), lambda x: x.isNotNull())
    return feature.select(*KEYS, "step_index", "position", "in_pi", "in_uc", "in_hn", "in_uncertain", fired.alias("fired"))


#: What flags are made of, and the keys the settings compare.
_OWN = [
    "span_label_norm", "hard_negative", "productive_iteration_flag", "unproductive_cycle_flag", "uncertain_flag", "unresolved_flag", "files", "p_score", "n_score", "kind_key",
    "tool_key", "obs_key",
]


def triggered(spark, folder: str) -> DataFrame:
    """The steps with the settings that fire: a table made once for all queries, as long as its sources stay."""

    def build() -> DataFrame:
        raw = read_table(spark, folder, "enriched_steps", *[c for c in seq.COLUMNS if c != "row_number"])
        raw = raw.where(F.col("trajectory_id").isNotNull() & F.col("step_index").isNotNull()).withColumn("dataset", F.coalesce("dataset", F.lit("")))
        # Texts become terms and hashes where they are read; they are shuffled once, to count re-sent steps once.
        hashed = [seq.short_hash(F.col(c)).alias(c) for c in ("action_key", "action_obs_key", "error_key")]
        text = F.lower(F.trim(F.concat_ws(" ", "action_key", seq.normal(F.col("obs_text")))))
        k = seq.keyed(raw).select(*KEYS, "step_index", *_OWN, *hashed, text.alias("text"))
        once = k.dropDuplicates([*KEYS, "step_index"])
        base = written(once.withColumn("terms", terms_of(F.col("text"))).drop("text"), "keyed_steps")
        steps = seq.flagged(seq.positioned(base.drop("terms")), read_table(spark, folder, "normalized_spans"))
        drop = ["span_label_norm", "hard_negative", "productive_iteration_flag", "unproductive_cycle_flag", "uncertain_flag", "unresolved_flag"]
        return with_triggers(features(written(steps.drop(*drop), "flagged_steps"), base))

    return shared_table(spark, folder, "triggers", ["enriched_steps", "normalized_spans"], build)


def config_table(spark) -> DataFrame:
    rows = [(i, c.detector, c.config, c.family, c.uses_signal, c.progress_aware) for i, c in enumerate(CONFIGS)]
    return spark.createDataFrame(rows, "cfg int, detector string, config string, family string, uses_signal boolean, progress_aware boolean")


def _fired(t: DataFrame, *columns: str) -> DataFrame:
    return t.select(*KEYS, "step_index", "position", *columns, F.explode("fired").alias("cfg"))


def _named(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(config_table(df.sparkSession)), "cfg").drop("cfg")


def detector_triggers(spark, folder: str) -> DataFrame:
    """Triggers and trajectories with a trigger, per pool and configuration."""
    t = _fired(triggered(spark, folder))
    by_traj = t.groupBy("dataset", "cfg", "trajectory_id").agg(F.count(F.lit(1)).alias("n"))
    out = by_traj.groupBy("dataset", "cfg").agg(F.sum("n").alias("n_triggers"), F.count(F.lit(1)).alias("n_trajectories"))
    return _named(out).select("dataset", "detector", "config", "n_triggers", "n_trajectories")


def first_triggers(spark, folder: str) -> DataFrame:
    """The first trigger of each configuration in each trajectory."""
    t = _fired(triggered(spark, folder))
    first = t.groupBy(*KEYS, "cfg").agg(F.min(F.struct("position", "step_index")).alias("f"))
    return _named(first.select(*KEYS, "cfg", "f.position", "f.step_index")).select(*KEYS, "detector", "config", "step_index", "position")


def location(uncertain: bool) -> Column:
    out = F.when(F.col("in_uc"), "UC" if uncertain else "UC_span").when(F.col("in_hn"), "HN" if uncertain else "HN_step")
    out = out.when(F.col("in_pi"), "PI" if uncertain else "PI_span_non_HN")
    return (out.when(F.col("in_uncertain"), "uncertain") if uncertain else out).otherwise("other")


def trigger_location(spark, folder: str) -> DataFrame:
    """Triggers per place (UC before HN before PI before other); places without triggers have a row of 0."""
    t = _fired(triggered(spark, folder), "in_uc", "in_hn", "in_pi", "in_uncertain")
    places = ["UC_span", "HN_step", "PI_span_non_HN", "other"]
    counts = t.groupBy("dataset", "cfg").agg(
        F.count(F.lit(1)).alias("total"), *[F.sum(F.when(location(False) == p, 1).otherwise(0)).alias(p) for p in places]
    )
    each = counts.select(
        "dataset", "cfg", "total", F.explode(F.array(*[F.struct(F.lit(p).alias("location_category"), F.col(p).alias("trigger_count")) for p in places])).alias("x")
    )
    out = each.select("dataset", "cfg", "x.location_category", "x.trigger_count", (F.col("x.trigger_count") / F.col("total")).alias("trigger_pct"))
    return _named(out).select("dataset", "detector", "config", "location_category", "trigger_count", "trigger_pct")


def eval_spans(spans: DataFrame, trajectories: DataFrame) -> DataFrame:
    """UC and PI spans by label only, of trajectories that have steps."""
    return (
        seq.ordered_spans(spans)
        .where(F.col("label").isin("unproductive_cycle", "productive_iteration"))
        .select(*KEYS, "span_id", "start", "end", "label")
        .distinct()
        .join(trajectories, KEYS, "left_semi")
    )


def span_hits(t: DataFrame, spans: DataFrame) -> DataFrame:
    """Per span: first present position and, per configuration, first position that fires inside.

    Spans and steps meet in buckets of step indexes, so a long trajectory is many groups.
    """
    bucket = lambda c: F.floor(c / BUCKET)
    keys = [*KEYS, "span_id", "start", "end", "label"]
    cut = spans.select("*", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("bk"))
    steps = t.select(*KEYS, "step_index", "position", "fired", bucket(F.col("step_index")).alias("bk"))
    held = cut.join(steps, [*KEYS, "bk"]).where(F.col("step_index").between(F.col("start"), F.col("end")))
    firsts = [F.min(F.when(F.array_contains("fired", i), F.col("position"))).alias(f"f{i}") for i in range(len(CONFIGS))]
    return held.groupBy(*keys).agg(F.min("position").alias("first_position"), *firsts)


def metrics(spark, folder: str) -> DataFrame:
    """F1, UC recall, PI interruption, HN false positives, burden and latencies, per pool and configuration.

    A ratio with denominator 0 is null. Spans that hold no step count in the denominators. Latency is
    the distance in positions from a UC span's first present step to the first trigger inside.
    """
    t = triggered(spark, folder)
    n = len(CONFIGS)
    hit = lambda i: F.array_contains("fired", i)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per = t.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("eligible"), one(F.col("in_uc")).alias("uc"), one(F.col("in_hn")).alias("hn"),
        F.array(*[F.struct(F.lit(i).alias("cfg"), one(hit(i) & F.col("in_uc")).alias("tp"), one(hit(i)).alias("fired"), one(hit(i) & F.col("in_hn")).alias("hn_fired")) for i in range(n)]).alias("x"),
    )
    steps = per.select("dataset", "eligible", "uc", "hn", F.explode("x").alias("x")).select("dataset", "eligible", "uc", "hn", "x.*")
    spans = eval_spans(read_table(spark, folder, "normalized_spans"), t.select(*KEYS).distinct())
    totals = spans.groupBy("dataset").agg(
        one(F.col("label") == "unproductive_cycle").alias("uc_total"), one(F.col("label") == "productive_iteration").alias("pi_total")
    )
    hits = span_hits(t, spans).select(
        "dataset", "label", "first_position", F.explode(F.array(*[F.struct(F.lit(i).alias("cfg"), F.col(f"f{i}").alias("at")) for i in range(n)])).alias("h")
    ).where(F.col("h.at").isNotNull())
    uc = F.col("label") == "unproductive_cycle"
    delay = F.when(uc, F.col("h.at") - F.col("first_position"))
    found = hits.groupBy("dataset", F.col("h.cfg").alias("cfg")).agg(
        one(uc).alias("uc_recalled"), one(~uc).alias("pi_hit"), F.avg(delay).alias("latency_mean"),
        F.percentile(delay, 0.5).alias("latency_median"), F.percentile(delay, 0.9).alias("latency_p90"),
    )
    all_ = steps.join(F.broadcast(totals), "dataset", "left").join(F.broadcast(found), ["dataset", "cfg"], "left").na.fill(0, ["uc_total", "pi_total", "uc_recalled", "pi_hit"])
    div = lambda a, b: F.when(b != 0, a / b)
    tp, fired, ucs = F.col("tp"), F.col("fired"), F.col("uc")
    return _named(
        all_.select(
            "dataset", "cfg",
            div(2 * tp, fired + ucs).alias("f1"),  # 2tp + fp + fn = fired + positives
            div(F.col("uc_recalled"), F.col("uc_total")).alias("uc_recall"),
            div(F.col("pi_hit"), F.col("pi_total")).alias("piir"),
            div(F.col("hn_fired"), F.col("hn")).alias("hn_fpr"),
            div(fired, F.col("eligible")).alias("burden"),
            "latency_mean", "latency_median", "latency_p90", fired.alias("n_triggers"),
        )
    ).drop("family", "uses_signal", "progress_aware")


def near_f1_pairs(spark, folder: str) -> DataFrame:
    """Pairs of configurations of a pool whose F1 differ by at most 0.02, with their differences in risk.

    The configurations are a fixed list, so the pairs of a pool are bounded.
    """
    order = config_table(spark).select("cfg", "detector", "config")
    m = checkpointed(metrics(spark, folder).join(F.broadcast(order), ["detector", "config"]).where("f1 IS NOT NULL"))
    cols = ["cfg", "detector", "config", "f1", "piir", "hn_fpr", "burden"]
    a = m.select("dataset", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = m.select("dataset", *[F.col(c).alias(f"{c}_b") for c in cols])
    diff = F.abs(F.col("f1_a") - F.col("f1_b"))
    return (
        a.join(b, "dataset")
        .where((F.col("cfg_a") < F.col("cfg_b")) & (diff <= NEAR_F1))
        .select(
            "dataset", "detector_a", "config_a", "detector_b", "config_b", diff.alias("abs_f1_diff"), (diff <= 0.01).alias("within_0_01"),
            F.abs(F.col("piir_a") - F.col("piir_b")).alias("abs_piir_diff"), F.abs(F.col("hn_fpr_a") - F.col("hn_fpr_b")).alias("abs_hn_fpr_diff"),
            F.abs(F.col("burden_a") - F.col("burden_b")).alias("abs_burden_diff"),
        )
    )


def best_and_worst(spark, folder: str) -> DataFrame:
    """Per pool: the best and worst configuration by F1 - 0.5 PIIR - 0.5 HN-FPR (nulls count as 0)."""
    m = metrics(spark, folder)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.round(zero(F.col("f1")) - 0.5 * zero(F.col("piir")) - 0.5 * zero(F.col("hn_fpr")), 9)
    name = F.concat_ws(" ", "detector", "config")
    x = m.select("dataset", score.alias("score"), name.alias("name"))
    return x.groupBy("dataset").agg(
        F.max(F.struct("score", "name")).alias("b"), F.min(F.struct("score", "name")).alias("w")
    ).select("dataset", F.col("b.name").alias("best"), F.col("b.score").alias("best_score"), F.col("w.name").alias("worst"), F.col("w.score").alias("worst_score"))


def availability(spark, folder: str) -> DataFrame:
    """Per pool and detector family: rows with the fields it needs."""
    s = prepared(spark, folder)
    rows = lambda c: F.sum(F.when(c, 1).otherwise(0))
    has = lambda c: F.trim(c) != ""
    files = F.size("files") > 0
    counts = {
        "max_step_guard": F.count(F.lit(1)),
        "exact_action_repeat_k": rows(has("action_key")),
        "tool_repeat_k": rows(has("tool_key")),
        "tool_sequence_repeat": rows(has("tool_key")),
        "action_observation_repeat": rows(has("action_obs_key")),
        "action_observation_similarity": rows(has("action_key") & has("obs_text")),
        "error_signature_repeat_k": rows(has("error_key")),
        "file_revisit_guard": rows(files),
        "repeat_without_progress_guard": F.least(
            rows(has("action_key") | has("tool_key")),
            rows(files | has("error_key") | has("obs_key") | F.coalesce(has("signal_fields"), F.lit(False))),
        ),
    }
    wide = s.groupBy("dataset").agg(F.count(F.lit(1)).alias("total_rows"), *[c.alias(k) for k, c in counts.items()])
    return wide.select(
        "dataset", "total_rows", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(k).alias("n")) for k in counts])).alias("x")
    ).select("dataset", F.col("x.f").alias("detector_family"), F.col("x.n").alias("eligible_rows"), "total_rows", (F.col("x.n") > 0).alias("available"))


# ---------------------------------------------------------------- SQL twins

_W = "OVER (PARTITION BY dataset, trajectory_id ORDER BY position)"
_BACK = "OVER (PARTITION BY dataset, trajectory_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_TEXT = f"trim(concat_ws(' ', action_key, {seq.norm_sql('obs_text')}))"

FEATURES_SQL = PREPARED_SQL + rf""",
fs AS (SELECT dataset, trajectory_id, position, unnest(files) AS file FROM steps),
fc AS (SELECT *, count(*) OVER (PARTITION BY dataset, trajectory_id, file ORDER BY position RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5,
    count(*) OVER (PARTITION BY dataset, trajectory_id, file ORDER BY position RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10,
    position = min(position) OVER (PARTITION BY dataset, trajectory_id, file) AS fresh FROM fs),
ff AS (SELECT dataset, trajectory_id, position, max(c5) AS seen_5, max(c10) AS seen_10, bool_or(fresh) AS new_file FROM fc GROUP BY 1, 2, 3),
tx AS (SELECT dataset, trajectory_id, position, unnest(regexp_extract_all(lower({_TEXT}), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM steps),
tc AS (SELECT dataset, trajectory_id, position, term, count(*) AS tf FROM tx GROUP BY 1, 2, 3, 4),
vo AS (SELECT term, ln((1.0 + (SELECT count(*) FROM steps)) / (1.0 + count(*))) + 1.0 AS idf FROM tc GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {VOCABULARY}),
tw AS (SELECT tc.*, tf * idf AS w FROM tc JOIN vo USING (term)),
nm AS (SELECT dataset, trajectory_id, position, sqrt(sum(w * w)) AS norm FROM tw GROUP BY 1, 2, 3),
dt AS (SELECT a.dataset, a.trajectory_id, a.position, sum(a.w * b.w) AS dot FROM tw a JOIN tw b
    ON a.dataset = b.dataset AND a.trajectory_id = b.trajectory_id AND a.position = b.position + 1 AND a.term = b.term GROUP BY 1, 2, 3),
sm AS (SELECT a.dataset, a.trajectory_id, a.position, coalesce(dot, 0) / (a.norm * b.norm) AS similarity FROM nm a JOIN nm b
    ON a.dataset = b.dataset AND a.trajectory_id = b.trajectory_id AND a.position = b.position + 1
    LEFT JOIN dt ON dt.dataset = a.dataset AND dt.trajectory_id = a.trajectory_id AND dt.position = a.position),
feat AS (
  SELECT s.*, coalesce(seen_5, 0) AS seen_5, coalesce(seen_10, 0) AS seen_10, coalesce(new_file, false) AS new_file, similarity,
    coalesce(last_value(nullif(error_key, '') IGNORE NULLS) {_BACK.replace('dataset', 's.dataset').replace('trajectory_id', 's.trajectory_id').replace('position', 's.position')}, '') AS prev_error,
    coalesce(last_value(nullif(obs_key, '') IGNORE NULLS) {_BACK.replace('dataset', 's.dataset').replace('trajectory_id', 's.trajectory_id').replace('position', 's.position')}, '') AS prev_obs,
    coalesce(last_value(nullif(kind_key, '') IGNORE NULLS) {_BACK.replace('dataset', 's.dataset').replace('trajectory_id', 's.trajectory_id').replace('position', 's.position')}, '') AS prev_kind
  FROM steps s LEFT JOIN ff ON ff.dataset = s.dataset AND ff.trajectory_id = s.trajectory_id AND ff.position = s.position
    LEFT JOIN sm ON sm.dataset = s.dataset AND sm.trajectory_id = s.trajectory_id AND sm.position = s.position),
rep AS (SELECT *, {', '.join(f'{_repeat_sql(key, k)} AS rep_{key}_{k}' for key, ks in _REPEATS for k in ks)},
    {', '.join(f"{_sequence_sql('tool_key', w)} AS seq_tool_{w}" for w in (2, 3, 4))} FROM feat),
trig AS ({' UNION ALL '.join(f"SELECT dataset, trajectory_id, step_index, position, in_pi, in_uc, in_hn, in_uncertain, {i} AS cfg, '{c.detector}' AS detector, '{c.config}' AS config FROM rep WHERE {c.sql}" for i, c in enumerate(CONFIGS))}),
cfgs AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c.detector}', '{c.config}')" for i, c in enumerate(CONFIGS))}) v(cfg, detector, config))
"""

DETECTOR_TRIGGERS_SQL = FEATURES_SQL + "SELECT dataset, detector, config, count(*) AS n_triggers, count(DISTINCT trajectory_id) AS n_trajectories FROM trig GROUP BY 1, 2, 3"
FIRST_TRIGGERS_SQL = FEATURES_SQL + """SELECT dataset, trajectory_id, detector, config, step_index, position FROM trig
QUALIFY row_number() OVER (PARTITION BY dataset, trajectory_id, cfg ORDER BY position) = 1"""
TRIGGER_LOCATION_SQL = FEATURES_SQL + """,
loc AS (SELECT dataset, detector, config, CASE WHEN in_uc THEN 'UC_span' WHEN in_hn THEN 'HN_step' WHEN in_pi THEN 'PI_span_non_HN' ELSE 'other' END AS l FROM trig),
tot AS (SELECT dataset, detector, config, count(*) AS n FROM loc GROUP BY 1, 2, 3)
SELECT t.dataset, t.detector, t.config, p.l AS location_category, count(loc.l) AS trigger_count, count(loc.l) / t.n AS trigger_pct
FROM tot t CROSS JOIN (VALUES ('UC_span'), ('HN_step'), ('PI_span_non_HN'), ('other')) p(l)
LEFT JOIN loc ON loc.dataset = t.dataset AND loc.detector = t.detector AND loc.config = t.config AND loc.l = p.l
GROUP BY t.dataset, t.detector, t.config, p.l, t.n"""

METRICS_CTE = FEATURES_SQL + """,
es AS (SELECT DISTINCT dataset, trajectory_id, span_id, a, b, label FROM sp WHERE label IN ('unproductive_cycle', 'productive_iteration')
  AND (dataset, trajectory_id) IN (SELECT DISTINCT (dataset, trajectory_id) FROM steps)),
tots AS (SELECT dataset, count(*) FILTER (label = 'unproductive_cycle') AS uc_total, count(*) FILTER (label = 'productive_iteration') AS pi_total FROM es GROUP BY 1),
fp AS (SELECT es.*, min(position) AS first_position FROM es JOIN steps s ON s.dataset = es.dataset AND s.trajectory_id = es.trajectory_id
  AND s.step_index BETWEEN es.a AND es.b GROUP BY ALL),
hits AS (SELECT fp.dataset, fp.trajectory_id, fp.span_id, fp.a, fp.b, fp.label, first_position, cfg, min(position) AS hit_at FROM fp JOIN trig t
  ON t.dataset = fp.dataset AND t.trajectory_id = fp.trajectory_id AND t.step_index BETWEEN fp.a AND fp.b GROUP BY ALL),
found AS (SELECT dataset, cfg, count(*) FILTER (label = 'unproductive_cycle') AS uc_recalled, count(*) FILTER (label = 'productive_iteration') AS pi_hit,
  avg(hit_at - first_position) FILTER (label = 'unproductive_cycle') AS latency_mean,
  quantile_cont(hit_at - first_position, 0.5) FILTER (label = 'unproductive_cycle') AS latency_median,
  quantile_cont(hit_at - first_position, 0.9) FILTER (label = 'unproductive_cycle') AS latency_p90 FROM hits GROUP BY 1, 2),
pool AS (SELECT dataset, count(*) AS eligible, count(*) FILTER (in_uc) AS uc, count(*) FILTER (in_hn) AS hn FROM steps GROUP BY 1),
firec AS (SELECT dataset, cfg, count(*) AS fired, count(*) FILTER (in_uc) AS tp, count(*) FILTER (in_hn) AS hn_fired FROM trig GROUP BY 1, 2),
met AS (
  SELECT p.dataset, c.cfg, c.detector, c.config,
    CASE WHEN coalesce(fired, 0) + uc <> 0 THEN 2.0::DOUBLE * coalesce(tp, 0) / (coalesce(fired, 0) + uc) END AS f1,
    CASE WHEN coalesce(uc_total, 0) <> 0 THEN coalesce(uc_recalled, 0) / uc_total END AS uc_recall,
    CASE WHEN coalesce(pi_total, 0) <> 0 THEN coalesce(pi_hit, 0) / pi_total END AS piir,
    CASE WHEN hn <> 0 THEN coalesce(hn_fired, 0) / hn END AS hn_fpr,
    coalesce(fired, 0) / eligible AS burden, latency_mean, latency_median, latency_p90, coalesce(fired, 0) AS n_triggers
  FROM pool p CROSS JOIN cfgs c LEFT JOIN firec f ON f.dataset = p.dataset AND f.cfg = c.cfg
  LEFT JOIN tots ON tots.dataset = p.dataset LEFT JOIN found ON found.dataset = p.dataset AND found.cfg = c.cfg)
"""
METRICS_SQL = METRICS_CTE + "SELECT * EXCLUDE (cfg) FROM met"
NEAR_F1_PAIRS_SQL = METRICS_CTE + """SELECT a.dataset, a.detector AS detector_a, a.config AS config_a, b.detector AS detector_b, b.config AS config_b,
  abs(a.f1 - b.f1) AS abs_f1_diff, abs(a.f1 - b.f1) <= 0.01 AS within_0_01, abs(a.piir - b.piir) AS abs_piir_diff, abs(a.hn_fpr - b.hn_fpr) AS abs_hn_fpr_diff,
  abs(a.burden - b.burden) AS abs_burden_diff
FROM met a JOIN met b ON a.dataset = b.dataset AND a.cfg < b.cfg AND abs(a.f1 - b.f1) <= 0.02"""
BEST_AND_WORST_SQL = METRICS_CTE + """,
sc AS (SELECT dataset, round(coalesce(f1, 0) - 0.5 * coalesce(piir, 0) - 0.5 * coalesce(hn_fpr, 0), 9) AS score, detector || ' ' || config AS name FROM met)
SELECT DISTINCT dataset, first_value(name) OVER (PARTITION BY dataset ORDER BY score DESC, name DESC) AS best, max(score) OVER (PARTITION BY dataset) AS best_score,
  first_value(name) OVER (PARTITION BY dataset ORDER BY score, name) AS worst, min(score) OVER (PARTITION BY dataset) AS worst_score FROM sc"""
AVAILABILITY_SQL = PREPARED_SQL + """,
w AS (SELECT dataset, count(*) AS total_rows, count(*) FILTER (trim(action_key) <> '') AS a, count(*) FILTER (trim(tool_key) <> '') AS t,
  count(*) FILTER (action_obs_key <> '') AS ao, count(*) FILTER (trim(action_key) <> '' AND trim(obs_text) <> '') AS sim, count(*) FILTER (trim(error_key) <> '') AS e,
  count(*) FILTER (len(files) > 0) AS f, least(count(*) FILTER (trim(action_key) <> '' OR trim(tool_key) <> ''),
  count(*) FILTER (len(files) > 0 OR trim(error_key) <> '' OR obs_key <> '' OR coalesce(trim(signal_fields) <> '', false))) AS r FROM steps GROUP BY 1)
SELECT dataset, f.family AS detector_family, f.n AS eligible_rows, total_rows, f.n > 0 AS available FROM w, LATERAL (VALUES
  ('max_step_guard', total_rows), ('exact_action_repeat_k', a), ('tool_repeat_k', t), ('tool_sequence_repeat', t), ('action_observation_repeat', ao),
  ('action_observation_similarity', sim), ('error_signature_repeat_k', e), ('file_revisit_guard', f), ('repeat_without_progress_guard', r)) f(family, n)"""
