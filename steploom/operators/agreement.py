"""Agreement of two label sources: confusion, Cohen's kappa, and one-to-one matching of spans."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.operators import sequence as seq
from steploom.operators.sequence import KEYS, PREPARED_SQL, SPANS_SQL
from steploom.sources.tables import checkpointed, read_table

LEAST_IOU = 0.5
MATCH_SCHEMA = "dataset string, trajectory_id string, a_id string, b_id string, a_label string, b_label string, iou double"


def _labels(spark, folder: str) -> DataFrame:
    """Two labels of each step: its own span label, and the one its covering spans give it."""
    s = seq.prepared(spark, folder)
    own = F.coalesce(seq.span_label(F.col("span_label_norm")), F.lit("none"))
    held = F.when(F.col("in_uc"), "unproductive_cycle").when(F.col("in_pi"), "productive_iteration").when(F.col("in_uncertain"), "uncertain").otherwise("none")
    return s.select("dataset", F.when(own == "unresolved", "uncertain").otherwise(own).alias("a"), held.alias("b"))


_LABELS_CTE = PREPARED_SQL + """, l AS (SELECT dataset, CASE own WHEN '' THEN 'none' WHEN 'unresolved' THEN 'uncertain' ELSE own END AS a,
  CASE WHEN in_uc THEN 'unproductive_cycle' WHEN in_pi THEN 'productive_iteration' WHEN in_uncertain THEN 'uncertain' ELSE 'none' END AS b FROM steps)"""


def confusion(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def kappa(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Records, raw agreement and Cohen's kappa of columns a and b; kappa is null if chance agreement is 1.

    Everything follows from the confusion counts, so only these are shuffled again.
    """
    c = checkpointed(confusion(pairs, by))
    total = c.groupBy(*by).agg(F.sum("n").alias("records"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agreeing"))
    a = c.groupBy(*by, F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    b = c.groupBy(*by, F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("x"))
    out = total.join(chance, by, "left").withColumn("x", F.coalesce("x", F.lit(0).cast("long")))
    observed = F.col("agreeing") / F.col("records")
    expected = F.col("x") / (F.col("records").cast("double") * F.col("records"))
    return out.select(*by, "records", "agreeing", observed.alias("raw_agreement"), F.when(expected != 1, F.round((observed - expected) / (1 - expected), 9)).alias("kappa"))


def _kappa_sql(source: str, by: str) -> str:
    return f"""
c AS (SELECT {by}, a, b, count(*) AS n FROM {source} GROUP BY ALL), t AS (SELECT {by}, sum(n)::BIGINT AS records, sum(n) FILTER (a = b)::BIGINT AS ag FROM c GROUP BY ALL),
ma AS (SELECT {by}, a AS v, sum(n) AS na FROM c GROUP BY ALL), mb AS (SELECT {by}, b AS v, sum(n) AS nb FROM c GROUP BY ALL),
ch AS (SELECT {by}, sum(na * nb) AS x FROM ma JOIN mb USING ({by}, v) GROUP BY ALL),
k AS (SELECT {by}, records, coalesce(ag, 0) AS agreeing, coalesce(ag, 0) / records AS o, coalesce(x, 0)::DOUBLE / (records::DOUBLE * records) AS e FROM t LEFT JOIN ch USING ({by}))
SELECT {by}, records, agreeing, o AS raw_agreement, CASE WHEN e <> 1 THEN round((o - e) / (1 - e), 9) END AS kappa FROM k"""


def label_confusion(spark, folder: str) -> DataFrame:
    return confusion(_labels(spark, folder), ["dataset"])


LABEL_CONFUSION_SQL = _LABELS_CTE + " SELECT dataset, a, b, count(*) AS n FROM l GROUP BY 1, 2, 3"


def label_kappa(spark, folder: str) -> DataFrame:
    return kappa(_labels(spark, folder), ["dataset"])


LABEL_KAPPA_SQL = _LABELS_CTE + "," + _kappa_sql("l", "dataset")
_CLASSES = ["unproductive_cycle", "productive_iteration", "uncertain", "none"]


def one_vs_rest_kappa(spark, folder: str) -> DataFrame:
    """Kappa of each label against all others, over all pools."""
    cells = [F.struct(F.lit(c).alias("label"), (F.col("a") == c).alias("a"), (F.col("b") == c).alias("b")) for c in _CLASSES]
    return kappa(_labels(spark, folder).select(F.explode(F.array(*cells)).alias("x")).select("x.*"), ["label"])


ONE_VS_REST_KAPPA_SQL = _LABELS_CTE + ", x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS label, a = '{c}' AS a, b = '{c}' AS b FROM l" for c in _CLASSES) + ")," + _kappa_sql("x", "label")


def candidates(a: DataFrame, b: DataFrame, least: float = LEAST_IOU) -> DataFrame:
    """Pairs of spans of two coders with an IoU of at least `least`.

    Such spans differ in length at most by the factor 1 / least, and their starts by (1 - least) / least of a
    length. They meet in places of their length's power of two, so long spans are in as few places as short ones
    and a trajectory of many spans is many groups.
    """
    levels, reach = math.ceil(math.log2(1 / least)), math.ceil((1 - least) / least)
    level = lambda s: F.floor(F.log2((F.col(f"{s}_end") - F.col(f"{s}_start") + 1).cast("double"))).cast("int")
    side = lambda df, s: df.select(*KEYS, *[F.col(c).alias(f"{s}_{c}") for c in ("row", "id", "start", "end", "label")])
    place = lambda c, lv: F.floor(c / F.pow(F.lit(2.0), lv + 1)).cast("long")
    x = side(a, "a").withColumn("lv", level("a")).withColumn("at", place(F.col("a_start"), F.col("lv")))
    y = side(b, "b").withColumn("lv", F.explode(F.sequence(level("b") - levels, level("b") + levels)))
    y = y.withColumn("at", F.explode(F.sequence(place(F.col("b_start"), F.col("lv")) - reach, place(F.col("b_start"), F.col("lv")) + reach)))
    inter = F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1
    iou = inter / ((F.col("a_end") - F.col("a_start") + 1) + (F.col("b_end") - F.col("b_start") + 1) - inter)
    return x.join(y, [*KEYS, "lv", "at"]).where(inter > 0).withColumn("iou", iou).where(F.col("iou") >= least).drop("lv", "at")


def match_spans(a: DataFrame, b: DataFrame, least: float = LEAST_IOU) -> DataFrame:
    """Greedy one-to-one matching of the spans of two coders by IoU, without regard to labels.

    a and b have KEYS, row, id, start, end, label; `row` names a span. Pairs are taken in the order of
    (-IoU, row of a, row of b), each span once. A pair that comes first for both its spans is taken whatever
    happens elsewhere, so each round takes all such pairs at once and drops what they rule out; the first
    pair of all is always one, and pairs only depend on others through chains of overlaps, which are short.
    """
    left = checkpointed(candidates(a, b, least))
    columns = [c.split()[0] for c in MATCH_SCHEMA.split(", ")]
    taken: list[DataFrame] = []
    order = F.struct((-F.col("iou")).alias("o"), "a_row", "b_row")
    while left.limit(1).count():
        ordered = left.withColumn("o", order)
        first = lambda s: ordered.groupBy(*KEYS, f"{s}_row").agg(F.min("o").alias(f"{s}_first"))  # noqa: E731, B023
        both = ordered.join(first("a"), [*KEYS, "a_row"]).join(first("b"), [*KEYS, "b_row"]).where((F.col("o") == F.col("a_first")) & (F.col("o") == F.col("b_first")))
        now = checkpointed(both.select(*KEYS, *[c for c in left.columns if c not in KEYS]))
        taken.append(now.select(*columns))
        left = left.join(now.select(*KEYS, "a_row"), [*KEYS, "a_row"], "left_anti").join(now.select(*KEYS, "b_row"), [*KEYS, "b_row"], "left_anti")
        left = checkpointed(left)
    out = left.select(*columns)
    for part in taken:
        out = out.unionByName(part)
    return out


def span_matches(spark, folder: str) -> DataFrame:
    """Spans read from explicit ids matched with spans derived otherwise."""
    n = read_table(spark, folder, "normalized_spans").where("trajectory_id IS NOT NULL AND start_step_index IS NOT NULL AND end_step_index IS NOT NULL")
    s = n.groupBy(
        F.coalesce("dataset", F.lit("")).alias("dataset"), "trajectory_id", "span_id", "span_source",
        F.least("start_step_index", "end_step_index").alias("start"), F.greatest("start_step_index", "end_step_index").alias("end"),
        F.coalesce(seq.span_label(F.col("span_label_norm")), F.lit("")).alias("label"),
    ).agg(F.min("row_number").alias("row"))
    s = checkpointed(s.withColumnRenamed("span_id", "id"))
    cols = [*KEYS, "row", "id", "start", "end", "label"]
    explicit = F.coalesce(F.col("span_source") == "explicit_span_csv", F.lit(False))
    return match_spans(s.where(explicit).select(*cols), s.where(~explicit).select(*cols))


def unspanned_trajectories(spark, folder: str) -> DataFrame:
    """Trajectories without any span."""
    s = seq.steps_once(read_table(spark, folder, "enriched_steps", "dataset", "trajectory_id", "step_index")).select(*KEYS).distinct()
    return s.join(seq.ordered_spans(read_table(spark, folder, "normalized_spans")).select(*KEYS).distinct(), KEYS, "left_anti")


UNSPANNED_TRAJECTORIES_SQL = f"""WITH {seq.ONCE_SQL}, {SPANS_SQL} SELECT DISTINCT dataset, trajectory_id FROM s0
WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.dataset = s0.dataset AND sp.trajectory_id = s0.trajectory_id)"""

# Pairs one after the other, in their order inside a trajectory, with the spans used so far.
SPAN_MATCHES_SQL = f"""WITH RECURSIVE n AS (SELECT coalesce(dataset, '') AS dataset, trajectory_id, span_id AS id, coalesce(span_source = 'explicit_span_csv', false) AS explicit, span_source,
  least(start_step_index, end_step_index) AS s, greatest(start_step_index, end_step_index) AS t, {seq.label_sql('span_label_norm')} AS label, row_number
  FROM normalized_spans WHERE trajectory_id IS NOT NULL AND start_step_index IS NOT NULL AND end_step_index IS NOT NULL),
o AS (SELECT dataset, trajectory_id, id, span_source, explicit, s, t, label, min(row_number) AS row FROM n GROUP BY ALL),
p AS (SELECT a.dataset, a.trajectory_id, a.id AS a_id, b.id AS b_id, a.label AS a_label, b.label AS b_label, a.row AS a_row, b.row AS b_row,
  (least(a.t, b.t) - greatest(a.s, b.s) + 1) / ((a.t - a.s + 1) + (b.t - b.s + 1) - (least(a.t, b.t) - greatest(a.s, b.s) + 1)) AS iou
  FROM o a JOIN o b ON a.dataset = b.dataset AND a.trajectory_id = b.trajectory_id AND a.explicit AND NOT b.explicit AND least(a.t, b.t) >= greatest(a.s, b.s)),
c AS (SELECT *, row_number() OVER (PARTITION BY dataset, trajectory_id ORDER BY iou DESC, a_row, b_row) AS rn FROM p WHERE iou >= {LEAST_IOU}),
g AS (SELECT DISTINCT dataset, trajectory_id, 0::BIGINT AS rn, []::BIGINT[] AS ua, []::BIGINT[] AS ub, false AS pick FROM c
  UNION ALL SELECT g.dataset, g.trajectory_id, c.rn, CASE WHEN list_contains(ua, a_row) OR list_contains(ub, b_row) THEN ua ELSE list_append(ua, a_row) END,
    CASE WHEN list_contains(ua, a_row) OR list_contains(ub, b_row) THEN ub ELSE list_append(ub, b_row) END, NOT (list_contains(ua, a_row) OR list_contains(ub, b_row))
  FROM g JOIN c ON c.dataset = g.dataset AND c.trajectory_id = g.trajectory_id AND c.rn = g.rn + 1)
SELECT c.dataset, c.trajectory_id, a_id, b_id, a_label, b_label, iou FROM c JOIN g ON g.dataset = c.dataset AND g.trajectory_id = c.trajectory_id AND g.rn = c.rn WHERE pick"""

NAMES = ["label_confusion", "label_kappa", "one_vs_rest_kappa", "span_matches", "unspanned_trajectories"]
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[f"{n.upper()}_SQL"] for n in NAMES}
