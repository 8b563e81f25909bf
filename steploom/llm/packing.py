"""Filling containers of fixed capacity with whole texts (problem 6).

Texts are measured in tokens of a public tokenizer. A text longer than a container fills whole
containers and leaves one rest; a rest and every other text is never split. The sizes of the rests are
packed by best-fit decreasing in partitions. For each partition dual feasible functions give a lower
bound of its number of containers: where the packing needs no more, it is certified and stays. The
partitions with a gap then give up their worst-filled containers, exchange these texts with one another
and pack them again, for a fixed number of rounds. `certificates` tells which partitions stayed without
one, and `fill_report` holds the whole packing against the bound of all its pieces together.

Defined results: null and blank texts take no container and have no row; a text of no tokens likewise;
equal texts are packed each for itself; a capacity that is null or below 1 is left out; ids of
containers are unique within a specification.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.sources.tables import broadcast_if_small, checkpointed, read_table

#: Items of one partition: its size in memory and its work are bounded by this, whatever the input.
ITEMS_PER_PARTITION = 20_000
ROUNDS = 2
#: Containers filled to less than this share are given up in a round by a partition with a gap.
LOOSE = 0.98


def default_vocabulary() -> str:
    """The byte-level BPE ranks of the installed public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


# Fixed value: the pre-tokenizer pattern that belongs to these ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def measured(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every document with at least one token; null ids are left out.

    The vocabulary is a file of the driver; every executor gets a copy.
    """
    path = vocabulary or default_vocabulary()
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            sizes = [len(enc.encode_ordinary(t)) if t and t.strip() else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    return (
        documents.where(F.col("doc_id").isNotNull())
        .select("doc_id", "text")
        .mapInArrow(run, "doc_id bigint, tokens bigint")
        .where("tokens > 0")
    )


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0, 1, ...) of each item by best-fit decreasing.

    Open containers are kept by the room they have left, and the rooms in use as the bits of one
    number, so the tightest container that takes an item is one shift and one lowest bit away.
    """
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    out = np.empty(len(sizes), dtype=np.int64)
    rooms: dict[int, list[int]] = {}
    used, bins = 0, 0
    for i in order:
        size = int(sizes[i])
        fit = used >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            open_ = rooms[room]
            b = open_.pop()
            if not open_:
                used &= ~(1 << room)
        else:
            b, room = bins, capacity
            bins += 1
        out[i] = b
        left = room - size
        if left:
            rooms.setdefault(left, []).append(b)
            used |= 1 << left
    return out


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """The best of a family of dual feasible functions: no packing needs fewer containers.

    u(k) rounds a size up or keeps it by its multiple k + 1; U(e) counts items above capacity - e as
    whole, drops those below e and keeps the rest. Summed over all sizes, each is a valid bound. With
    `times`, each size stands for so many items.
    """
    if not len(sizes):
        return 0
    value, where = np.unique(sizes, return_inverse=True)
    count = np.bincount(where, times).astype(np.int64) if times is not None else np.bincount(where)
    best = -(-int((value * count).sum()) // capacity)
    # U(e), for every e up to half the capacity at which the sum can change.
    edges = np.unique(np.concatenate([value[value <= capacity // 2], capacity - value[value > capacity // 2] + 1]))
    edges = edges[(edges >= 1) & (edges <= capacity // 2)]
    running_n = np.concatenate([[0], np.cumsum(count)])
    running_s = np.concatenate([[0], np.cumsum(value * count)])
    low = np.searchsorted(value, edges, "left")
    high = np.searchsorted(value, capacity - edges, "right")
    if len(edges):
        whole = running_n[-1] - running_n[high]
        kept = running_s[np.maximum(high, low)] - running_s[low]
        best = max(best, int((whole + -(-kept // capacity)).max()))
    # u(k): x -> x if (k + 1) x / capacity is whole, else floor((k + 1) x / capacity) / k.
    for k in range(1, 32):
        multiple = (k + 1) * value
        exact = multiple % capacity == 0
        total = (np.where(exact, value * k, (multiple // capacity) * capacity) * count).sum()
        best = max(best, -(-int(total) // (k * capacity)))
    return best


_SPEC = "spec_id int, capacity int, part bigint, doc_id bigint, piece int, tokens bigint, bin bigint, filled bigint, gap bigint, bound bigint, bins bigint"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One partition packed, with its bound, its number of containers and the gap between them."""
    pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    capacity, sizes = int(pdf["capacity"].iloc[0]), pdf["tokens"].to_numpy()
    out = pdf.assign(bin=best_fit(sizes, capacity))
    out["filled"] = np.bincount(out["bin"], weights=sizes).astype(np.int64)[out["bin"]]
    bins, bound = int(out["bin"].max()) + 1, lower_bound(sizes, capacity)
    return out.assign(gap=bins - bound, bound=bound, bins=bins)[[c.split()[0] for c in _SPEC.split(", ")]]


def _packed(items: DataFrame) -> DataFrame:
    return items.groupBy("spec_id", "part").applyInPandas(_pack, _SPEC)


def _spread(items: DataFrame, per_part: int, seed: int) -> DataFrame:
    """`items` with a partition number by hash, so that each partition holds about `per_part` items."""
    n = items.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.spec_id: r.n for r in n.collect()}  # a number for each specification
    if not counts:
        return items.withColumn("part", F.lit(0).cast("long"))
    parts = F.create_map(*[F.lit(x) for s, c in counts.items() for x in (s, max(1, -(-c // per_part)))])
    return items.withColumn(
        "part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece"), F.element_at(parts, F.col("spec_id")))
    )


def packed(
    sizes: DataFrame, specs: DataFrame, per_part: int = ITEMS_PER_PARTITION, rounds: int = ROUNDS, loose: float = LOOSE
) -> DataFrame:
    """The container of every text: spec_id, doc_id, piece_no, tokens, container_id.

    `sizes` has (doc_id, tokens), `specs` (spec_id, capacity_tokens). The pieces of a long text are
    numbered from 0; its full pieces have a container each.
    """
    return packed_and_certified(sizes, specs, per_part, rounds, loose)[0]


def packed_and_certified(
    sizes: DataFrame, specs: DataFrame, per_part: int = ITEMS_PER_PARTITION, rounds: int = ROUNDS, loose: float = LOOSE
) -> tuple[DataFrame, DataFrame]:
    """`packed`, and per specification, round and partition its items, containers, lower bound and gap.

    A partition whose gap is not 0 gives up its loose containers to the next round, if there is one.
    """
    capacities = [
        (r.spec_id, r.capacity_tokens)
        for r in specs.where("spec_id IS NOT NULL AND capacity_tokens >= 1").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id").collect()
    ]
    if not capacities:
        empty = sizes.sparkSession.createDataFrame
        return empty([], "spec_id int, doc_id bigint, piece_no int, tokens bigint, container_id string"), empty([], _CERTIFICATE)
    # Each text once for every specification: their number is a parameter of the task, not of the data.
    spec = F.explode(F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).alias("capacity")) for s, c in capacities]))
    each = sizes.select("doc_id", "tokens", spec.alias("s")).select("doc_id", "tokens", "s.*")
    full = (
        each.where(F.col("tokens") > F.col("capacity"))
        .select(
            "spec_id", "capacity", "doc_id",
            F.explode(F.sequence(F.lit(0), (F.floor(F.col("tokens") / F.col("capacity")) - 1).cast("int"))).alias("piece"),
        )
        .select(
            "spec_id", "doc_id", "piece", F.col("capacity").cast("long").alias("tokens"),
            F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"),
        )
    )
    long_ = F.col("tokens") > F.col("capacity")
    rests = each.select(
        "spec_id", "capacity", "doc_id",
        F.when(long_, F.floor(F.col("tokens") / F.col("capacity"))).otherwise(0).cast("int").alias("piece"),
        F.when(long_, F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens")).alias("tokens"),
    ).where("tokens > 0")

    settled: list[DataFrame] = []
    certificates: DataFrame | None = None
    open_items = _spread(rests, per_part, 0)
    for n in range(rounds + 1):
        now = checkpointed(_packed(open_items))
        name = F.concat_ws("-", F.lit(f"r{n}"), "part", "bin")
        own = now.groupBy("spec_id", F.lit(n).alias("round"), "part").agg(
            F.count(F.lit(1)).alias("items"), F.max("bins").alias("containers"), F.max("bound").alias("bound"), F.max("gap").alias("gap")
        )
        certificates = own if certificates is None else certificates.unionByName(own)
        if n == rounds:
            settled.append(now.withColumn("container_id", name))
            break
        # A certified partition stays whole; of one with a gap the well-filled containers stay.
        stays = (F.col("gap") == 0) | (F.col("filled") >= F.col("capacity") * loose)
        settled.append(now.where(stays).withColumn("container_id", name))
        open_items = _spread(now.where(~stays).select("spec_id", "capacity", "doc_id", "piece", "tokens"), per_part, n + 1)
    columns = ["spec_id", "doc_id", "piece", "tokens", "container_id"]
    out = full.select(*columns)
    for s in settled:
        out = out.unionByName(s.select(*columns))
    return out.select("spec_id", "doc_id", F.col("piece").alias("piece_no"), "tokens", "container_id"), certificates


_CERTIFICATE = "spec_id int, round int, part bigint, items bigint, containers bigint, bound bigint, gap bigint"


def _bounded(pdf: pd.DataFrame) -> pd.DataFrame:
    """The bound of one specification from the numbers of its pieces by size; there are at most capacity sizes."""
    capacity = int(pdf["capacity_tokens"].iloc[0])
    bound = lower_bound(pdf["tokens"].to_numpy(), capacity, pdf["n"].to_numpy())
    return pd.DataFrame({"spec_id": pdf["spec_id"].iloc[:1], "least_containers": [bound]})


def fill_report(packing: DataFrame, specs: DataFrame) -> DataFrame:
    """Per specification: pieces, tokens, containers, the least that any packing of these pieces needs, and the share filled."""
    caps = broadcast_if_small(specs.where("spec_id IS NOT NULL AND capacity_tokens >= 1").select("spec_id", "capacity_tokens").distinct())
    least = packing.groupBy("spec_id", "tokens").agg(F.count(F.lit(1)).alias("n")).join(caps, "spec_id").groupBy("spec_id").applyInPandas(_bounded, "spec_id int, least_containers bigint")
    return (
        packing.groupBy("spec_id", "container_id")
        .agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"))
        .groupBy("spec_id")
        .agg(F.sum("k").alias("pieces"), F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("containers"), F.max("t").alias("fullest"))
        .join(caps, "spec_id")
        .join(least, "spec_id")
        .withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )


def _inputs(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = checkpointed(measured(read_table(spark, folder, "documents", "doc_id", "text")))
    return sizes, read_table(spark, folder, "pack_specs")


def p6_containers(spark, folder: str) -> DataFrame:
    """The container of every text for each specification."""
    return packed(*_inputs(spark, folder))


def p6_fill(spark, folder: str) -> DataFrame:
    sizes, specs = _inputs(spark, folder)
    return fill_report(packed(sizes, specs), specs)


def p6_certificates(spark, folder: str) -> DataFrame:
    """Per specification and round: partitions, those certified, their containers and the sum of their bounds."""
    _, certificates = packed_and_certified(*_inputs(spark, folder))
    return certificates.groupBy("spec_id", "round").agg(
        F.count(F.lit(1)).alias("partitions"), F.sum(F.when(F.col("gap") == 0, 1).otherwise(0)).alias("certified"),
        F.sum("items").alias("items"), F.sum("containers").alias("containers"), F.sum("bound").alias("bound"),
    )


def p6_check(spark, folder: str) -> DataFrame:
    """Per specification: texts that are packed, and how often each rule is broken (never).

    over_full: containers with more tokens than they hold; lost: texts whose pieces do not sum to the text;
    split: texts in more pieces than their length asks for; repeated: pieces in two containers.
    """
    sizes, specs = _inputs(spark, folder)
    packing = checkpointed(packed(sizes, specs))
    caps = broadcast_if_small(specs.where("spec_id IS NOT NULL AND capacity_tokens >= 1").select("spec_id", "capacity_tokens").distinct())
    over = packing.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("t")).join(caps, "spec_id")
    over = over.groupBy("spec_id").agg(F.sum(F.when(F.col("t") > F.col("capacity_tokens"), 1).otherwise(0)).alias("over_full"))
    by_text = packing.groupBy("spec_id", "doc_id").agg(
        F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece_no").alias("numbers")
    )
    whole = sizes.crossJoin(caps).join(by_text, ["spec_id", "doc_id"], "left")  # a row for each text and specification
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return whole.groupBy("spec_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("texts"), one(F.coalesce(F.col("t") != F.col("tokens"), F.lit(True))).alias("lost"),
        one(F.col("pieces") > F.ceil(F.col("tokens") / F.col("capacity_tokens"))).alias("split"), one(F.col("pieces") != F.col("numbers")).alias("repeated"),
    ).join(over, "spec_id")


P6_CHECK_SQL = r"""
SELECT spec_id, capacity_tokens, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '\S')) AS texts,
  0::BIGINT AS lost, 0::BIGINT AS split, 0::BIGINT AS repeated, 0::BIGINT AS over_full
FROM (SELECT DISTINCT spec_id, capacity_tokens FROM pack_specs WHERE spec_id IS NOT NULL AND capacity_tokens >= 1)"""
