"""Evaluation passages inside training text (problem 7).

The training text is tokenised once into a stored positional inverted index: a Parquet table with one
row for each term and segment of documents, holding the term's number of documents and its positions as
packed differences. Any number of test items is then searched without reading the text again:

* Each item asks for pivots: its rarest terms, by their postings in the whole training text, as many as
  put WANTED of them into any LEAST words in a row.
* Their lists are fetched by a join on the term, shifted by the pivot's place in the item and intersected
  by segment. Every passage of at least LEAST words with at most one error in ERRORS words holds LEAST
  words in a row with at most LOST errors, in which all but LOST pivots stand at matching distances: no
  passage is missed.
* The pairs that remain are measured word by word on the candidate documents alone: an exact phrase, or
  one with single words changed, left out or put in (proximity match).

Words are compared in lower case without punctuation, markup, line prefixes, soft breaks and hyphens at
line ends. The first line of an item does not count if it opens at least INSTRUCTION_SHARED items.

Defined results: null and empty texts and rows without id hold nothing; equal documents are each
reported; items shorter than LEAST words cannot be reported; of items with one id each text counts;
extra columns are ignored. A passage begins and ends with a word that item and document share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.sources.tables import broadcast_if_small, checkpointed, read_table, written

LEAST = 20
#: One word in so many may differ.
ERRORS = 8
#: Errors that the best LEAST words in a row of a passage have at most: all 4 errors of 32 to 39 words can
#: lie in their common middle; a longer passage holds two stretches that share no word.
LOST = 4
#: Pivots in any LEAST words in a row of an item.
WANTED = 8
INSTRUCTION_SHARED = 3
#: Words of a segment; a longer document is a segment of its own.
SEGMENT_WORDS = 1 << 20
#: Words a worker keeps the hash of; beyond it, it forgets them all.
MEMO = 1 << 20
#: Postings times askers of one group in the intersection of a segment, on average.
GROUP_HITS = 4_000_000

# What markup and line layout add between and inside words.
_TAG = re.compile(r"<[^<>]{1,120}>|&(?:[a-z]{2,8}|#\d{1,5});")
# The hyphen comes first in the pattern, so that only hyphens are looked at.
_BROKEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n[ \t]*(?:(?://+|[*>#|;%]+|--)[ \t]*)?(?=[^\W\d_])")
_SOFT = "­​‌‍﻿'’`*_"
_WORD = re.compile(r"[^\W_]+")
_ASCII = {c: None if chr(c) in _SOFT else c if chr(c).isalnum() else " " for c in range(128)}


def words_of(text: str) -> list[str]:
    """The words of a text in order, without markup and layout."""
    t = text.lower()
    if "<" in t or "&" in t:
        t = _TAG.sub(" ", t)
    if "-" in t and "\n" in t:
        t = _BROKEN.sub("", t)
    if t.isascii():
        return t.translate(_ASCII).split()
    for c in _SOFT:
        t = t.replace(c, "")
    return _WORD.findall(t)


class Terms(dict):
    """The 64-bit number of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        n = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return n


# ---------------------------------------------------------------- packed positions


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of seven bits each, lowest first; and the bytes of each value."""
    v = values.astype(np.int64)
    size = np.ones(len(v), dtype=np.int64)
    for bits in (7, 14, 21, 28, 35):
        size += v >= 1 << bits
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        out[at[has] + k] = (v[has] >> (7 * k) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    last = data < 128
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    k = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * k), start)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    v = np.sort(values)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def _bytes_of(column: pa.ChunkedArray) -> np.ndarray:
    """All bytes of a binary column in a row."""
    parts = []
    for a in column.cast(pa.large_binary()).chunks:
        _, offsets, data = a.buffers()
        if len(a) and data is not None:
            at = np.frombuffer(offsets, dtype=np.int64)[a.offset : a.offset + len(a) + 1]
            parts.append(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


# ---------------------------------------------------------------- the index

INDEX = "segment bigint, term bigint, docs int, postings int, positions binary"
_INDEX_NAMES = ["segment", "term", "docs", "postings", "positions"]


def _segment(number: int, ids: list[int], sizes: list[int], terms: list[int]) -> pa.RecordBatch:
    """The rows of one segment, by term. The row without a term holds the documents: ids, then starts."""
    term = np.array(terms, dtype=np.int64)
    starts = np.cumsum([0, *sizes[:-1]]).astype(np.int64)
    order = np.argsort(term, kind="stable")
    sorted_ = term[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=sorted_[0] - 1)) if len(term) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(term)))
    doc = (np.searchsorted(starts, order, side="right") - 1) if len(term) else order
    step = np.diff(order, prepend=0)
    step[first] = order[first]
    fresh = np.diff(doc, prepend=-1) != 0
    fresh[first] = True
    data, size = pack(step)
    row = np.add.reduceat(size, first) if len(term) else np.zeros(0, np.int64)
    table = np.concatenate([np.array(ids, dtype=np.int64), starts]).tobytes()
    offsets = np.concatenate([[0, len(table)], len(table) + np.cumsum(row)]).astype(np.int32)
    positions = pa.Array.from_buffers(pa.binary(), len(first) + 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(table + data.tobytes())])
    docs = np.add.reduceat(fresh.astype(np.int32), first) if len(term) else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(first) + 1, number)),
            pa.array([None, *sorted_[first].tolist()], pa.int64()),
            pa.array(np.concatenate([[len(ids)], docs]).astype(np.int32)),
            pa.array(np.concatenate([[len(term)], count]).astype(np.int32)),
            positions,
        ],
        _INDEX_NAMES,
    )


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers, part, n = Terms(), TaskContext.get().partitionId(), 0
    ids: list[int] = []
    sizes: list[int] = []
    terms: list[int] = []
    for batch in batches:
        for doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
            own = list(map(numbers.__getitem__, words_of(text)))
            if not own:
                continue
            if terms and len(terms) + len(own) > SEGMENT_WORDS:
                yield _segment(part << 32 | n, ids, sizes, terms)
                ids, sizes, terms, n = [], [], [], n + 1
            ids.append(doc_id)
            sizes.append(len(own))
            terms += own
    if ids:
        yield _segment(part << 32 | n, ids, sizes, terms)


def built_index(documents: DataFrame) -> DataFrame:
    """The positional index of all documents, written once; read it for as many searches as wanted."""
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return written(texts.mapInArrow(_indexed, INDEX), "postings")


# ---------------------------------------------------------------- the questions


def item_bodies(items: DataFrame) -> DataFrame:
    """(item_id, text) of each item, without a first line that many items share."""
    lines = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        "item_id", "text", F.regexp_replace(F.lower(F.regexp_extract("text", r"^\s*([^\n]*)\n", 1)), r"[^\p{L}\p{N}]+", " ").alias("_first")
    )
    shared = (
        lines.where(F.trim("_first") != "")
        .groupBy("_first")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= INSTRUCTION_SHARED)
        .select("_first", F.lit(True).alias("_shared"))
    )
    body = F.when(F.col("_shared"), F.regexp_replace("text", r"^\s*[^\n]*\n", "")).otherwise(F.col("text"))
    bodies = lines.join(shared, "_first", "left").select("item_id", body.alias("text")).distinct()
    return bodies.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the items long enough, as terms with their places."""
    numbers = Terms()
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for item, text in zip(*[c.to_pylist() for c in batch.columns]):
            words = words_of(text)
            if len(words) >= LEAST:
                out += [(item, at, numbers[w]) for at, w in enumerate(words)]
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()))], ["item", "at", "term"])


def pivots(counts: np.ndarray) -> np.ndarray:
    """Places of the rarest words, so that any LEAST words in a row hold WANTED of them."""
    held = np.zeros(max(1, len(counts) - LEAST + 1), dtype=np.int64)
    chosen = []
    for p in np.argsort(counts, kind="stable").tolist():
        rows = held[max(0, p - LEAST + 1) : p + 1]
        if rows.size and rows.min() < WANTED:
            rows += 1
            chosen.append(p)
    return np.array(chosen, dtype=np.int64)


def _pivots(table: pa.Table) -> pa.Table:
    """The pivots of one item."""
    table = table.sort_by("at")
    return table.take(pa.array(pivots(table.column("n").to_numpy())))


def questions(index: DataFrame, bodies: DataFrame) -> DataFrame:
    """(item, at, term, n): the pivots of every item, with their postings in the whole training text."""
    words = checkpointed(bodies.select("item", "text").mapInArrow(_worded, "item bigint, at int, term bigint"))
    known = index.join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("postings").alias("n"))
    counted = words.join(known, "term", "left").select("item", "at", "term", F.coalesce("n", F.lit(0)).alias("n"))
    return counted.groupBy("item").applyInArrow(_pivots, "item bigint, at int, term bigint, n bigint").where("n > 0")


# ---------------------------------------------------------------- the intersection

PAIRS = "doc_id bigint, item bigint, shifts array<int>"
#: Pairs, of about 40 bytes, that may be in memory beside the documents.
MOST_PAIRS = 1_000_000
#: Width of a ruler: two rulers half a width apart hold any two places that are at most LOST apart.
WIDTH = 2 * LOST


def _met(table: pa.Table) -> pa.Table:
    """The pairs of a segment whose pivots stand at matching distances, with those distances."""
    is_docs = np.array(table.column("at").is_null())
    ids = starts = np.zeros(0, np.int64)
    for value in table.column("positions").filter(pa.array(is_docs)).to_pylist():
        ids, starts = np.split(np.frombuffer(value, dtype=np.int64), 2)
    asked = table.filter(pa.array(~is_docs))
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "item": pa.array([], pa.int64()), "shifts": pa.array([], pa.list_(pa.int32()))})
    if not len(ids) or not asked.num_rows:
        return empty
    count = asked.column("postings").to_numpy()
    first = np.cumsum(count) - count
    pos = np.cumsum(unpack(_bytes_of(asked.column("positions"))))
    pos -= np.repeat(np.where(first > 0, pos[first - 1], 0), count)
    items, item = np.unique(asked.column("item").to_numpy(), return_inverse=True)
    at = np.repeat(asked.column("at").to_numpy().astype(np.int64), count)
    doc = np.searchsorted(starts, np.arange(int(pos.max()) + 1), side="right")[pos] - 1
    place = doc * len(items) + np.repeat(item, count)
    shift = pos - starts[doc] - at
    low, long = int(shift.min()), int(at.max()) + 1
    bands = (int(shift.max()) - low) // WIDTH + 2
    need = WANTED - LOST
    found = []
    for lead in (0, LOST):
        key = distinct((place * bands + (shift - low + lead) // WIDTH) * long + at)
        group, where = key // long, key % long
        near = (group[need - 1 :] == group[: len(group) - need + 1]) & (where[need - 1 :] - where[: len(where) - need + 1] < LEAST)
        good = distinct(group[: len(group) - need + 1][near])
        found.append(np.stack([good // bands, (good % bands * WIDTH - lead + low) // WIDTH * WIDTH], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    if not len(pairs):
        return empty
    each, start = np.unique(pairs[:, 0], return_index=True)
    shifts = pa.ListArray.from_arrays(pa.array(np.append(start, len(pairs)).astype(np.int32)), pa.array(pairs[:, 1].astype(np.int32)))
    return pa.table({"doc_id": pa.array(ids[each // len(items)]), "item": pa.array(items[each % len(items)]), "shifts": shifts})


def candidates(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, item, shifts): the pairs whose pivots stand at matching distances."""
    asked = checkpointed(asked)
    size = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / (index.where("term IS NULL").agg(F.sum("postings")).first()[0] or 1)
    groups = max(1, round(size * SEGMENT_WORDS / GROUP_HITS))
    group = F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int")
    hits = index.join(asked.withColumn("part", group), "term").select("segment", "part", "positions", "postings", "item", "at")
    docs = index.where("term IS NULL").select(
        "segment", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "positions", "postings",
        F.lit(None).cast("bigint").alias("item"), F.lit(None).cast("int").alias("at"),
    )
    return hits.unionByName(docs).groupBy("segment", "part").applyInArrow(_met, PAIRS)


# ---------------------------------------------------------------- the measure

#: Longest distance between two common words in a row. Of a passage with a longer gap one side alone has LEAST words.
STEP = 6
#: Distances at which the words of a candidate may stand, from the place of its ruler.
SPREAD = range(-LOST, 2 * WIDTH + LOST - 1)


def promising(docs: list[np.ndarray], items: list[np.ndarray], shifts: list[int]) -> np.ndarray:
    """Whether some LEAST words in a row of the item have LEAST - LOST words near the place `shift` of the document.

    Words are their numbers, of which half the bits do: more pairs may pass, never fewer.
    """
    guard = max(map(len, items)) + 64
    sizes = np.array([len(d) for d in docs])
    begin = np.cumsum(sizes + guard) - sizes
    text = np.full(int((sizes + guard).sum()) + guard, -1, dtype=np.int32)
    for b, d in zip(begin, docs):
        text[b : b + len(d)] = d
    long = np.array([len(i) for i in items])
    start = np.cumsum(long) - long
    item = np.concatenate(items)
    # Places before and behind a document lie in the guards.
    base = begin + np.minimum(np.maximum(np.array(shifts), -(guard - 32)), sizes)
    at = np.arange(len(item)) + np.repeat(base - start, long)
    hit = np.zeros(len(item), dtype=bool)
    for d in SPREAD:
        hit |= text[at + d] == item
    total = np.concatenate([[0], np.cumsum(hit)])
    in_a_row = total[LEAST:] - total[:-LEAST]
    good = np.zeros(len(item) + 1, dtype=np.int64)
    good[: len(in_a_row)] = in_a_row >= LEAST - LOST
    good[: len(item)][np.arange(len(item)) > np.repeat(start + long - LEAST, long)] = 0  # across two items
    return np.add.reduceat(good[:-1], start) > 0


def passage(item: list, doc: list, shift: int) -> tuple[int, int]:
    """(words, errors) of the longest passage of the item near the place `shift` of the document.

    Common words near the expected distance are chained so that common words less errors is greatest;
    between two of them the longer side counts its words as errors. The longest stretch of a chain with
    at most one error in ERRORS words is the passage.
    """
    reach = STEP + len(item) // ERRORS
    low, high = shift + SPREAD[0] - reach, shift + SPREAD[-1] + reach
    where: dict = {}
    for j in range(max(0, low), min(len(doc), high + len(item))):
        where.setdefault(doc[j], []).append(j)
    score: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], tuple[int, int] | None] = {}
    recent: list[list[int]] = []
    for i, word in enumerate(item):
        here = [j for j in where.get(word, ()) if low <= j - i <= high]
        for j in here:
            # A chain goes on whatever it has lost, but never counts for less than one that begins here.
            top, link = -STEP, None
            if (i - 1, j - 1) in score:
                top, link = score[i - 1, j - 1] + 1, (i - 1, j - 1)
            else:
                for d in range(1, min(STEP, i) + 1):
                    for q in recent[i - d]:
                        if 0 < j - q <= STEP and (s := score[i - d, q] + 2 - max(d, j - q)) > top:
                            top, link = s, (i - d, q)
            score[i, j], back[i, j] = max(1, top), link
        recent.append(here)
    best, used = (0, 0), set()
    for point in sorted(score, key=lambda p: -score[p]):
        if point in used:
            continue
        chain = []
        while point is not None:
            chain.append(point)
            point = back[point]
        used.update(chain)
        if len(chain) > best[0] * (1 - 2 / ERRORS):
            best = max(best, _stretch(chain[::-1]), key=lambda x: (x[0], -x[1]))
    return best


def _stretch(chain: list[tuple[int, int]]) -> tuple[int, int]:
    """(words, errors) of the longest part of a chain with at most one error in ERRORS words."""
    places, errors = [chain[0][0]], [0]
    for (i, j), (a, b) in zip(chain, chain[1:]):
        places.append(a)
        errors.append(errors[-1] + max(a - i, b - j) - 1)
    best = (0, 0)
    for s in range(len(places)):
        for t in range(len(places) - 1, s - 1, -1):
            size, wrong = places[t] - places[s] + 1, errors[t] - errors[s]
            if size <= best[0]:
                break
            if wrong * ERRORS <= size:
                best = (size, wrong)
                break
    return best


#: Words of documents and items that are held against one another at once.
TOGETHER = 2_000_000


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers, items = Terms(), {}
    text, doc = None, np.zeros(0, np.int32)
    kept: list[tuple] = []
    size = 0

    def results() -> pa.RecordBatch:
        out = []
        if kept:
            good = promising([k[2] for k in kept], [k[3] for k in kept], [k[4] for k in kept])
            done: tuple = ()
            for k in (k for k, g in zip(kept, good) if g):
                # The next ruler sees the passage that was found from this one.
                if done and done[:2] == k[:2] and done[2] is k[2] and k[4] - done[4] <= WIDTH:
                    continue
                words, errors = passage(k[3].tolist(), k[2].tolist(), k[4])
                if words >= LEAST:
                    out.append((k[0], k[1], words, errors))
                    done = k
        columns = list(zip(*out)) or [(), (), (), ()]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "words", "errors"])

    for batch in batches:
        for doc_id, own, item_id, body, shifts in zip(*[c.to_pylist() for c in batch.columns]):
            if own != text:  # the candidates of a document follow one another
                text, doc = own, np.array(list(map(numbers.__getitem__, words_of(own))), dtype=np.int64).astype(np.int32)
            if body not in items:
                if len(items) > 2_000:
                    items.clear()
                items[body] = np.array([numbers[w] for w in words_of(body)], dtype=np.int64).astype(np.int32)
            for shift in shifts:
                kept.append((doc_id, item_id, doc, items[body], shift))
                size += len(doc) + len(items[body])
            if size > TOGETHER:
                yield results()
                kept, size = [], 0
    yield results()


def leaks(documents: DataFrame, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, words, errors): documents and items with at least LEAST words in a row, a row for each place.

    `index` is a built_index of the same documents, where there is one already.
    """
    index = built_index(documents) if index is None else index
    bodies = checkpointed(item_bodies(items))
    pairs = checkpointed(candidates(index, questions(index, bodies)))
    # The pairs are few against the documents: in memory if they are, else both sides are shuffled.
    texts = documents.select("doc_id", "text").join(broadcast_if_small(pairs, MOST_PAIRS), "doc_id")
    full = texts.join(bodies.withColumnRenamed("text", "body"), "item").select("doc_id", "text", "item_id", "body", "shifts")
    return full.mapInArrow(_measured, "doc_id bigint, item_id bigint, words int, errors int")


def _tables(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, folder, "documents", "doc_id", "text"), read_table(spark, folder, "eval_items", "item_id", "text")


def p7_found(spark, folder: str) -> DataFrame:
    return leaks(*_tables(spark, folder)).select("doc_id", "item_id").distinct()


def p7_items(spark, folder: str) -> DataFrame:
    """Each leaked item with its number of documents and its longest passage."""
    return (
        leaks(*_tables(spark, folder))
        .groupBy("item_id")
        .agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest_passage"))
    )
