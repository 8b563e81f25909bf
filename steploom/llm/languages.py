"""Languages of documents and of the segments of mixed ones (problem 8).

A text is cut into sentences; code blocks, commands, log lines, paths and names in code are taken out.
A sentence is a vector of hashed character trigrams of its words, padded with blanks (of scripts without
blanks: of single characters and pairs too), weighted by TF-IDF and normalised. It takes the language of
its nearest centroid by cosine, of several clustered centroids per language; if the nearest one is too
far, or a second language almost as near, it is rejected and counts for no language. Its confidence
comes from these two distances.

The n-grams of a word, and its share in the product with each centroid, are kept by word, as text
repeats words; sentences are all worked out.

The centroids are fitted on a bounded sample of labelled documents: at most SAMPLE_PER_LABEL per
language, chosen by a hash of doc_id. Labels may be wrong, so sentences that lie nearer to another
language's mean than to their own are dropped before the clusters are made. Every document and every
sentence is then classified. A sentence of fewer than LEAST_LETTERS letters counts by itself if it is
clearly of its language (CLEAR times the margin); else it belongs to its neighbours.

Defined results: null and blank texts have no language; a text without any accepted sentence takes the
language of all its words together, or none if that is rejected too; rows with a null doc_id are left
out of p8_found; a language without labelled sample rows cannot be found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from steploom.functions.parse import lookup
from steploom.sources.tables import read_table

#: Bound of the sample the classifier is fitted on: documents for each language.
SAMPLE_PER_LABEL = 150
#: Longest part of a sample document used in fitting. Classification reads whole texts.
SAMPLE_CHARS = 20_000
CLUSTERS = 4
BUCKETS = 1 << 14
#: Words and n-grams a worker keeps; beyond either, it forgets them all.
MEMO_WORDS, MEMO_GRAMS = 1 << 17, 1 << 22
LEAST_LETTERS = 18
#: Fewer letters than this say nothing.
FEWEST_LETTERS = 8
CLEAR = 3.0
#: The nearest centroid must be nearer than the next language's by this share of its cosine.
MARGIN = 0.12
#: A cosine below this share of what one in a hundred sample sentences of the centroid falls below is too far.
FLOOR = 0.38

# The nine languages with their usual codes and names.
LANGUAGE_NAMES = {
    "en": "en eng english anglais englisch inglés ingles inglese",
    "de": "de deu ger german deutsch allemand",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish",
    "ru": "ru rus russian русский",
    "ja": "ja jpn japanese 日本語",
}
# Further two-letter codes and names that name a language, though none of the nine.
OTHER_CODES = (
    "ar bg bn ca cs da el et eu fa fi ga gl he hi hr hu id is ka ko lt lv mk ms no nb nn pl ro sk sl sq sr sv sw ta te th tr uk ur vi zh"
)
_LABELS = {spelling: code for code, names in LANGUAGE_NAMES.items() for spelling in names.split()} | {
    c: c for c in OTHER_CODES.split()
}


def label_code(label: Column) -> Column:
    """The language a label names: its code in the usual spellings, null if it names none."""
    low = F.lower(F.trim(label))
    return F.coalesce(lookup(low, _LABELS), lookup(F.regexp_extract(low, r"^([a-z]{2,3})[-_][a-z0-9-_]+$", 1), _LABELS))


_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_CODE_LINE = re.compile(
    r"^[ \t]*(?:[$>#]\s+(?:git|pytest|python|ls|grep|cd|npm|make|cat|sed|docker|pip|curl|bash|sh)\b.*"
    r"|\d+ files? changed.*|FAILED .*|Traceback .*|File \".*|(?:def|class|return|import|from|self\.)\b.*[()=.:].*"
    r"|\S+:\d+: ?\w*(?:Error|Exception|Warning)\b.*|\w*(?:Error|Exception): .*|[+-]{1,3}\s*\w+\(.*|\[?\d{4}-\d\d-\d\d[T ]\d\d:.*|(?:DEBUG|INFO|WARN|WARNING|ERROR)\b.*)$",
    re.M,
)
_MARKUP = re.compile(r"<[^<>\n]{1,80}>|&\w{2,6};|\*\*|__|`[^`\n]*`|https?://\S+")
_NAME_IN_CODE = re.compile(r"(?:[A-Za-z0-9_.-]*/[A-Za-z0-9_./-]*|[A-Za-z0-9]+_[A-Za-z0-9_]+|[A-Za-z0-9_]+\.(?:py|go|ts|js|yaml|toml|json|md)\b|[A-Za-z_]*\d[A-Za-z0-9_.]*)")
_SENTENCE = re.compile(r"[^.!?。！？\n\r]+(?:[.!?。！？]+(?!\w)|[.!?](?=\w)[^.!?。！？\n\r]*)*")
_NO_LETTER = re.compile(r"[^\w'’]+|_|\d+")
_PUNCTUATION = ".,;:!?()[]\"'’«»„“”"


def words_of(sentence: str) -> list[str]:
    """The words of a sentence without names in code and numbers."""
    out = []
    for w in sentence.split():
        if w.isalpha():
            out.append(w)
            continue
        w = w.strip(_PUNCTUATION)
        if w.isalpha():
            out.append(w)
        elif w:
            out += _NO_LETTER.sub(" ", _NAME_IN_CODE.sub(" ", w)).split()
    return out


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence of `text`; the words are in lower case."""

    def blank(m: re.Match) -> str:
        return " " * (m.end() - m.start())

    clean = _FENCE.sub(lambda m: "\n" * (m.end() - m.start()), text) if "```" in text else text
    clean = _MARKUP.sub(blank, _CODE_LINE.sub(blank, clean))
    low = clean.lower()
    if len(low) != len(clean):  # a few letters change their length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in clean)
    out = []
    for m in _SENTENCE.finditer(low):
        if words := words_of(m.group()):
            out.append((m.start(), m.end(), words))
    return out


def _letters(words: list[str]) -> int:
    # A letter of a script without blanks says as much as three others.
    return sum(len(w) if w.isascii() or w[0] < "⺀" else 3 * len(w) for w in words)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of each word in a row, and how many each word has."""
    joined = "\0".join(f" {w} " for w in words) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    row = np.cumsum(codes == 0) - (codes == 0)
    rows, hashes = [], []

    def add(inside: np.ndarray, h: np.ndarray) -> None:
        rows.append(row[: len(inside)][inside])
        hashes.append(h[inside])

    live, dense = codes != 0, codes >= 0x2E80
    add(live[:-2] & live[1:-1] & live[2:], (codes[:-2] * 1_000_003 + codes[1:-1]) * 1_000_003 + codes[2:])
    add(live[:-1] & live[1:], codes[:-1] * 1_000_033 + codes[1:] * 31 + 2)
    add(dense, codes * 7919 + 1)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(row, kind="stable")
    h = (h[order] * 0x9E3779B1 & 0x7FFFFFFFFFFFFFFF) >> 20
    return (h % BUCKETS).astype(np.int32), np.bincount(row, minlength=len(words))


class Memory:
    """The n-grams of words, kept by word, and for each word the sum of a table's rows at its n-grams."""

    def __init__(self, table: np.ndarray | None = None) -> None:
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.buckets, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.sums = None if self.table is None else np.zeros((0, self.table.shape[1]), np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > MEMO_WORDS or len(self.buckets) > MEMO_GRAMS:
            self.clear()
        number = self.number
        new = [w for w in dict.fromkeys(words) if w not in number]
        if new:
            buckets, sizes = grams(new)
            for i, w in enumerate(new, len(number)):
                number[w] = i
            self.buckets, self.sizes = np.concatenate([self.buckets, buckets]), np.concatenate([self.sizes, sizes])
            if self.table is not None:  # every word has a trigram, so no slice is empty
                sums = np.add.reduceat(self.table[buckets], np.cumsum(sizes) - sizes, axis=0)
                self.sums = np.concatenate([self.sums, sums.astype(np.float32)])
            self.starts = np.cumsum(self.sizes) - self.sizes
        return np.fromiter((number[w] for w in words), dtype=np.int64, count=len(words))

    def counts(self, numbers: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, count) of the n-grams of rows of words, sorted by row."""
        size = self.sizes[numbers]
        at = np.arange(int(size.sum())) + np.repeat(self.starts[numbers] - (np.cumsum(size) - size), size)
        key = np.repeat(row, size) * BUCKETS + self.buckets[at]
        if len(row) and row[-1] < (1 << 31) // BUCKETS - 1:
            key = key.astype(np.int32)
        key, count = np.unique(key, return_counts=True)
        return key // BUCKETS, key % BUCKETS, count


class Model:
    """Centroids of each language with their rejection distances."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, floor: np.ndarray, usual: np.ndarray, codes: list[str]):
        self.idf, self.centroids, self.owner, self.floor, self.usual, self.codes = idf, centroids, owner, floor, usual, codes
        self.memory: Memory | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": None}

    def cosines(self, texts: list[list[str]]) -> np.ndarray:
        """Cosine of each text, given as its words, to each centroid."""
        if self.memory is None:
            self.memory = Memory((self.idf[:, None] * self.centroids).astype(np.float32))
        out = np.zeros((len(texts), self.centroids.shape[1]), dtype=np.float32)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            numbers = self.memory.numbers([w for t in texts for w in t])
            row = np.repeat(np.arange(len(full)), sizes[full])
            r, bucket, count = self.memory.counts(numbers, row)
            norm = np.sqrt(np.bincount(r, (count * self.idf[bucket]) ** 2, minlength=len(full)))
            sums = np.add.reduceat(self.memory.sums[numbers], np.cumsum(sizes[full]) - sizes[full], axis=0)
            out[full] = sums / np.maximum(norm, 1e-9)[:, None]
        return out

    def classify(self, texts: list[str]) -> list[tuple[str | None, float, bool]]:
        """(language, confidence, accepted) of each text."""
        code, confidence, accepted, _ = self.judged([words_of(t.lower()) for t in texts])
        return list(zip(code, confidence.tolist(), accepted.tolist()))

    def judged(self, texts: list[list[str]]) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """(languages, confidences, accepted, accepted by CLEAR margins) of texts given as their words."""
        none = np.zeros(len(texts))
        if not self.codes or not texts:
            return [None] * len(texts), none, none > 0, none > 0
        cos = self.cosines(texts)
        by_language = np.stack([cos[:, self.owner == k].max(axis=1) for k in range(len(self.codes))], axis=1)
        best = by_language.argmax(axis=1)
        at = np.arange(len(texts))
        top = by_language[at, best]
        by_language[at, best] = -1
        second = np.maximum(by_language.max(axis=1), 0) if by_language.shape[1] > 1 else none
        nearest = cos.argmax(axis=1)
        lead = (top - second) / np.maximum(top, 1e-9)
        # Half of it for a cosine at the floor, whole at the centroid's usual cosine; and as much for the lead.
        close = np.clip((top - self.floor[nearest]) / np.maximum(self.usual[nearest] - self.floor[nearest], 1e-9), 0, 1)
        confidence = (0.5 + 0.5 * close) * (0.5 + 0.5 * np.clip(lead / 0.5, 0, 1))
        near = top >= self.floor[nearest]
        return [self.codes[b] for b in best], confidence, near & (lead >= MARGIN), near & (lead >= CLEAR * MARGIN)


def fit(samples: list[tuple[str, str]], clusters: int = CLUSTERS) -> Model:
    """A model from (language code, text) pairs. Empty samples give a model that finds nothing."""
    seen = Counter(
        (code, " ".join(s[2])) for code, text in samples for s in sentences(text[:SAMPLE_CHARS]) if _letters(s[2]) >= LEAST_LETTERS
    )
    parts = sorted(seen)
    codes = sorted({c for c, _ in parts})
    if not codes:
        return Model(np.ones(BUCKETS), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, int), np.zeros(0), np.zeros(0), [])
    texts, label = [t.split() for _, t in parts], np.array([codes.index(c) for c, _ in parts])
    times = np.array([seen[p] for p in parts], dtype=float)
    memory = Memory()
    row, bucket, count = memory.counts(memory.numbers([w for t in texts for w in t]), np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
    idf = np.log((1 + len(texts)) / (1 + np.bincount(bucket, minlength=BUCKETS))) + 1
    w = count * idf[bucket]
    w = w / np.maximum(np.sqrt(np.bincount(row, w * w, minlength=len(texts))), 1e-9)[row]

    def against(matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), matrix.shape[1]))
        for k in range(matrix.shape[1]):
            out[:, k] = np.bincount(row, w * matrix[bucket, k], minlength=len(texts))
        return out

    def mean(chosen: np.ndarray) -> np.ndarray:
        weight = (chosen * times)[row]
        total = np.bincount(bucket, w * weight, minlength=BUCKETS)
        return total / max(np.linalg.norm(total), 1e-9)

    # A sentence is first given to the label in which it is most frequent, then to the nearest mean.
    rate = times / np.bincount(label, times)[label]
    highest: dict[str, float] = {}
    for (_, t), r in zip(parts, rate):
        highest[t] = max(r, highest.get(t, 0.0))
    own_label = rate >= np.array([highest[t] for _, t in parts])
    kept = own_label
    for _ in range(6):
        means = np.stack([mean(kept & (label == k)) for k in range(len(codes))], axis=1)
        kept = own_label & (against(means).argmax(axis=1) == label)
    columns, owner, floor, usual = [], [], [], []
    for k in range(len(codes)):
        own = np.flatnonzero(kept & (label == k))
        if not len(own):
            continue
        groups = min(clusters, len(own))
        mine = np.zeros(len(texts), bool)
        mine[own] = True
        take = mine[row]
        r_own, b_own, w_own = np.searchsorted(own, row[take]), bucket[take], w[take]

        def near_to(matrix: np.ndarray) -> np.ndarray:
            columns_ = [np.bincount(r_own, w_own * matrix[b_own, g], minlength=len(own)) for g in range(matrix.shape[1])]
            return np.stack(columns_, axis=1)

        def mean_of(part: np.ndarray) -> np.ndarray:
            total = np.bincount(b_own, w_own * (part * times[own])[r_own], minlength=BUCKETS)
            return total / max(np.linalg.norm(total), 1e-9)

        # Spherical k-means from spread starting points; the seed is the order of the texts.
        seeds = own[np.linspace(0, len(own) - 1, groups).astype(int)]
        centre = np.stack([mean_of(own == s) for s in seeds], axis=1)
        for _ in range(8):
            group = near_to(centre).argmax(axis=1)
            for g in range(groups):
                if (group == g).any():
                    centre[:, g] = mean_of(group == g)
        near = near_to(centre)
        group = near.argmax(axis=1)
        for g in range(groups):
            if (group == g).any():
                columns.append(centre[:, g])
                owner.append(k)
                floor.append(FLOOR * np.quantile(near[group == g, g], 0.01))
                usual.append(np.quantile(near[group == g, g], 0.25))
    return Model(idf, np.stack(columns, axis=1).astype(np.float32), np.array(owner), np.array(floor), np.array(usual), codes)


def fit_on(documents: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fits on at most `per_label` documents of each label, chosen by hash; only these reach the driver."""
    labelled = documents.select("doc_id", "text", label_code(F.col("lang")).alias("code")).where(
        F.col("code").isin(*LANGUAGE_NAMES) & F.coalesce(F.trim("text") != "", F.lit(False))
    )
    counts = {r.code: r.n for r in labelled.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([])
    share = lookup(F.col("code"), {c: str(min(1.0, 4 * per_label / n)) for c, n in counts.items()}).cast("double")
    order = F.xxhash64(F.lit(7), "doc_id", "text")
    few = labelled.withColumn("h", order).where(F.pmod("h", F.lit(1_000_003)) / F.lit(1_000_003.0) < share)
    # At most about 4 * per_label rows of a label are left for the window.
    first = few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("h"))).where(F.col("n") <= per_label)
    rows = first.select("code", F.substring("text", 1, SAMPLE_CHARS).alias("text")).orderBy("code", "text").collect()
    return fit([(r.code, r.text) for r in rows])


Judged = tuple[list[tuple[int, int, str, float]], str | None, float]


def judge(model: Model, texts: list[str | None]) -> list[Judged]:
    """For each text its accepted sentences as (start, end, language, confidence), its language and confidence.

    The confidence of a text is that of its language's sentences, by letters, times their share of all letters.
    """
    parts = [sentences(t) if t else [] for t in texts]
    flat = [p for ps in parts for p in ps]
    code, confidence, accepted, clear = model.judged([p[2] for p in flat])
    confidence = confidence.tolist()
    out: list[Judged] = []
    whole: list[tuple[int, list[str]]] = []
    at = 0
    for n, ps in enumerate(parts):
        good, size, total = [], {}, 0
        for i, (a, b, words) in enumerate(ps, at):
            letters = _letters(words)
            if accepted[i] and letters >= LEAST_LETTERS or clear[i] and letters >= FEWEST_LETTERS:
                good.append((a, b, code[i], confidence[i]))
                size[code[i]] = size.get(code[i], 0.0) + letters * confidence[i]
                total += letters
        at += len(ps)
        if good:
            top = max(size, key=lambda c: (size[c], c))
            out.append((good, top, size[top] / total))
        else:
            out.append(([], None, 0.0))
            whole.append((n, [w for p in ps for w in p[2]]))
    code, confidence, accepted, _ = model.judged([w for _, w in whole])
    for (n, _), c, conf, ok in zip(whole, code, confidence.tolist(), accepted):
        out[n] = ([], c, conf) if ok else ([], None, 0.0)
    return out


def _merge(good: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Neighbouring sentences of one language as one segment with their mean confidence."""
    out: list[list] = []
    for a, b, code, conf in good:
        if out and out[-1][2] == code:
            out[-1][1] = b
            out[-1][3].append(conf)
        else:
            out.append([a, b, code, [conf]])
    return [(a, b, code, sum(c) / len(c)) for a, b, code, c in out]


def classified(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, label_code, lang_found, confidence, languages and segments of every document."""
    schema = (
        "doc_id bigint, label_code string, lang_found string, confidence double, languages array<string>, "
        "segments array<struct<start:int,end:int,lang:string,confidence:double>>"
    )
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x CLUSTERS x languages floats, about 2.4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids, labels, texts = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(ids), 256):
                out: dict[str, list] = {n: [] for n in ("doc_id", "label_code", "lang_found", "confidence", "languages", "segments")}
                for i, (good, code, conf) in enumerate(judge(own, texts[at : at + 256]), at):
                    out["doc_id"].append(ids[i])
                    out["label_code"].append(labels[i])
                    out["lang_found"].append(code)
                    out["confidence"].append(round(conf, 4))
                    out["languages"].append(sorted({g[2] for g in good} or {c for c in [code] if c}))
                    out["segments"].append([{"start": a, "end": b, "lang": c, "confidence": round(f, 4)} for a, b, c, f in _merge(good)])
                yield pa.RecordBatch.from_pydict(out, schema=_ARROW)

    return documents.select("doc_id", label_code(F.col("lang")).alias("code"), "text").mapInArrow(run, schema)


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("label_code", pa.string()), ("lang_found", pa.string()), ("confidence", pa.float64()),
        ("languages", pa.list_(pa.string())),
        ("segments", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))),
    ]
)


def _documents(spark, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents", "doc_id", "lang", "text")


def issues(languages: DataFrame) -> DataFrame:
    mixed = F.size("languages") > 1
    issue = (
        F.when(mixed, "mixed")
        .when(F.col("lang_found").isNull(), None)
        .when(F.col("label_code").isNull(), "missing")
        .when(F.col("label_code") != F.col("lang_found"), "wrong")
    )
    return (
        languages.where(F.col("doc_id").isNotNull())
        .select("doc_id", issue.alias("issue"), F.explode(F.when(mixed, F.col("languages")).otherwise(F.array("lang_found"))).alias("lang_found"))
        .where(F.col("issue").isNotNull())
    )


def p8_found(spark, folder: str) -> DataFrame:
    documents = _documents(spark, folder)
    return issues(classified(documents, fit_on(documents)))


def p8_languages(spark, folder: str) -> DataFrame:
    """Every document with its language and confidence."""
    documents = _documents(spark, folder)
    return classified(documents, fit_on(documents)).select(
        "doc_id", "label_code", "lang_found", "confidence", F.size("segments").alias("n_segments")
    )


def p8_segments(spark, folder: str) -> DataFrame:
    """Every segment of the mixed documents, as character offsets, with language and confidence."""
    documents = _documents(spark, folder)
    return (
        classified(documents, fit_on(documents))
        .where(F.size("languages") > 1)
        .select("doc_id", F.posexplode("segments").alias("segment_no", "s"))
        .select("doc_id", "segment_no", "s.start", "s.end", "s.lang", "s.confidence")
    )
