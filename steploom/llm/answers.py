"""Defective prompt and response pairs (problem 2).

Five defects of an answer field, of which it has at most one, in this order: empty, refusal,
copied_prompt, other_language, truncated.

* copied_prompt: the answer's tokens are aligned with those of its prompt, first by containment of
  five-word shingles, and between the two thresholds by their longest common subsequence.
* refusal: each sentence is aligned with refusal templates, first by containment of the template's word
  pairs, then by the longest common subsequence with a stretch of the sentence not much longer.
* other_language: nearest centroid of the language model fitted on the labelled documents; a text that
  all centroids are far from and that has no English function words is in another language too.
* truncated: a cut mark, an open bracket, quote or code span, or an ending after which all other
  answers go on. The last is read from counts of word sequences over all answers of the table.

Defined results: null and blank answers and stand-ins for none are empty; rows with a null prompt_id
are left out; of rows with the same prompt_id the last received counts; an answer without prompt is
never copied; answers of any length are read whole; without labelled documents only function words
tell the language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.llm.languages import Model, fit_on
from steploom.operators.joins import spread_join
from steploom.sources.tables import BROADCAST_LIMIT_ROWS, checkpointed, read_table

FIELDS = ["evidence_summary", "next_action_description", "why_this_action"]
PROMPT_TEXTS = ["recent_context_text", "recent_actions_summary", "repeated_pattern_summary"]
SHINGLE = 5
CONTAINED = 0.8
#: From this containment on the longest common subsequence decides.
PERHAPS = 0.25
COMMON = 0.85
#: Share of a refusal template's word pairs from which it is aligned, and share of its words in common.
PAIRS = 0.3
ALIGNED = 0.8
#: Words that a refusal may put between those of its template.
FREE = 3

# Stand-ins for no answer, refusal templates, words of one role in them, cut marks, function words.
STAND_INS = set(
    "none null nil na nan noanswer empty notavailable notapplicable undefined unknown noresponse nocontent tbd todo "
    "blank missing nodata nothing placeholder noanswergiven notprovided noreply noinformation pending".split()
)
REFUSALS = """
i cannot help with this
this is something i cannot help with
this is not something i can help with
i cannot do this request
sorry but i cannot help
i will not answer this
i will not continue with this request
i cannot answer
i am not able to answer this
i am not able to answer on
i am not able to give an answer
i cannot give an answer
i must decline to answer
i decline to answer
i must decline this request
i refuse to answer
i would prefer not to answer
i would prefer to leave this unanswered
i must pass on this
i am not comfortable answer this
it would not be appropriate for me to answer
it is not appropriate to answer this
this request falls outside of what i am permitted to answer
this is outside of what i am permitted to do
this is outside my scope
answer this goes against my rules
give this goes against my rules
give steps goes against my rules
this is against my rules
my rules do not permit me to answer
my rules do not permit this
i am not permitted to answer
i have been told not to answer
i have been told not to give an answer
as an assistant i cannot answer
as an assistant i am not able to
i am only an assistant
i have no means of answer
i am not in a position to answer
i have nothing to answer on this
no comment
no answer from me
""".strip().split("\n")
ROLES = {
    "i": "i we id ill",
    "cannot": "cant cannot couldnt",
    "answer": "answer answering help assist helping assisting comment commenting advise advising respond reply discuss elaborate recommend "
    "recommending suggest suggesting propose proposing judge judging decide deciding say saying engage share support opine evaluate guess assess participate proceed",
    "answer_": "advice recommendation recommendations suggestion suggestions opinion answers guidance response proposal verdict assessment judgement",
    "give": "give giving provide providing offer offering make making",
    "this": "this that it here these those one such",
    "request": "request question task prompt matter topic query inquiry subject",
    "permitted": "permitted permit allowed allow authorised authorized authorise let able_",
    "rules": "rules guidelines guideline policy policies instructions principles directives",
    "assistant": "assistant ai model bot",
    "told": "told asked instructed directed",
    "prefer": "prefer rather",
    "must": "must have_to",
    "outside": "outside beyond",
    "goes": "goes is",
    "appropriate": "appropriate right proper suitable ethical",
}
#: What a refusal is about: a template's words of these roles may not be missing.
CORE = {"answer", "request", "permitted", "rules", "appropriate", "assistant", "unanswered", "outside", "decline", "refuse", "pass", "continue", "comfortable"}
SPELLED_OUT = {
    "can't": "cannot", "can not": "cannot", "cant": "cannot", "couldn't": "could not", "won't": "will not", "wont": "will not", "wouldn't": "would not",
    "don't": "do not", "doesn't": "does not", "isn't": "is not", "i'm": "i am", "we're": "we are", "i'd": "i would", "we'd": "we would", "i'll": "i will",
    "we'll": "we will", "i've": "i have", "it's": "it is", "that's": "that is", "unable to": "not able to", "could not": "cannot", "would rather": "would prefer",
    "have to": "must", "need to": "must", "has to": "must", "respectfully": "", "large language model": "assistant", "language model": "assistant", "ai model": "assistant",
    "ai assistant": "assistant",
}
CUT_MARK = re.compile(
    r"(?:\.\.\.|…|[\[<({]\s*(?:truncated|cut|cut off|output cut|snip|snipped|continued|more|max[_ ]?tokens|length limit)\s*[\]>)}]|<\|[^|>]*\|?>?)\s*$",
    re.I,
)
ENDS = ".!?。！？"
MARKS = ENDS + ",;:()"
#: Contexts a worker counts before it hands them on.
MOST_COUNTED = 500_000
CLOSERS = "\"'`)]}»”’*_|>"
ENGLISH = frozenset(
    "the and of to is that this it for with as be are not by from or has have which but they an at we so if then was were only both there their these "
    "than one would could should does did its other all no nothing in on a i after before still into how what why see".split()
)
SHARED = frozenset("a i no in so on an as at is was but".split())
#: English words that are words of no other language in the fixed list above.
ENGLISH_ALONE = frozenset("the and of that this it with are from has have which they then were there their these than would could should does not because".split())

_TOKEN = re.compile(r"[^\W_]+")
_ASCII = {c: c if chr(c).isalnum() else " " for c in range(128)}
_QUOTED = re.compile(r"`[^`]*`|\"[^\"\n]{0,200}\"")
_FILE = re.compile(r"\w+\.(?:py|go|ts|js|yaml|toml|json)\b")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?,;:()…。]")
_SENTENCE_END = re.compile(r"(?<=[.!?;:])\s+|[\n。！？]+")
CODE = "qqcode"
_EMPTY = re.compile(r"[\W_]+")


def is_empty(text: str | None) -> bool:
    core = _EMPTY.sub("", text.lower()) if text else ""
    return not core or core in STAND_INS


_ROLE = {w: role.rstrip("_") for role, words in ROLES.items() for w in words.split()}
_SPELLING = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, SPELLED_OUT), key=len, reverse=True)) + r")\b")


def roles(text: str) -> list[list[str]]:
    """The sentences of a text as words by their role in a refusal."""
    t = re.sub(r"[ \t]+", " ", text.lower().replace("’", "'"))
    for _ in range(2):
        t = _SPELLING.sub(lambda m: SPELLED_OUT[m.group()], t)
    return [[_ROLE.get(w, w) for w in _TOKEN.findall(s)] for s in _SENTENCE_END.split(t)]


_TEMPLATES = [roles(t)[0] for t in REFUSALS]
_TEMPLATES_WITH: dict[tuple[str, str], list[int]] = {}
for _n, _words in enumerate(_TEMPLATES):
    for _pair in {*zip(_words, _words[1:])}:
        _TEMPLATES_WITH.setdefault(_pair, []).append(_n)
#: Every template has one of these, so a sentence without any is none.
_REFUSING = re.compile(r"can'?t|cannot|can not|n't|\bnot\b|\bwont\b|unable|declin|refus|\bpass\b|outside|beyond|against|\bno\b|unanswered|nothing|\bonly\b", re.I)


def is_refusal(text: str) -> bool:
    if not _REFUSING.search(text):
        return False
    for words in roles(text):
        hits = Counter(n for pair in {*zip(words, words[1:])} for n in _TEMPLATES_WITH.get(pair, ()))
        for n, shared in hits.items():
            template = _TEMPLATES[n]
            if shared >= PAIRS * (len(template) - 1) and _aligned(template, words):
                return True
    return False


def _aligned(template: list[str], words: list[str]) -> bool:
    """Whether a stretch of the sentence has ALIGNED of the template's words in order; a short template stands alone and whole."""
    if len(template) < 4:
        return words[: len(template)] == template and len(words) <= len(template) + FREE
    least = max(4, -(-ALIGNED * len(template) // 1))
    width = len(template) + FREE
    core = CORE.intersection(template)
    first = {i for i, w in enumerate(words) if w in template[:2]}
    return any(core.issubset(words[i : i + width]) and common_length(template, words[i : i + width]) >= least for i in first)


def tokens(text: str) -> list[str]:
    low = text.lower()
    return low.translate(_ASCII).split() if low.isascii() else _TOKEN.findall(low)


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit per token of `a`."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for t in b:
        if m := where.get(t):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def _shingles(words: list[str], k: int) -> list[tuple[str, ...]]:
    return list(zip(*[words[i:] for i in range(k)]))


class Prompt:
    """The token sequence of a prompt with its shingles by length."""

    def __init__(self, texts: list[str]) -> None:
        self.tokens = [t for text in texts for t in [*tokens(text), "\0"]]
        self.shingles: dict[int, set[tuple[str, ...]]] = {}

    def of(self, k: int) -> set[tuple[str, ...]]:
        if k not in self.shingles:
            self.shingles[k] = set(_shingles(self.tokens, k))
        return self.shingles[k]

    def copied(self, text: str) -> bool:
        own = tokens(text)
        if len(own) < 3 or not self.tokens:
            return False
        # A lead-in such as "Context:" and words cut at either end are no part of the copy.
        k = min(SHINGLE, len(own))
        have = self.of(k)
        mine = _shingles(own, k)
        share = sum(s in have for s in mine) / len(mine)
        if share >= CONTAINED:
            return True
        if share < PERHAPS and len(own) >= 2 * SHINGLE:
            return False
        if len(own) < 2 * SHINGLE:
            inner = own[1:-1] if len(own) > 4 else own
            inside = tuple(inner) in self.of(len(inner))
            return inside and len(inner) >= 3 or common_length(own, self.tokens) == len(own) and share > 0
        return common_length(own, self.tokens) >= COMMON * len(own)


def plain(text: str) -> str:
    """The words of a text without code, paths, names in code and numbers."""
    if "`" in text or '"' in text:
        text = _QUOTED.sub(" ", text)
    return " ".join(w for w in text.split() if not ("/" in w or "_" in w or any(c.isdigit() for c in w) or _FILE.search(w)))


def is_english(words: list[str]) -> bool:
    """A quick test: many words that English alone has. What passes needs no model."""
    return sum(w in ENGLISH_ALONE for w in words) >= max(1, 0.1 * len(words))


def is_other_language(text: str, model: Model) -> bool:
    if is_english(tokens(text)):
        return False
    own = plain(text)
    words = _WORD.findall(own.lower())
    if not words or is_english(words):
        return False
    foreign = not any(w in ENGLISH and w not in SHARED for w in words) and (len(words) >= 4 or not own.isascii())
    [(code, _, accepted)] = model.classify([" ".join(words)])
    return code != "en" and (accepted or foreign)


def pieces(text: str) -> list[str]:
    """Words and marks, with code, paths, names and numbers as one sign."""
    low = text.lower()
    if "`" in low or '"' in low:
        low = _QUOTED.sub(f" {CODE} ", low)
    out: list[str] = []
    for w in low.split():
        if w.isalpha():
            out.append(w)
        elif "/" in w or "_" in w or any(c.isdigit() for c in w) or _FILE.search(w):
            out.append(CODE)
            if w[-1] in ".!?,;:)…":
                out.append(w[-1])
        else:
            out += _PIECE.findall(w)
    return out


def ending(text: str) -> str | None:
    """'cut' or 'whole' where the text alone tells; 'open' if it ends in a word."""
    t = text.rstrip()
    if CUT_MARK.search(t) or t.count("`") % 2 or t.count('"') % 2 or t.count("(") > t.count(")") or t.count("[") > t.count("]"):
        return "cut"
    last = t[-1]
    if last in ENDS or last in CLOSERS:
        return "whole"
    return "cut" if last in ",;:-–—/&=(" else "open"


def classify(text: str | None, prompt: Prompt, model: Model) -> str:
    if is_empty(text):
        return "empty"
    if is_refusal(text):
        return "refusal"
    if prompt.copied(text):
        return "copied_prompt"
    if is_other_language(text, model):
        return "other_language"
    return {"cut": "truncated", "whole": "", "open": "open"}[ending(text)]


def _contexts(words: list[str], i: int) -> list[str]:
    """The word at i with up to three before it in its sentence, longest first."""
    lead = []
    for j in range(i, max(-1, i - 4), -1):
        if j < i and words[j] in ENDS:
            lead.append("^")
            break
        lead.append(words[j])
        if j == 0 and len(lead) < 4:
            lead.append("^")
            break
    lead.reverse()
    return [" ".join(lead[s:]) for s in range(len(lead))]


def _classifier(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, prompt = None, Prompt([])
        for batch in batches:
            cols = batch.to_pydict()
            out: list[tuple] = []
            for i, prompt_id in enumerate(cols["prompt_id"]):
                texts = [t for t in cols["_prompt"][i] or [] if t]
                if texts != last:  # the responses to a prompt follow one another
                    last, prompt = texts, Prompt(texts)
                for field in FIELDS:
                    text = cols[field][i]
                    kind = classify(text, prompt, model)
                    out.append((prompt_id, field, kind, text if kind in ("", "open") else None))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["prompt_id", "field_name", "defect_type", "text"])

    return run


def _counter(last_words: set[str] | None):
    """(context, times it ended a sentence, times seen) of the contexts that end in one of `last_words`, or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: Counter[str] = Counter()
        seen: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            keys = list(seen)
            arrays = [pa.array(keys, pa.string()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["context", "ends", "seen"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = pieces(text)
                for i in range(len(words) - 1):
                    if words[i] in MARKS or last_words is not None and words[i] not in last_words:
                        continue
                    stop = words[i + 1] in ENDS
                    for c in _contexts(words, i):
                        seen[c] += 1
                        if stop:
                            ends[c] += 1
            if len(seen) > MOST_COUNTED:
                yield counted()
                ends.clear()
                seen.clear()
        yield counted()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts at the end of each open answer, with their length."""
    for batch in batches:
        out: list[tuple] = []
        for prompt_id, field, text in zip(*[c.to_pylist() for c in batch.columns]):
            words = pieces(text)
            while words and words[-1] in ",;:()":
                words.pop()
            if words:
                found = _contexts(words, len(words) - 1)
                out += [(prompt_id, field, c, len(found) - n) for n, c in enumerate(found)]
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.int32())],
            ["prompt_id", "field_name", "context", "n"],
        )


def defects(responses: DataFrame, prompts: DataFrame, model: Model) -> DataFrame:
    """One row per prompt and defective field: prompt_id, field_name, defect_type."""
    latest = (
        responses.where(F.col("prompt_id").isNotNull())
        .groupBy("prompt_id")
        .agg(F.max(F.struct("received_at", "released_prefix_id", *FIELDS)).alias("r"))
        .select("prompt_id", "r.released_prefix_id", *[f"r.{f}" for f in FIELDS])
    )
    latest = checkpointed(latest)
    # All texts of a prompt id: equal ones once, as a prefix is re-sent under two pool names.
    texts = (
        prompts.where(F.col("released_prefix_id").isNotNull())
        .select("released_prefix_id", F.explode(F.array(*PROMPT_TEXTS)).alias("t"))
        .where(F.col("t").isNotNull())
        .distinct()
        .groupBy("released_prefix_id")
        .agg(F.sort_array(F.collect_list("t")).alias("_prompt"))
    )
    # A prompt that many responses answer is cut into parts. Null prefixes match nothing.
    each = spread_join(latest, texts, ["released_prefix_id"], "prompt_id", "left").select("prompt_id", *FIELDS, "_prompt")
    first = checkpointed(each.mapInArrow(_classifier(model), "prompt_id string, field_name string, defect_type string, text string"))

    asked = (
        first.where("defect_type = 'open'")
        .select("prompt_id", "field_name", "text")
        .mapInArrow(_asked, "prompt_id string, field_name string, context string, n int")
    )
    asked = checkpointed(asked)
    # Only contexts that are asked for need counts. Their last words are few; beyond the bound all are counted.
    last = asked.where("n = 1").select("context").distinct().limit(BROADCAST_LIMIT_ROWS + 1).collect()
    words = {r.context for r in last} if len(last) <= BROADCAST_LIMIT_ROWS else None
    counts = (
        first.where("text IS NOT NULL")
        .select("text")
        .mapInArrow(_counter(words), "context string, ends bigint, seen bigint")
        .groupBy("context")
        .agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen"))
    )
    # Distinct contexts are counted once, so a frequent ending is a single row until it is joined.
    known = asked.select("context").distinct().join(counts, "context")
    # The longest context that occurs elsewhere decides; an ending seen nowhere else is a cut word.
    cut = (
        spread_join(asked, known, ["context"], "prompt_id", "left")
        .groupBy("prompt_id", "field_name")
        .agg(F.max(F.when(F.col("seen") >= 1, F.struct("n", (F.col("ends") / F.col("seen")).alias("share")))).alias("best"))
        .where(F.coalesce(F.col("best.share"), F.lit(0.0)) < 0.5)
        .select("prompt_id", "field_name", F.lit("truncated").alias("defect_type"))
    )
    sure = first.where("defect_type NOT IN ('', 'open')").select("prompt_id", "field_name", "defect_type")
    return sure.unionByName(cut)


def p2_found(spark, folder: str) -> DataFrame:
    return defects(
        read_table(spark, folder, "api_replan_parsed_responses", "prompt_id", "released_prefix_id", "received_at", *FIELDS),
        read_table(spark, folder, "prefix_replan_sample", "released_prefix_id", *PROMPT_TEXTS),
        fit_on(read_table(spark, folder, "documents", "doc_id", "lang", "text")),
    )


def p2_rates(spark, folder: str) -> DataFrame:
    """Defective answers per field and type."""
    return p2_found(spark, folder).groupBy("field_name", "defect_type").agg(F.count(F.lit(1)).alias("answers"))
