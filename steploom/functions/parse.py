"""Lenient parsers: labels, booleans, numbers and JSON. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of labels and booleans in the data.
STEP_LABELS = {
    "productive": "productive", "productive_step": "productive", "p": "productive",
    "stagnant": "stagnant", "stagnation": "stagnant", "unproductive": "stagnant",
    "uncertain": "uncertain", "neutral": "neutral",
}
SPAN_LABELS = {
    "productive_iteration": "productive_iteration", "pi": "productive_iteration",
    "unproductive_cycle": "unproductive_cycle", "uc": "unproductive_cycle",
    "uncertain": "uncertain", "unresolved": "unresolved",
    "none": "none", "no": "none",
}
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")


def lookup(c: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), c)


def slug(c: Column) -> Column:
    """Lower case letters with single underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z]+", "_")


def span_label(c: Column) -> Column:
    """One of the five span labels whatever the spelling; null if blank or unknown."""
    return lookup(F.regexp_replace(slug(c), "_?spans?$|^_+|_+$", ""), SPAN_LABELS)


def step_label(c: Column) -> Column:
    """The step label by alias; an unknown one passes in lower case, blank becomes null."""
    low = F.lower(F.trim(c))
    return F.when(low != "", F.coalesce(lookup(F.regexp_replace(slug(c), "^_+|_+$", ""), STEP_LABELS), low))


def bool_or_null(c: Column) -> Column:
    """True, false, or null for anything unknown."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def bool_known(c: Column) -> Column:
    """Unknown and null count as false."""
    return F.coalesce(bool_or_null(c), F.lit(False))


def bool_permissive(c: Column) -> Column:
    """An unknown non-empty value counts as true, blank and null as false."""
    low = F.lower(F.trim(c.cast("string")))
    return F.coalesce(bool_or_null(c), low != "", F.lit(False))


def bool_reply(c: Column) -> Column:
    """As replies spell it: true, 1, yes and y count as true."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def bool_strict(c: Column) -> Column:
    """Only true, 1 and yes count as true."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def lenient_int(c: Column) -> Column:
    """The value read as a double and cut to an integer; null if it is no finite number."""
    d = c.try_cast("double")
    return F.when(F.abs(d) < 2147483648.0, d.cast("int"))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def json_score(c: Column, name: str) -> Column:
    """{name}.score of a JSON string, at the top or under "signals", as a double; null if it is no number."""
    at = [F.get_json_object(c, f"$.{p}{name}.score").try_cast("double") for p in ("", "signals.")]
    return F.coalesce(*at)


def file_list(listed: Column, path: Column) -> Column:
    """Distinct file names of a JSON array, or of text split at ; , |, with `path` added; never null."""
    text = F.trim(F.coalesce(listed, F.lit("")))
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    names = F.transform(F.coalesce(parsed, F.split(text, r"[;,|]")), lambda x: F.trim(x))
    both = F.concat(names, F.array(F.trim(F.coalesce(path, F.lit("")))))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != "")))


def recovered_json(c: Column) -> Column:
    """(json, way) of the JSON object in a text: the whole, else a fenced block, else from the first to the last brace; json null and way none if none is valid."""
    whole = F.trim(c)
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)

    def good(x: Column) -> Column:
        # The parser stops behind the first value, so that it has to be the only one of a list.
        v = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
        one = F.schema_of_variant(v).startswith("ARRAY<OBJECT<") & F.try_variant_get(v, "$[1]", "string").isNull()
        return F.coalesce(one & x.startswith("{"), F.lit(False))

    way = F.when(good(whole), "whole").when(good(fenced), "fenced").when(good(braces), "braces").otherwise("none")
    text = F.when(good(whole), whole).when(good(fenced), fenced).when(good(braces), braces)
    return F.struct(text.alias("json"), way.alias("way"))
