"""Text functions: normal form, hashes, file names, error signatures, step types, scrubbing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from steploom.functions.parse import first_filled, lookup

# Words and patterns of the reference data.
STEP_TYPES = {
    "run": "run", "bash": "run", "python": "run", "pytest": "run", "create": "create", "edit": "edit",
    "open": "open", "read": "open", "search": "search", "grep": "search", "find": "search", "submit": "submit",
}
SHELL_TOOLS = ("bash", "run", "shell", "terminal")
COMMAND_STARTS = ("pytest", "python", "pip", "git", "ls", "grep", "find", "rg", "sed", "cat")
FILE_ENDINGS = "py|js|ts|tsx|jsx|json|yaml|yml|toml|ini|cfg|md|txt|csv|sh|sql|java|go|rs|cpp|c|h|hpp"
#: Under a folder any ending; alone one of the list. The first ending of the list that fits is taken.
FILE_NAME = rf"(?i)((?:/|\\)?(?:[A-Za-z0-9_.-]+(?:/|\\))+[A-Za-z0-9_.@%+=:,~-]+\.[A-Za-z0-9_]+|[A-Za-z0-9_.-]+\.(?:{FILE_ENDINGS}))"
FILE_EDGES = "`'\"()[]{}.,;:"
ERROR_NAME = r"\b[A-Za-z_][A-Za-z0-9_]*(Error|Exception)\b(:\s*[^\n\r]+)?"
ERROR_LINES = (ERROR_NAME, r"\bFAILED\b[^\n\r]*", r"(?i)\berrors?:[^\n\r]*", r"(?i)\btraceback \(most recent call last\)")
ERROR_WORDS = r"(?i)error|failed|exception|traceback"
SIGNATURE_LENGTH = 240
SCRUB = (
    (r"sk-[A-Za-z0-9_-]{8,}", "<TOKEN>"),
    (r"(?i)Bearer\s+[A-Za-z0-9._-]{8,}", "Bearer <TOKEN>"),
    (r"""(?i)\b(api[_-]?key|access[_-]?token|secret|password)\s*=\s*"[^"]{4,}\"""", '\\1 = "<REDACTED_SECRET>"'),
    (r"(?i)\b(api[_-]?key|access[_-]?token|secret|password)\s*=\s*'[^']{4,}'", "\\1 = '<REDACTED_SECRET>'"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    (r"[A-Za-z]:\\[^\s,;:]+", "<LOCAL_PATH>"),
    (r"/home/[^\s,;:]+", "<LOCAL_PATH>"),
    (r"https?://[^\s)]+", "<URL>"),
    (r"\s+", " "),
)
#: Paths and trajectory ids, behind SCRUB's signs and before its blanks: a URL is one sign before its path could be taken for a project's.
SCRUB_PATHS = (
    (r"\\\\wsl\.localhost\\[^\s,;:]+", "<LOCAL_PATH>"),
    (r"(?<!:)/[A-Za-z0-9_.-]+/([A-Za-z0-9_./-]+)", "<PROJECT_PATH>/\\1"),
    (r"(?<!:)/[A-Za-z0-9_.-]+(?=[\s),;]|$)", "<PROJECT_PATH>"),
    (r"(?:<PROJECT_PATH>)+", "<PROJECT_PATH>"),
    (r"[A-Za-z0-9_.-]+__[A-Za-z0-9_.-]+-\d+__train-\d+-of-\d+__row_\d+__[A-Za-z0-9]+", "<TRAJECTORY_ID>"),
)


def normal(c: Column) -> Column:
    """Lower case, single blanks, numbers and hex words as signs, trimmed; null becomes ''."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\b\d+\b", "<num>"), r"0x[0-9a-f]+", "<hex>")
    return F.trim(t)


def short_hash(c: Column) -> Column:
    """The first 16 hex digits of SHA-1; '' for a blank text."""
    return F.when(F.trim(c) != "", F.substring(F.sha1(c), 1, 16)).otherwise("")


def file_names(*texts: Column) -> Column:
    """Distinct file names in texts in the order they appear, without brackets, quotes and marks around them."""
    found = [F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(FILE_NAME), 0) for c in texts]
    names = F.concat(*found) if len(found) > 1 else found[0]
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.btrim(x, F.lit(FILE_EDGES))), lambda x: x != ""))


def error_signature(*texts: Column) -> Column:
    """The first error pattern of the first filled text in normal form, cut to 240 characters; '' if none."""
    t = F.coalesce(first_filled(*texts), F.lit(""))
    hits = [F.nullif(F.regexp_extract(t, p, 0), F.lit("")) for p in ERROR_LINES]
    fallback = F.when(F.regexp_like(t, F.lit(ERROR_WORDS)), F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, SIGNATURE_LENGTH))
    return F.substring(normal(F.coalesce(*hits, fallback)), 1, SIGNATURE_LENGTH)


def step_type(action: Column, tool: Column) -> Column:
    """The kind of step by its first word; an unknown word passes; '' for a step without words."""
    first = F.lower(F.element_at(F.split(first_filled(tool, action), r"\s+"), 1))
    return F.coalesce(lookup(first, STEP_TYPES), first, F.lit(""))


def command_text(action: Column, tool: Column, given: Column) -> Column:
    """The command of a shell step, or an action that starts like a command; else ''."""
    starts = normal(action).rlike(f"^({'|'.join(COMMAND_STARTS)}) ")
    return F.when(normal(tool).isin(*SHELL_TOOLS), F.coalesce(first_filled(given, action), F.lit(""))).when(starts, action).otherwise("")


def scrubbed(c: Column, limit: int | None = None) -> Column:
    """Tokens, quoted secrets, e-mails, URLs, paths and trajectory ids as signs, single blanks, cut at `limit`."""
    t = F.coalesce(c, F.lit(""))
    for pattern, sign in (*SCRUB[:-1], *SCRUB_PATHS, SCRUB[-1]):
        t = F.regexp_replace(t, pattern, sign.replace("\\1", "$1"))
    t = F.trim(t)
    if limit is None:
        return t
    cut = F.concat(F.rtrim(F.substring(t, 1, limit - 20)), F.lit(" ... <truncated>"))
    return F.when(F.length(t) > limit, cut).otherwise(t)
