"""Credentials in code, commands and configuration (problem 5).

One deterministic automaton holds the fixed beginning of every grammar: token formats, key armor,
connection strings, headers, options, assignments. It reads a text once, in overlapping chunks; at each
place where it stops, the grammars with that beginning are matched from there to their own end, however
long the value is. Absolute spans are deduplicated and the values replaced; quotes, keywords and
separators stay, so the code around keeps its form.

Defined results: null and empty texts hold nothing. Placeholders, variables and lookups are told by their
grammar (<...>, ***, xxx, [REDACTED], changeme; $NAME, ${...}, $(...), %NAME%, {{...}}, {name}; calls and
attributes outside quotes), so a value that only begins like one is a secret. Type names, None/null,
public keys, certificates, checksums and ids are no secrets. A string literal split by + is masked in
each part. Key armor that is cut off before its end is masked to the last line of key text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame

from steploom.llm.textscan import Span, found, records, redacted, settle

FIELDS = ["command_text", "observation_text", "recent_context_text"]
CHUNK = 65_536
#: Longer than any fixed part, so that none is lost between two chunks.
OVERLAP = 128

# Public token formats by their first characters.
TOKEN_FORMATS = {
    "sk-": r"sk-[A-Za-z0-9_-]{16,}",
    "sk_live_": r"[a-z]*sk_live_[A-Za-z0-9]{12,}",
    "rk_live_": r"rk_live_[A-Za-z0-9]{12,}",
    "ghp_": r"ghp_[A-Za-z0-9]{20,}",
    "gho_": r"gho_[A-Za-z0-9]{20,}",
    "ghs_": r"ghs_[A-Za-z0-9]{20,}",
    "github_pat_": r"github_pat_[A-Za-z0-9_]{20,}",
    "glpat-": r"glpat-[A-Za-z0-9_-]{16,}",
    "xoxb-": r"xoxb-[A-Za-z0-9-]{12,}",
    "xoxp-": r"xoxp-[A-Za-z0-9-]{12,}",
    "xoxa-": r"xoxa-[A-Za-z0-9-]{12,}",
    "akia": r"AKIA[A-Z0-9]{16}",
    "asia": r"ASIA[A-Z0-9]{16}",
    "aiza": r"AIza[A-Za-z0-9_-]{30,}",
    "npm_": r"npm_[A-Za-z0-9]{20,}",
    "pypi-": r"pypi-[A-Za-z0-9_-]{16,}",
    "lsk_": r"lsk_(?:live|test)_[A-Za-z0-9]{12,}",
    "eyj": r"eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{4,}){2}",
}
PASSWORD_WORDS = ("password", "passwd", "passphrase", "passwort", "pwd", "_pw", "-pw", "_pass", "sshpass")
TOKEN_WORDS = (
    "token", "api_key", "apikey", "api-key", "api key", "access_key", "access-key", "accesskey", "secret", "auth_key", "auth-key", "authkey",
    "signing_key", "signing key", "signing-key", "old key", "new key", "live key", "prod key", "current key", "signature", "sig=", "sig:", "sig\"", "credential",
)
PLACEHOLDER = re.compile(
    r"(?i)<[^<>]*>|\$[A-Z_][A-Z0-9_]*|\$\(.*|.*\$\{.*|%[A-Z_]\w*%|%[sdr]|%\(\w+\)s|\{\{.*|\{[\w.:]*\}|\[[\w .-]*\]|\(\w*\)|&\w{2,8};"
    r"|\*+|x{3,}|\.{3,}|-+|none|null|nil|undefined|true|false|str|string|text|bytes|int|any|optional.*|required|change[-_]?me|placeholder|example|dummy|redacted|"
    r"masked|hidden|secret|password|passwd|pwd|token|your[-_ ].*|my[-_ ]?(?:password|token|secret)|todo|tbd|n/a|empty|stdin|file"
)
#: A call, an attribute or an item of something: only outside quotes.
LOOKUP = re.compile(r"(?i)(?:os\.|process\.|config|settings|env|self|request|ctx|args|options|vault|next|get)[\w.]*[\[(.].*|[A-Z_][\w.]*\[.*|\$[A-Z_({].*|[{(\[].*")
_LITERAL = r"""(?:"(?P<q2>(?:[^"\\\n]|\\.)*)"|'(?P<q1>(?:[^'\\\n]|\\.)*)'|`(?P<q0>[^`\n]*)`)"""
_BARE = r"""(?P<bare>[^\s"'`;&,<>()\\\]}|]+)"""
_NAME_END = r"""[\w-]*\\?["']?\]?\s{0,3}(?::=|=>|->|=|:|,(?=\s{0,2}["'`]))\s{0,3}\\?"""

RE_PASSWORD = re.compile(rf"(?:pass(?:word|wd|phrase|wort)?|pwd|[_-]pw|sshpass){_NAME_END}(?:{_LITERAL}|{_BARE})", re.I)
RE_PASSWORD_OPTION = re.compile(rf"(?:--pass(?:word|wd)?|sshpass\s+-p|login\s+\S+\s+password)\s{{1,3}}(?:{_LITERAL}|{_BARE})", re.I)
RE_PASSWORD_ENV = re.compile(rf"(?<!\w)(?:ENV|ARG|setenv|set)\s+\w*(?:PASSWORD|PASSWD|PW|PASS|PWD)\s+(?:{_LITERAL}|{_BARE})")
RE_PASSWORD_PROSE = re.compile(r"(?:password|passwd|passphrase)\b[^\n:=\"'(]{0,40}?\b(?:is|was|now)\s+[\"'`]?(?P<bare>[^\s\"'`,;]+)", re.I)
RE_PASSWORD_XML = re.compile(r"(?:password|passwd|pwd)\w*\\?[\"']\s+value\s*=\s*\\?[\"'](?P<bare>[^\"'\\]+)", re.I)
RE_MYSQL = re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b[^\n|;]*?\s-p(?P<bare>[^\s\"']+)", re.I)
RE_BASIC_USER = re.compile(r"""(?<!\S)(?:-u|--user)[ =]{1,2}["']?[A-Za-z0-9_.@-]+:(?P<bare>[^\s"']+)""", re.I)
RE_TOKEN = re.compile(
    rf"(?:token|api[_ -]?key|access[_-]?key|secret|auth[_-]?key|signing[_ -]?key|(?:old|new|live|prod|current)\s+key|signature|sig|credential)"
    rf"{_NAME_END}(?:{_LITERAL}|{_BARE})", re.I
)
RE_TOKEN_OPTION = re.compile(rf"(?<!-)--[\w-]*(?:token|key|secret)[ =]{{1,3}}(?:{_LITERAL}|{_BARE})", re.I)
RE_TOKEN_PROSE = re.compile(
    r"(?:(?:old|new|live|prod|current)\s+key[^\n:=]{0,30}[:=]|with\s+(?:the\s+)?key|token\s+(?:is|was))\s+[\"'`]?(?P<bare>[^\s\"'`,;]+)", re.I
)
#: What is done with a key when the next word is the key.
_WITH = re.compile(r"\b(?:sign|auth|call)\w*\s+$", re.I)
RE_BEARER = re.compile(r"bearer\s+(?P<bare>[^\s\"'`,;<>]+)", re.I)
RE_BASIC = re.compile(r"basic\s+(?P<bare>[A-Za-z0-9+/]{8,}={0,2})(?![\w+/])", re.I)
RE_HOOK = re.compile(r"/hooks/(?:[A-Z0-9]+/)?(?P<bare>[A-Za-z0-9]{16,})")
RE_USERINFO = re.compile(r"://(?P<user>[^\s:/@\"'<>]*)(?::(?P<bare>[^\s/@\"'<>]+|[^\s@\"'<>]+))?@(?=[\w\[])")
RE_ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
RE_ARMOR_BODY = re.compile(
    r"(?P<bare>(?:(?:\s|\\[nr])*(?!-----)[A-Za-z0-9+/=:,. -]*[A-Za-z0-9+/=])*?)(?:\s|\\[nr])*-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY"
)
RE_ARMOR_LINE = re.compile(r"(?:(?:\s|\\[nr])*[A-Za-z0-9+/]{24,}={0,2})+")
RE_MORE_LITERAL = re.compile(rf"\s*(?:\+|\.)?\s*{_LITERAL}")
_TOKEN_TEXT = re.compile(r"[A-Za-z0-9_\-+/=.~%:$!@#^*]+")
_VERSION = re.compile(r"[A-Za-z]+[A-Z]?[a-z]*[-_. ]?v?\d+$")
_TURNS = re.compile(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")
_TOKEN_START = re.compile(r"[A-Za-z0-9_]")
_HEX_ID = re.compile(r"^[0-9a-f-]+$")
_TOKEN_RES = {k: re.compile(v) for k, v in TOKEN_FORMATS.items()}
_ANY_TOKEN = re.compile("|".join(f"(?:{v})" for v in TOKEN_FORMATS.values()))


def looks_like_token(v: str) -> bool:
    """Without blanks, and long and mixed as generated text is.

    16 characters with letters and digits; or 12 with small and capital letters and digits; or 24 without
    digits, if small and capital letters take turns as in no compound word.
    """
    if not _TOKEN_TEXT.fullmatch(v):
        return False
    digit, alpha = any(c.isdigit() for c in v), any(c.isalpha() for c in v)
    if digit and alpha and (len(v) >= 16 or len(v) >= 12 and v.lower() != v != v.upper() and not _VERSION.match(v)):
        return True
    return len(v) >= 24 and alpha and len(_TURNS.findall(v)) * 4 >= len(v)


def looks_like_password(v: str) -> bool:
    """At least 6 characters of two kinds and no plain word, path or call."""
    if len(v) < 6 or v.isdigit():
        return False
    kinds = any(c.isdigit() for c in v) + any(not c.isalnum() and c not in "._-/" for c in v)
    return kinds > 0 or (v.lower() != v and v.upper() != v and v[1:].lower() != v[1:])


def is_basic(v: str) -> bool:
    """The base64 text of user:password."""
    try:
        user, colon, password = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).partition(b":")
    except ValueError:
        return False
    return bool(colon and password) and all(32 <= c < 127 for c in user)


def _value(m: re.Match) -> tuple[int, int] | None:
    for g in ("q2", "q1", "q0", "bare"):
        if g in m.re.groupindex and m.group(g) is not None:
            return m.span(g)
    return None


def _in_literal(m: re.Match) -> bool:
    return any(g in m.re.groupindex and m.group(g) is not None for g in ("q2", "q1", "q0"))


def _spans_of(text: str, m: re.Match, kind: str, good: Callable[[str], bool]) -> list[Span]:
    """The value of `m` if it is a usable secret, with the further parts of a split literal."""
    at = _value(m)
    if at is None:
        return []
    parts = [at]
    value = text[at[0] : at[1]]
    if not value or PLACEHOLDER.fullmatch(value):
        return []
    # Outside quotes a call or an item of something is no value.
    if not _in_literal(m) and (LOOKUP.match(value) or text.startswith(("(", "["), at[1])):
        return []
    if _in_literal(m):
        end = m.end()
        while (more := RE_MORE_LITERAL.match(text, end)) and re.match(r"\s*[+.]", text[end:]):
            parts.append(_value(more))
            value += text[slice(*parts[-1])]
            end = more.end()
    else:
        trimmed = value.rstrip(".:,")
        parts, value = [(at[0], at[0] + len(trimmed))], trimmed
    return [(a, b, kind) for a, b in parts if b > a] if good(value) else []


def _token_format(text: str, at: int, word: str) -> list[Span]:
    back = 1 if word == "sk_live_" and at and text[at - 1] == "l" else 0
    at -= back
    if at and _TOKEN_START.match(text[at - 1]):
        return []
    m = _TOKEN_RES["lsk_" if back else word].match(text, at)
    return [(m.start(), m.end(), "api_token")] if m and any(c.isdigit() or c.isupper() for c in m.group()) else []


Rule = Callable[[str, int], list[Span]]


def _rule(regex: re.Pattern, kind: str, good: Callable[[str], bool]) -> Rule:
    """The grammar `regex` from the place where the automaton stopped, to its own end."""

    def run(text: str, at: int) -> list[Span]:
        m = regex.match(text, at)
        return _spans_of(text, m, kind, good) if m else []

    return run


def _first(*rules: Rule) -> Rule:
    def run(text: str, at: int) -> list[Span]:
        return next((spans for rule in rules if (spans := rule(text, at))), [])

    return run


def _usable(v: str) -> bool:
    return len(v) >= 4 and not PLACEHOLDER.fullmatch(v) and not LOOKUP.fullmatch(v)


_PASSWORD = _first(
    _rule(RE_PASSWORD_OPTION, "password", _usable), _rule(RE_PASSWORD_XML, "password", _usable),
    _rule(RE_PASSWORD, "password", looks_like_password), _rule(RE_PASSWORD_PROSE, "password", looks_like_password),
)
_TOKEN = _first(_rule(RE_TOKEN, "api_token", looks_like_token), _rule(RE_TOKEN_PROSE, "api_token", looks_like_token))
_KEY = _rule(RE_TOKEN_PROSE, "api_token", looks_like_token)


def _password(text: str, at: int) -> list[Span]:
    return [] if text.startswith("-stdin", at + 8) else _PASSWORD(text, at)


def _with_key(text: str, at: int) -> list[Span]:
    return _KEY(text, at) if _WITH.search(text, max(0, at - 64), at) else []


def _userinfo(text: str, at: int) -> list[Span]:
    m = RE_USERINFO.match(text, at)
    if not m:
        return []
    if m.group("bare") is None:
        a, b = m.span("user")
        return [(a, b, "api_token")] if looks_like_token(text[a:b]) else []
    a, b = m.span("bare")
    if not _usable(text[a:b]):
        return []
    return [(a, b, "api_token" if _ANY_TOKEN.fullmatch(text[a:b]) else "password")]


def _armor(text: str, at: int) -> list[Span]:
    m = RE_ARMOR.match(text, at)
    if not m:
        return []
    body = RE_ARMOR_BODY.match(text, m.end()) or RE_ARMOR_LINE.match(text, m.end())
    if not body:
        return []
    a, b = body.span("bare") if "bare" in body.re.groupindex else body.span()
    while a < b and (text[a].isspace() or text.startswith(("\\n", "\\r"), a)):
        a += 2 if text[a] == "\\" else 1
    return [(a, b, "private_key")] if b - a >= 16 else []


def automaton() -> ahocorasick.Automaton:
    rules: dict[str, list[Rule]] = {}
    for word in TOKEN_FORMATS:
        rules[word] = [lambda text, at, w=word: _token_format(text, at, w)]
    option, env = _rule(RE_PASSWORD_OPTION, "password", _usable), _rule(RE_PASSWORD_ENV, "password", looks_like_password)
    user, client = _rule(RE_BASIC_USER, "password", _usable), _rule(RE_MYSQL, "password", _usable)
    more = {
        **dict.fromkeys(PASSWORD_WORDS, _password), **dict.fromkeys(TOKEN_WORDS, _TOKEN), **dict.fromkeys(("--pass", "login "), option),
        **dict.fromkeys(("env ", "arg ", "setenv ", "set "), env), **dict.fromkeys(("with key", "with the key"), _with_key),
        **dict.fromkeys(("-u ", "-u=", "--user"), user), **dict.fromkeys(("mysql", "mariadb"), client),
        "--": _rule(RE_TOKEN_OPTION, "api_token", looks_like_token),
        "-----begin ": _armor,
        "://": _userinfo,
        "bearer ": _rule(RE_BEARER, "api_token", looks_like_token),
        "basic ": _rule(RE_BASIC, "password", is_basic),
        "/hooks/": _rule(RE_HOOK, "api_token", looks_like_token),
    }
    for word, rule in more.items():
        rules.setdefault(word, []).append(rule)
    auto = ahocorasick.Automaton()
    for word, each in rules.items():
        auto.add_word(word, (len(word), each))
    auto.make_automaton()
    return auto


def finder() -> Callable[[str], list[Span]]:
    auto = automaton()

    def find(text: str) -> list[Span]:
        low = text.lower()
        if len(low) != len(text):  # a few letters change their length in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spans: set[Span] = set()
        for start in range(0, len(low), CHUNK):
            for end, (size, rules) in auto.iter(low[start : start + CHUNK + OVERLAP]):
                for rule in rules:
                    spans.update(rule(text, start + end - size + 1))
        armor = [s for s in spans if s[2] == "private_key"]
        rest = [s for s in spans if s[2] != "private_key" and not any(a <= s[0] < b for a, b, _ in armor)]
        return _one_type(settle([*armor, *rest]), text)

    return find


def _one_type(spans: list[Span], text: str) -> list[Span]:
    """A value in a public token format is a token whatever its field is called."""
    return [(a, b, "api_token" if k == "password" and _ANY_TOKEN.fullmatch(text[a:b]) else k) for a, b, k in spans]


def masker() -> Callable[[str, str], str]:
    """The placeholder of a type. It holds no quote and no blank, so code, JSON and URLs keep their form."""
    return lambda value, kind: f"REDACTED_{kind.upper()}"


def p5_found(spark, folder: str) -> DataFrame:
    return found(records(spark, folder, FIELDS[:2]), FIELDS, finder, "secret_type")


def p5_redacted(spark, folder: str) -> DataFrame:
    """The texts of all rows with only the secret values replaced."""
    return redacted(records(spark, folder, FIELDS[:2]), FIELDS, finder, masker)
