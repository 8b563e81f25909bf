"""Personal data in free text (problem 4).

Five types are found: email, phone, id_number, street_address, person_name. Each mention becomes a
typed placeholder that keeps the text readable.

Phones, identity numbers and dates of birth are validated: country codes, lengths and ranges, check
digits and letters, calendar. A valid one is replaced by a pseudonym of its own format: a keyed Feistel
permutation of the bare number within the valid numbers of the format, with country code, separators
and letter case as they were. So equal values get equal pseudonyms in every document, however they are
spelled. What fails its check, and e-mails, addresses and names, carry a keyed tag of 80 bits, equal for
equal values whatever case and spacing.

A cue such as "phone" counts for a number up to 24 characters behind it on its line (identity numbers:
26). Names are found by cues of people acting or being addressed, by titles, and by common given names.

Defined results: null and empty texts hold nothing; masked values (<EMAIL>, ***), logins and remotes of
services, package versions, product, place and role names are no mentions; a name inside an e-mail
address is no person_name; dates of birth are redacted but are none of the five types; repeated rows
give equal results.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
import secrets
import string
from collections.abc import Callable

from pyspark.sql import DataFrame

from steploom.llm.textscan import Span, found, records, redacted, settle

FIELDS = ["observation_text", "thought_text", "recent_context_text"]
#: Session setting with the key of the pseudonyms. Without it each call draws a key, and values stay linked within the call only.
KEY_SETTING = "spark.steploom.pseudonym.key"

# Words of the domains searched.
SERVICE_LOGINS = {
    "git", "svc", "svc_ci", "ci", "deploy", "runner", "agent", "root", "admin", "build", "bot", "noreply", "no-reply",
    "donotreply", "ubuntu", "docker", "ec2-user", "jenkins", "postgres", "mysql", "hg", "ssh", "user", "service", "www",
}
GIVEN_NAMES = (
    "anna maria elena sofia laura julia sarah emily emma olivia hannah lena clara marie chloe camille lucia carmen ana "
    "ingrid astrid fatima aisha priya mei yuki olga irina natalia svetlana katarzyna agnieszka ewa zofia "
    "james john robert michael david william richard thomas daniel matthew paul peter andrew george edward henry "
    "jack oliver lucas louis pierre jean michel hans klaus jürgen wolfgang stefan andreas markus matthias sebastian "
    "carlos jose juan luis miguel pedro diego javier antonio giovanni marco luca paolo francesco joão tiago "
    "jan pieter willem sven lars erik nils ivan dmitri sergei vladimir alexei mikhail mohammed ahmed omar hassan ali "
    "raj arjun vikram wei chen hiroshi takashi kenji"
).split()
ROLE_WORDS = set(
    "release train build agent merge queue task runner core loader test user bot system service pipeline job admin team "
    "guard worker robot server client machine group owner customer support office release manager head department "
    "scheduler monitor engine module library project company inc ltd gmbh the a an and or not new old all no none this "
    "that nothing everyone nobody someone reviewer annotator reporter author agents step action observation traceback "
    "error failed file line key value index cache token schema header writer reader router buffer window cursor".split()
)
STREET_TYPES = (
    "Street|St|Avenue|Ave|Road|Rd|Row|Close|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Square|Sq|Crescent|"
    "Boulevard|Blvd|Hill|Gardens|Mews|Walk|Parkway|Pkwy|Highway|Hwy|Circle|Alley"
)
PHONE_CUES = (
    r"tel|telephone|phone|fax|mobile|mobil|cell|call(?:back)?|pager|whatsapp|hotline|sms|text|rückruf|telefon|"
    r"telefono|teléfono|téléphone|contact\w*|reach|ring|dial|on-call|handy|móvil"
)
ID_CUES = (
    r"ssn|social(?: security)?(?: (?:number|no\.?|nr\.?))?|passport|licen[cs]e|driver'?s?|taxpayer|tax(?: id)?|national|"
    r"nino|insurance number|identit[éy]|\w*ausweis\w*|idnum\w*|id[ _-]?(?:number|no|card|nr)|dni|nif|cpf|bsn|steuer\w*|"
    r"personnummer|carte|codice fiscale|fiscal\w*"
)
#: What a number is when it is not personal: a measure, a place in a file or list, a name of code or build.
NOT_PERSONAL = re.compile(
    r"(?i)(?:\b(?:isbn|issn|doi|sizes?|rows?|jobs?|builds?|offsets?|ranges?|bytes?|ms|ports?|version|sha\d*|md5|commit|hash|uuid|"
    r"timeouts?|lines?|expected|got|peer|pages?|cache|runs?|orders?|invoice no|sku|parts?|seeds?|epochs?|revision|rev|tickets?|issues?|pr|chunks?|ctag\S*)\b|#)[\s:=#\w.-]{0,18}$"
)
#: Words of companies, products and places that stand where a name could.
NOT_PERSONS = frozenset(
    "apache amazon google microsoft azure oracle redhat red visual studio cloud code linux ubuntu debian windows mac java script python kafka spark hadoop "
    "redis redshift postgres mysql mongo docker kubernetes github gitlab jenkins jira slack confluence elastic search open source san los las new saint north south "
    "east west united states kingdom city university institute street avenue road lake mount port cape great black data lake web services platform engine "
    "error handling syntax type value index runtime import key unit test tests continuous integration machine learning deep neural language model api rest http "
    "json yaml xml sql monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "english german french spanish italian dutch russian japanese".split()
)

RE_EMAIL = re.compile(
    r"(?<![\w.+%-])(?P<local>[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+])?)"
    r"(?:@|\s?\((?:a|at|@)\)\s?|\s\[(?:at|@)\]\s|\sat\s)"
    r"(?P<host>(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s))+[A-Za-z]{2,})(?![\w@-])"
)
RE_PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?P<plus>(?:\+|00(?=[1-9]\d?[-. ]))[1-9]\d{0,2}[-. ]?(?:\(0?\d{1,4}\)[-. ]?)?\d{1,5}(?:[-. ]\d{1,5}){1,6}|\+[1-9]\d{8,14})"
    r"|(?P<paren>\(\d{3}\)[-. ]?\d{3}[-. ]\d{4})"
    r"|(?P<dots>[2-9]\d{2}\.[2-9]\d{2}\.\d{4})"
    r"|(?P<uk>0\d{2,4} \d{3,4} \d{3,4})"
    r"|(?P<cued>1?[-. ]?[2-9]\d{2}[-. ]?\d{3}[-. ]?\d{4}|0\d{2,5}[-/ ]\d{4,9}|\d{9,12})"
    r")(?![\w-]|\.\d)"
)
# A cue stands at most 24 characters before its phone number, on the same line.
RE_PHONE_CUE = re.compile(rf"(?i)(?<!recent )\b(?:{PHONE_CUES})(?:(?!\b(?:{PHONE_CUES}))[^\n]){{0,24}}$")
RE_ID = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?P<ssn>\d{3}([- ])\d{2}\2\d{4})"
    r"|(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r"|(?P<cued>[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]|\d{2}-\d{7}|\d{6}[-+]\d{4}|[A-Z]{1,2}\d{6,9}|\d{8}[A-Z]|\d{3}[ -]\d{2}[ -]\d{4}|\d{8,14}|(?:\d{2,4}[ .]){2,4}\d{2,4})"
    r")(?![\w-]|\.\d)"
)
RE_ID_CUE = re.compile(rf"(?i)(?<![^\W_])(?:{ID_CUES})[^\n\d]{{0,26}}$")
RE_ID_AFTER = re.compile(r"(?i)^[^\n]{0,20}\b(?:tax|ssn|social|identity|passport|licen[cs]e)\b")
_W = r"(?:[A-ZÄÖÜÉÈÁÍÓÚÑØÅ][\w'’äöüßéèáíóúñøå-]*)"
_CITY = rf"(?:,? {_W}(?: {_W}){{0,2}}(?:,? \d{{4,5}})?)"
RE_ADDRESS = re.compile(
    r"(?<![\w.])(?:"
    rf"(?P<unit>(?:Flat|Apt|Unit|Suite|Apartment) \w{{1,5}},? )?\d{{1,5}}[a-zA-Z]?,? (?:{_W} ){{1,3}}(?:(?P<type>{STREET_TYPES}|{STREET_TYPES.upper()}))\b\.?"
    rf"(?P<rest>(?:,? (?:Apt|Unit|Flat|Suite|Apartment|#)\.? ?\w{{1,5}})?{_CITY}?)"
    rf"|\d{{1,5}}(?: ?bis)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours)(?: d[eu]s?| de la)? {_W}(?:, (?:\d{{4,5}} )?{_W}(?: {_W}){{0,2}})?"
    rf"|(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Carrer|Via|Viale|Piazza|Corso|Rua|Travessa|Praça)(?: d[aeio]s?| de la| del)? {_W}(?: {_W})?,? \d{{1,5}}"
    rf"(?:, \d{{1,2}}[ºª°] ?\w?)?(?:, (?:\d{{4,5}} )?{_W}(?: {_W}){{0,2}})?"
    rf"|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|straat|laan|gracht|plein) \d{{1,4}} ?[a-z]?\b"
    rf"(?:, (?:\d{{4,5}}(?: [A-Z]{{2}})? )?{_W}(?: {_W}){{0,2}})?"
    rf"|P\.? ?O\.? ?Box \d{{1,6}}{_CITY}?"
    rf"|Postfach \d{{1,6}}{_CITY}?"
    r")"
)
#: Street types that are also other words: they need a unit, a town or a cue.
WEAK_TYPES = {"way", "place", "pl", "hill", "row", "walk", "close", "square", "circle", "gardens", "mews", "alley", "court", "drive", "dr", "st", "ct", "lane"}
RE_ADDRESS_CUE = re.compile(r"(?i)(?:address|addr|anschrift|adresse|domicil\w*|lives?|living|resid\w*|ship\w*|deliver\w*|visit|invoice|home|mail|located|move\w*)\b[^\n]{0,24}$")
_CAP = r"[A-ZÀ-ÖØ-ÞŠŽČĆ][a-zß-öø-ÿā-ž'’-]+"
_UPP = r"[A-ZÀ-ÖØ-ÞŠŽČĆ]{3,}"
_PARTICLE = r"(?:van|von|de|der|den|di|da|del|la|le|bin|al)"
_NAME = rf"(?:{_CAP}(?: [A-Z]\.)?(?: {_PARTICLE})* (?:{_CAP}|{_UPP})|{_CAP},? {_CAP}|{_UPP},? {_CAP}|[A-Z]\. ?{_CAP})"
RE_NAME_TITLE = re.compile(rf"\b(?:Dr|Mr|Mrs|Ms|Mx|Prof|Herr|Frau|Mme|Mlle|Sra?|Sig(?:ra)?)\.? (?P<n>(?:{_CAP} )?(?:[A-Z]\. )?{_CAP})")
_SPEAKS = r"wrote|writes|said|says|asked|asks|filed|replied|reported|noted|mentioned|suggested|explained|confirmed|complained|merged|owns|fixed|called|answered|objected|agreed"
RE_NAME_CUE = re.compile(
    # A field of a person.
    r"(?:\b(?:[Aa]uthor|[Cc]ommitter|[Ss]igned-off-by|[Aa]pproved-by|[Rr]eviewed-by|[Cc]o-authored-by|[Aa]cked-by|[Rr]eported-by|[Tt]ested-by|"
    r"[Kk]ontakt|[Cc]ontact|[Aa]ssignee|[Rr]eporter|[Oo]wner|[Nn]ame|[Cc]c|[Ff]rom|[Bb]lame|[Aa]ttn|[Mm]aintainer|[Rr]eviewer|[Aa]nnotator)\"?\s{0,2}(?::|=|==)\s{0,2}\"?"
    # Something done with, by or to a person.
    r"|\b(?:[Cc]o-authored|[Rr]eviewed|[Pp]aired|[Ss]ynced|[Ss]poke|[Tt]alked|[Aa]greed|[Dd]iscussed|[Ww]orked|[Cc]hecked|[Cc]hatted) with "
    r"|\b(?:[Rr]eviewed|[Aa]pproved|[Ww]ritten|[Aa]uthored|[Rr]eported|[Ff]iled|[Rr]aised|[Ff]lagged|[Ss]igned(?: off)?|[Cc]onfirmed|[Rr]equested|[Mm]aintained|[Oo]wned) by "
    r"|\b(?:[Tt]hanks|[Tt]hank you|[Kk]udos|[Aa]ccording|[Hh]and(?:ed)? (?:it )?over|[Aa]ssign(?:ed)?|[Rr]eassign(?:ed)?|[Ee]scalate[ds]?|[Ff]orward(?:ed)?|[Ss]poke|[Tt]alked|[Rr]eport(?:ed)?|[Ww]rite|[Ww]rote) to "
    r"|\b(?:[Pp]ing(?:ed)?|[Aa]sk(?:ed)?|[Tt]ell|[Tt]old|[Ee]mailed|[Mm]essaged|[Mm]et|[Cc]olleague|[Cc]oworker|[Aa]pplicant|[Pp]atient|[Ee]mployee|[Cc]ustomer) "
    r"|(?:TODO|FIXME|XXX|NOTE|HACK)\("
    r"|\| (?:annotator|reviewer|author|owner|assignee|name|reporter|contact) \| )"
    rf"(?P<n>{_NAME})"
)
RE_NAME_FIELD = re.compile(rf"\b(?:owner|author|assignee|reviewer|reporter|user_?name|name|contact)=(?P<n>{_CAP}_(?:[A-Z]\.?_)?{_CAP})\b")
RE_NAME_AFTER = re.compile(rf"(?<![\w.@-])(?P<n>{_NAME})(?= (?:and I\b|(?:{_SPEAKS})\b|\d+ (?:weeks?|days?|months?) ago))")
RE_NAME_AS = re.compile(rf"\b[Aa]s (?P<n>{_NAME})(?= (?:{_SPEAKS}|put it)\b)|\b[Mm]it (?P<m>{_NAME})(?= (?:abgestimmt|gesprochen|besprochen|geklärt)\b)")
_GIVEN = "|".join(n.title() for n in GIVEN_NAMES)
RE_NAME_GIVEN = re.compile(
    rf"(?<![\w.@+/-])(?P<n>(?:{_GIVEN})(?:[ _][A-Z]\.?)?[ _](?:{_CAP}|{_UPP})|(?:{_UPP}|{_CAP}),? (?:{_GIVEN}))(?![\w@+-])"
)
#: A name in lower case, which only its verb gives away, at the beginning of a sentence.
RE_NAME_LOWER = re.compile(
    r"(?:^|[.!?:>+-] |\n[>+-]? ?)(?P<n>[a-zß-öø-ÿā-ž]{{3,}} [a-zß-öø-ÿā-ž]{{4,}})(?= (?:wrote (?:it|the)|said|and i (?:saw|wrote|think|met)))"
    r"|(?<![\w.@/-])(?P<m>[a-zß-öø-ÿā-ž]{3,} [a-zß-öø-ÿā-ž]{4,})(?= wrote (?:this|that) )", re.M
)
RE_AT = re.compile(r"@|\(a\)|\(at\)|\[at\]|\bat\b", re.I)
# Quick tests. Each is wider than the searches it stands before.
_PHONE_HINT = re.compile(r"\d{7}|\d\d[-. )/]{1,2}\d{2,5}[-. ]\d|\d[-. /]\d{3,9}|\+\d")
_ID_HINT = re.compile(r"\d{3}[- ]\d\d[- ]\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d")
_ID_WORDS = (
    "ssn", "social", "passport", "license", "licence", "driver", "tax", "national", "nino", "insurance number", "identit", "ausweis", "idnum",
    "dni", "nif", "cpf", "bsn", "steuer", "personnummer", "carte", "fiscal",
)
_ID_FIELD = re.compile(r"id[ _-]?(?:number|no|card|nr)")
_ADDRESS_HINT = re.compile(r"\d[a-zA-Z]?,? [A-ZÀ-Þ][\w'’-]* [A-ZÀ-Þ]")
_ADDRESS_HINT_2 = re.compile(
    r"(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|straat|laan|gracht|plein|Box|Postfach) \d"
    r"|(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours) [A-ZÀ-Þd]"
    r"|(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Carrer|Via|Viale|Piazza|Corso|Rua|Travessa|Praça) [A-ZÀ-Þd]"
)
_NAME_HINT = re.compile(rf"[A-ZÀ-ÞŠŽČĆ][^\W\d_]*[.,]?[ _](?:{_PARTICLE} )*[A-ZÀ-ÞŠŽČĆ]|\b[A-Z]\.[A-ZÀ-ÞŠŽČĆ]")
_LOWER_VERBS = (" wrote ", " said", " and i ")


def emails(text: str) -> list[Span]:
    spans = []
    for m in RE_EMAIL.finditer(text):
        local, at = m.group("local"), m.start()
        word = text[max(text.rfind(c, 0, at) for c in " \n\t") + 1 : at]
        spaced = not re.match(r"@|\s?\(", text[m.end("local") :])
        if local.lower() in SERVICE_LOGINS or "://" in word and "?" not in word or re.search(r"\bssh\s+(?:-\S+\s+)*$", _line_before(text, at, 300)):
            continue
        if spaced and not re.search(r"\bdot\b", m.group("host"), re.I):
            continue  # "at" alone is a word
        if text[m.end() : m.end() + 1] == ":" and "/" in text[m.end() : m.end() + 40].split()[0]:
            continue  # a remote: login@host:path
        spans.append((m.start(), m.end(), "email"))
    return spans


def _line_before(text: str, at: int, most: int = 60) -> str:
    return text[max(0, at - most) : at].rsplit("\n", 1)[-1]


def phones(text: str) -> list[Span]:
    spans = []
    for m in RE_PHONE.finditer(text):
        before = _line_before(text, m.start())
        digits = sum(c.isdigit() for c in m.group())
        if not 7 <= digits <= 15:
            continue
        cue, other = RE_PHONE_CUE.search(before), NOT_PERSONAL.search(before)
        if cue and other and other.start() > cue.start():
            cue = None
        if m.lastgroup == "cued" and not cue:
            continue
        if m.lastgroup == "uk" and not cue and (other or not re.match(r"0[1-9]\d? \d{4} \d{4}$", m.group())):
            continue
        if m.lastgroup not in ("cued", "uk") and re.search(r"(?i)\b(?:build|version|v)\s*$", before):
            continue
        if m.lastgroup == "cued" and RE_ID_CUE.search(before):
            continue
        spans.append((m.start(), m.end(), "phone"))
    return spans


def id_numbers(text: str) -> list[Span]:
    spans = []
    for m in RE_ID.finditer(text):
        before = _line_before(text, m.start())
        cued = RE_ID_CUE.search(before) or RE_ID_AFTER.match(text[m.end() : m.end() + 60])
        if m.group("ssn"):
            good = cued or not NOT_PERSONAL.search(before)
            a, b, c = re.split(r"[- ]", m.group())
            good = good and (bool(cued) or m.group()[3] == "-") and b != "00" and c != "0000" and a != "000"
        elif m.group("nino"):
            good = bool(cued) or m.group().count(" ") == 4
        else:
            good = bool(cued) and not re.search(rf"(?i)(?:{PHONE_CUES})\W{{0,4}}$", before)
        if good:
            spans.append((m.start(), m.end(), "id_number"))
    return spans


def addresses(text: str) -> list[Span]:
    spans = []
    for m in RE_ADDRESS.finditer(text):
        kind = m.group("type")
        if kind and kind.lower() in WEAK_TYPES and not m.group("unit") and not m.group("rest") and not RE_ADDRESS_CUE.search(_line_before(text, m.start())):
            continue
        spans.append((m.start(), m.end(), "street_address"))
    return spans


def _person(name: str) -> bool:
    words = [w for w in re.split(r"[\s_,.]+", name.lower()) if len(w) > 1]
    return not any(w in ROLE_WORDS or w in NOT_PERSONS for w in words) and any(len(w) > 2 for w in words)


def person_names(text: str) -> list[Span]:
    spans = []
    for regex in (RE_NAME_GIVEN, RE_NAME_CUE, RE_NAME_AFTER, RE_NAME_AS, RE_NAME_FIELD, RE_NAME_TITLE):
        for m in regex.finditer(text):
            a, b = m.span("n") if m.group("n") is not None else m.span("m")
            if _person(text[a:b]) and text[b : b + 1] not in ("@", "+") and text[b : b + 2] != "(a":
                spans.append((a, b, "person_name"))
    return spans


def lower_names(text: str) -> list[Span]:
    spans = []
    for m in RE_NAME_LOWER.finditer(text):
        name = m.group(m.lastgroup)
        if _person(name) and not _FUNCTION.intersection(name.split()):
            spans.append((*m.span(m.lastgroup), "person_name"))
    return spans


# Words that begin no name in lower case; months; cues of a date of birth.
_FUNCTION = frozenset(
    "the this that these those our your their his her its each every both some any all one two three someone nobody everyone what which who when where why how "
    "then also only just even here there now once again still have had has was were been being will would could should first last next other another such same "
    "with from into over after before because while until although pylint pytest black linter editor command script shell compiler logger".split()
)
MONTHS = "january february march april may june july august september october november december".split()
BIRTH_CUES = (
    r"born(?: on)?|d\.?o\.?b\.?|date[ _]of[ _]birth|birth[ _]?date|birthday|geboren(?: am)?|geb\.|geburtsdatum|née? le|date de naissance|nacid[oa](?: el)?|"
    r"fecha de nacimiento|nat[oa] il|data di nascita|geboortedatum"
)
RE_BIRTH = re.compile(
    rf"(?i)(?<![^\W_])(?:{BIRTH_CUES})\W{{0,6}}(?:(?P<iso>\d{{4}}-\d\d-\d\d)|(?P<dmy>\d\d?[./]\d\d?[./]\d{{4}})|(?P<named>\d\d? (?:{'|'.join(MONTHS)}) \d{{4}})"
    rf"|(?P<us>(?:{'|'.join(MONTHS)}) \d\d?, \d{{4}}))(?![\w-])"
)
_BIRTH_HINT = ("born", "dob", "d.o.b", "birth", "geb", "née", "né le", "naissance", "nacid", "nacimiento", "nato il", "nata il", "nascita")


def birth_dates(text: str) -> list[Span]:
    return [(*m.span(m.lastgroup), "birth_date") for m in RE_BIRTH.finditer(text) if date_of(m.group(m.lastgroup))]


def date_of(text: str) -> tuple[datetime.date, str] | None:
    """The date a text spells and how it spells it; null if the calendar has no such date between 1900 and 2099."""
    parts = re.findall(r"[^\W_]+", text)
    names = [p for p in parts if p.isalpha()]
    if names:
        month = MONTHS.index(names[0].lower()) + 1
        day, year = [int(p) for p in parts if p.isdigit()]
        form = "named" if parts[0].isdigit() else "us"
    elif len(parts[0]) == 4:
        (year, month, day), form = map(int, parts), "iso"
    else:
        (day, month, year), form = map(int, parts), "dmy"
        if month > 12 >= day:
            (day, month), form = (month, day), "mdy"
    try:
        date = datetime.date(year, month, day)
    except ValueError:
        return None
    return (date, form) if 1900 <= year <= 2099 else None


def find(text: str, dates: bool = False) -> list[Span]:
    """All mentions, without overlap. The quick tests only skip searches that cannot match."""
    spans: list[Span] = []
    if RE_AT.search(text):
        spans += emails(text)
        for a, b, _ in spans:  # what is inside an address is no other mention
            text = text[:a] + "\x00" * (b - a) + text[b:]
    low = text.lower()
    numbers: list[Span] = []
    if dates and any(w in low for w in _BIRTH_HINT):
        numbers += birth_dates(text)
    if any(w in low for w in _ID_WORDS) or _ID_HINT.search(text) or "id" in low and _ID_FIELD.search(low):
        numbers += id_numbers(text)
    if _PHONE_HINT.search(text):
        numbers += phones(text)
    spans += settle(numbers)
    if _ADDRESS_HINT.search(text) or _ADDRESS_HINT_2.search(text):
        spans += addresses(text)
    if _NAME_HINT.search(text):
        spans += person_names(text)
    if any(w in low for w in _LOWER_VERBS):
        spans += lower_names(text)
    return settle(spans)


def finder() -> Callable[[str], list[Span]]:
    return find


def finder_with_dates() -> Callable[[str], list[Span]]:
    return lambda text: find(text, True)


# ---------------------------------------------------------------- validation

# Country codes of one and two digits (the others have three), and check tables.
SHORT_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NINO_PREFIX = re.compile(r"(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]")
FISCAL_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
EIN_UNUSED = {0, 7, 8, 9, 17, 18, 19, 28, 29, 49, 69, 70, 78, 79, 89, 96, 97}


def _luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(d)) % 10 == 0


def _ssn(d: str) -> bool:
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    itin = area >= 900 and (50 <= group <= 65 or 70 <= group <= 88 or 90 <= group <= 99 and group not in (93,))
    return (0 < area < 900 and area != 666 and group > 0 and serial > 0) or itin


def _cpf(d: str) -> bool:
    check = lambda n: sum(int(c) * (n + 1 - i) for i, c in enumerate(d[:n])) * 10 % 11 % 10
    return len(set(d)) > 1 and check(9) == int(d[9]) and check(10) == int(d[10])


def _fiscal(v: str) -> bool:
    rank = [int(c) if c.isdigit() else ord(c) - 65 for c in v[:15]]
    return chr(65 + sum(FISCAL_ODD[r] if i % 2 == 0 else r for i, r in enumerate(rank)) % 26) == v[15] and v[8] in "ABCDEHLMPRST"


#: Formats of identity numbers by their bare characters: name, shape, check. The first that accepts a number is its format.
ID_FORMATS: list[tuple[str, re.Pattern, Callable[[str], bool]]] = [
    ("nino", re.compile(r"[A-Z]{2}\d{6}[A-D]"), lambda v: bool(NINO_PREFIX.match(v))),
    ("dni", re.compile(r"\d{8}[A-Z]"), lambda v: DNI_LETTERS[int(v[:8]) % 23] == v[8]),
    ("fiscal", re.compile(r"[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]"), _fiscal),
    ("ssn", re.compile(r"\d{9}"), _ssn),
    ("bsn", re.compile(r"\d{9}"), lambda v: (sum(int(c) * (9 - i) for i, c in enumerate(v[:8])) - int(v[8])) % 11 == 0),
    ("ein", re.compile(r"\d{9}"), lambda v: int(v[:2]) not in EIN_UNUSED),
    ("personnummer", re.compile(r"\d{10}"), lambda v: _luhn(v) and 1 <= int(v[2:4]) <= 12 and 1 <= int(v[4:6]) <= 31),
    ("cpf", re.compile(r"\d{11}"), _cpf),
    ("cni", re.compile(r"\d{12}"), lambda v: 1 <= int(v[2:4]) <= 12),
    ("insee", re.compile(r"[12]\d{14}"), lambda v: 97 - int(v[:13]) % 97 == int(v[13:])),
    ("letters_and_number", re.compile(r"[A-Z]{1,2}\d{6,9}"), lambda v: int(re.sub(r"\D", "", v)) > 0),
]


def id_format(bare: str) -> tuple[str, Callable[[str], bool]] | None:
    """The format of a bare identity number in upper case, and the test that its valid numbers pass."""
    for name, shape, check in ID_FORMATS:
        if shape.fullmatch(bare) and check(bare):
            return name, lambda v, s=shape, c=check: bool(s.fullmatch(v)) and c(v)
    return None


def phone_parts(value: str) -> tuple[int, int] | None:
    """(digits of the prefix, digits of the national number) of a valid phone number; null for any other.

    The prefix, a country code or a leading 0, is no part of the number: it stays, and +44 20 7946 0018
    and 020 7946 0018 are one number.
    """
    digits = re.sub(r"\D", "", value)
    plus = value.lstrip().startswith("+") or digits.startswith("00")
    skip = 2 if digits.startswith("00") else 0
    if plus:
        code = next((n for n in (1, 2) if digits[skip : skip + n] in SHORT_CODES), 3)
        start = skip + code + (1 if "(0)" in value else 0)
    elif digits.startswith("0"):
        start = 1
    else:
        start = 1 if len(digits) == 11 and digits[0] == "1" else 0
    national = digits[start:]
    american = digits[skip:start] == "1" or not plus and start == 0 and len(national) == 10
    if not plus and start < 2 and digits[0] != "0" and not american and len(national) < 9:
        return None
    if american and not nanp(national):
        return None
    return (start, len(national)) if 6 <= len(national) <= 13 and len(digits) - skip <= 15 else None


def nanp(v: str) -> bool:
    return bool(re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", v)) and v[1:3] != "11" and v[4:6] != "11"


# ---------------------------------------------------------------- pseudonyms

class Feistel:
    """Keyed permutations of the numbers below a size, and of the valid strings of a format.

    A number is split into two halves in mixed radix; each round adds a keyed function of one half to the
    other modulo its range, so every round can be undone. A result outside the size or the format is
    permuted again until it is inside, which keeps the whole a permutation of the inside.
    """

    ROUNDS = 8

    def __init__(self, key: str) -> None:
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = key.encode()

    def _round(self, n: int, tweak: str, value: int, size: int) -> int:
        h = hmac.new(self.key, f"{n}|{tweak}|{value}".encode(), hashlib.sha256).digest()
        return int.from_bytes(h[:16], "big") % size

    def number(self, value: int, size: int, tweak: str, good: Callable[[int], bool] = lambda n: True, back: bool = False) -> int:
        """The number below `size` that stands for `value`, or with `back` the one it stands for."""
        left = math.isqrt(max(0, size - 1)) + 1
        right = -(-size // left)
        sizes = (left, right)
        while True:
            half = list(divmod(value, right))
            for n in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
                side = n % 2
                step = self._round(n, tweak, half[1 - side], sizes[side])
                half[side] = (half[side] + (-step if back else step)) % sizes[side]
            value = half[0] * right + half[1]
            if value < size and good(value):
                return value

    def text(self, bare: str, tweak: str, good: Callable[[str], bool] = lambda v: True, back: bool = False) -> str:
        """A string of digits and capital letters permuted among the good ones of its shape."""
        shape = "".join("0" if c in string.digits else "A" for c in bare)
        size = math.prod(10 if k == "0" else 26 for k in shape)

        def spelled(n: int) -> str:
            out = []
            for k in reversed(shape):
                n, d = divmod(n, 10 if k == "0" else 26)
                out.append(chr(ord(k) + d))
            return "".join(reversed(out))

        n = 0
        for c, k in zip(bare, shape):
            n = n * (10 if k == "0" else 26) + ord(c) - ord(k)
        return spelled(self.number(n, size, f"{tweak}|{shape}", lambda x: good(spelled(x)), back))


_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


class Pseudonyms:
    """The placeholder of each mention."""

    def __init__(self, key: str) -> None:
        self.feistel, self.secret = Feistel(key), key.encode()

    def phone(self, value: str, back: bool = False) -> str | None:
        parts = phone_parts(value)
        if not parts:
            return None
        digits = [i for i, c in enumerate(value) if c.isdigit()]
        own = "".join(value[i] for i in digits[parts[0] :])
        # All spellings of an American number follow the same rules; other countries' numbers only keep their length.
        new = self.feistel.text(own, "phone", nanp if nanp(own) else lambda v: not nanp(v), back)
        return self._put(value, digits[parts[0] :], new)

    def id_number(self, value: str, back: bool = False) -> str | None:
        at = [i for i, c in enumerate(value) if c in string.ascii_letters or c in string.digits]
        bare = "".join(value[i] for i in at).upper()
        known = id_format(bare)
        return self._put(value, at, self.feistel.text(bare, known[0], self._of(known[0]), back)) if known else None

    @staticmethod
    def _of(name: str) -> Callable[[str], bool]:
        """The strings whose first accepting format is `name`, so a pseudonym is read back in the same format."""
        return lambda v: (f := id_format(v)) is not None and f[0] == name

    def birth_date(self, value: str, back: bool = False) -> str | None:
        known = date_of(value)
        if not known:
            return None
        day = self.feistel.number(known[0].toordinal() - _FIRST_DAY, _DAYS, "date", back=back)
        d = datetime.date.fromordinal(_FIRST_DAY + day)
        sep = re.sub(r"\w", "", value)[:1] if known[1] in ("dmy", "mdy") else "-"
        forms = {
            "iso": f"{d:%Y-%m-%d}", "dmy": f"{d.day:02d}{sep}{d.month:02d}{sep}{d.year}", "mdy": f"{d.month:02d}{sep}{d.day:02d}{sep}{d.year}",
            "named": f"{d.day} {MONTHS[d.month - 1].title()} {d.year}", "us": f"{MONTHS[d.month - 1].title()} {d.day}, {d.year}",
        }
        return forms[known[1]]

    @staticmethod
    def _put(value: str, at: list[int], new: str) -> str:
        out = list(value)
        for i, c in zip(at, new):
            out[i] = c.lower() if value[i].islower() else c
        return "".join(out)

    def tag(self, value: str, kind: str) -> str:
        same = re.sub(r"\s+", " ", value).strip().lower()
        if kind == "email":
            same = re.sub(r"\s?[\[(](?:at|@|a)[\])]\s?|\sat\s", "@", same)
            same = re.sub(r"\s?[\[(]dot[\])]\s?|\sdot\s", ".", same)
        elif kind == "person_name":
            last, comma, first = same.replace("_", " ").partition(", ")
            same = f"{first} {last}" if comma else last
        elif kind in ("phone", "id_number"):
            same = re.sub(r"[\W_]", "", same)
        return hmac.new(self.secret, f"{kind}|{same}".encode(), hashlib.sha256).hexdigest()[:20]

    def __call__(self, value: str, kind: str) -> str:
        own = getattr(self, kind, None)
        return f"[{kind.upper()} {own and own(value) or self.tag(value, kind)}]"


def masker(key: str) -> Callable[[], Callable[[str, str], str]]:
    return lambda: Pseudonyms(key)


def p4_found(spark, folder: str) -> DataFrame:
    return found(records(spark, folder, FIELDS[:2]), FIELDS, finder, "pii_type")


def p4_redacted(spark, folder: str, key: str | None = None) -> DataFrame:
    """The texts of all rows with every mention replaced by its typed placeholder.

    The key is `key`, or the session's KEY_SETTING; without either it is drawn for this call.
    """
    key = key or spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    return redacted(records(spark, folder, FIELDS[:2]), FIELDS, finder_with_dates, masker(key))
