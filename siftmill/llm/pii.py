"""Personal information in free text: find it, and replace it by typed placeholders with linkable pseudonyms.

Formats are found around cheap anchors (an at sign, a run of digits, a run of capitalised words), so most of a text is
read once by one simple pattern. Numbers need a label or check digits that hold; names are the matter of ``names``.
Telephone and identity numbers and dates of birth are permuted within their format by a keyed Feistel network, so that
equal values stay linked whatever their notation; other kinds get a keyed tag of their canonical form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import pseudonyms
from siftmill.llm.names import CAP, DEFAULT_VOCABULARY, SP, NameModel
from siftmill.shared import spread

#: Most names the lexicon may hold; it is broadcast.
MAX_LEXICON = 2_000_000
KINDS = ("email", "phone", "idnum", "street", "name")

_HY = "[-‐‑‒–]"
# ---------------------------------------------------------------- emails
_AT = rf"(?:@|＠|{SP}?[(\[{{<]{SP}?(?:at|AT|At|@|arroba){SP}?[)\]}}>]{SP}?|%40|&#64;|&commat;)"
_DOT = rf"(?:\.|{SP}?[(\[{{<]{SP}?(?:dot|DOT|Dot|punkt|point|punto|\.){SP}?[)\]}}>]{SP}?)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = rf"[A-Za-z0-9_+%](?:[A-Za-z0-9_+%'-]|{_DOT}(?=[A-Za-z0-9_+%-]))*"
_EMAIL = re.compile(
    rf"(?<![\w.+%/-])(?:{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+"
    rf"|[A-Za-z0-9_.+%-]+{SP}(?:at|AT){SP}{_LABEL}(?:{SP}(?:dot|DOT){SP}{_LABEL})+)(?![\w@])"
)
_AT_SIGN = re.compile(rf"[@＠%&(\[{{<](?:(?<=[@＠])|40|#64;|commat;|{SP}?(?:at|AT|At|@|arroba){SP}?[)\]}}>])|{SP}(?:dot|DOT){SP}")
#: Characters around an at sign that are searched first; a match that reaches an end is searched again in more.
_EMAIL_REACH = 100
#: Endings that mark a file name rather than a domain.
_FILE_ENDINGS = frozenset("png jpg jpeg gif webp svg bmp tif tiff pdf txt zip css js".split())

# ---------------------------------------------------------------- numbers
_DIGITS = re.compile(rf"[0-9](?:[0-9A-Z]|[()./+]|{_HY}|{SP}(?=[(0-9A-Z+]))*")
_DATE = re.compile(r"(?:\d{4}([-/.])\d\d\1\d\d|\d\d([/.-])\d\d\2\d{4})(?:[ T.]\d{0,2})?")
_SEP = f"(?:{SP}|[.]|{_HY})"
_EXT = rf"(?:,?{SP}?(?:ext\.?|extension|x|Durchwahl|poste|anexo){SP}?\d{{1,5}})?"
_PHONE = re.compile(
    rf"(?<![\w.,;/+-])(?<!\d{SP})(?:"
    rf"(?:\+1{_SEP}|1{_SEP})?(?:\([2-9]\d\d\){SP}?|[2-9]\d\d{_SEP})[2-9]\d\d{_SEP}\d{{4}}{_EXT}"  # North America
    rf"|(?:\+44{SP}?(?:\(0\))?\d{{2,4}}|\(0\d{{2,4}}\)|0\d{{2,4}}){_SEP}\d{{3,4}}{_SEP}?\d{{4}}{_EXT}"  # Great Britain
    rf"|(?:\+44{SP}|0)\d{{4}}{SP}\d{{6}}{_EXT}"
    rf"|(?:\+49{SP}?(?:\(0\))?\d{{2,5}}|\(0\d{{2,5}}\)|0\d{{2,5}})(?:{SP}|/|{_HY})\d{{4,9}}(?:(?:{_HY}|{SP})\d{{1,5}})?{_EXT}"  # Germany
    rf"|(?:\+33{SP}?(?:\(0\))?\d|0\d)(?:(?:{SP}|[.-])\d\d){{4}}{_EXT}"  # France
    rf"|(?:\+34{SP})?\d{{3}}(?:{SP}\d\d){{3}}{_EXT}"  # Spain
    rf"|\+\d{{1,3}}(?:{_SEP}?\(?\d{{1,4}}\)?){{2,6}}{_EXT}"  # any other with a country code
    rf"|\+?\d{{7,15}}{_EXT}"  # unbroken: only after a label
    rf")(?![\w/]|[.,]\d|{_HY}\d)"
)
_PHONE_LABEL = re.compile(
    r"(?:phone|tel|tél|telefon|teléfono|téléphone|mobile|mobil|móvil|cell|call|ring|fax|voice|handy|hotline|helpdesk|whatsapp|dial|sms|anruf\w*|appel\w*|llam\w*|portable)"
    r"\b[^\w\n]{0,3}(?:\w+[^\w\n]{1,3}){0,2}$",
    re.I,
)
#: A number after one of these names a thing, not a telephone.
_NO_PHONE = re.compile(r"(?:\bSN|\bno\.|\bnr\.|\bserial|\bticket|\bversion|\border|\binvoice|#)\s?$", re.I)
_NO_PHONE_AFTER = re.compile(rf"{SP}?(?:bytes|octets|Bytes|[KMGT]i?B|ms|s|entries|files|rows|%|°)(?!\w)")
_IDNUM = re.compile(
    rf"(?<![\w.,;/+-])(?:"
    rf"(?P<ssn>\d{{3}}(?P<s>{_HY}|{SP})\d\d(?P=s)\d{{4}})"  # social security
    rf"|[A-Z]{{2}}{SP}?\d\d{SP}?\d\d{SP}?\d\d{SP}?[A-D]"  # national insurance
    rf"|[A-Z]\d{{4}}[A-Z]\d{{5}}|[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{{8}}\d(?=\D|$)"  # identity card
    rf"|[1-9]{SP}?\d\d{SP}?(?:0[1-9]|1[0-2]|[2-9]\d){SP}?\d[\dAB]{SP}?\d{{3}}{SP}?\d{{3}}(?:{SP}?\d\d)?"  # French register
    rf"|[XYZ]?{_HY}?\d{{7,8}}{_HY}?[A-Z]"  # Spanish identity
    rf")(?![\w/]|[.,]\d|{_HY}\d)"
)
_ID_LABEL = re.compile(
    r"(?:SSN|social security|insurance|national id|id card|identity|passport|ausweis|personalausweis|steuer|sozialvers|identit|sécurité|NIR|INSEE|DNI|NIE|NIF|identidad|tax)[^\n\d]{0,24}$",
    re.I,
)
_BIRTH = re.compile(
    r"(?<!\w)(?:born|birth\s?day|birth|DOB|date of birth|geboren|geb\.|geburtsdatum|geburtstag|née?|naissance|nacid[oa]|nacimiento)(?:\s(?:on|am|le|el))?\s?:?\s{0,2}"
    r"(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}(?:st|nd|rd|th|er|\.)?\s(?:de\s)?[^\W\d]{3,10}\.?\s(?:de\s)?\d{4}|[A-Z][a-z]{2,8}\.?\s\d{1,2}(?:st|nd|rd|th)?,?\s\d{4})(?!\d)",
    re.I,
)

#: One of these is in every text with a date of birth, whatever the case of its label's first letter.
_BIRTH_WORDS = ("orn ", "irth", "IRTH", "ORN ", "DOB", "dob", "eboren", "eb.", "eburts", "né ", "née ", "Né ", "Née ", "aissance", "acid", "acimiento")

# ---------------------------------------------------------------- streets
_UNIT = rf"(?:,?{SP}(?:Apt|Apartment|Unit|Flat|Suite|Ste|Floor|Fl|Room|Rm|#)\.?{SP}?[A-Za-z]?\d*[A-Za-z]?\b)?"
_EN_KIND = r"(?:Rd|Road|St|Street|Ave|Avenue|Lane|Ln|Blvd|Boulevard|Drive|Dr|Way|Court|Ct|Square|Sq|Terrace|Close|Crescent|Place|Pl|Hill|Row)"
_WORD = r"[A-ZÄÖÜÀ-Þ][\w'’ß-]*"
_STREET_AFTER = re.compile(
    rf"(?<![\w/.,-])(?:"
    rf"\d{{1,5}}[A-Za-z]?(?!{SP}[KMGT]?B\b){SP}(?:{_WORD}{SP}){{1,3}}{_EN_KIND}\b(?:\.(?=,?{SP}(?:Apt|Unit|Flat|Suite|Floor)))?{_UNIT}"
    rf"|\d{{1,5}}(?:{SP}(?:bis|ter|quater))?,?{SP}(?:rue|avenue|boulevard|bd|allée|chemin|impasse|place|quai|route|cours)(?:{SP}(?:des|de{SP}la|de{SP}l['’]|du|de|d['’]))?{SP}?{_WORD}(?:,{SP}\d+(?:er|e|ème){SP}étage|,{SP}(?:bât|apt|appt)\.?{SP}\w+)?"
    rf")"
)
_STREET_ES = re.compile(
    rf"[CAPRT](?<![\w/.,-][CAPRT])(?:/|alle|venida|vda\.?|laza|aseo|amino|onda|ravesía){SP}(?:(?:de|del|de{SP}la|de{SP}los){SP})?{_WORD}(?:{SP}{_WORD})*,?{SP}(?:n\.?º{SP}?)?\d{{1,5}}[A-Za-z]?(?:,{SP}(?:bajo|ático|entresuelo|\d+[.ºª°]+{SP}?[A-Za-z]?(?:zq|cha)?\.?(?<!\.)))?"
)
_STREET_DE = re.compile(
    rf"(?<![\w/.,-])(?:{_WORD}(?:straße|strasse|str\.|gasse|allee|weg|platz|ring|damm|ufer){SP}\d{{1,5}}[a-z]?\b"
    rf"|{_WORD}(?:{SP}{_WORD})?{SP}(?:Str\.|Straße|Strasse|Weg|Gasse|Allee|Platz|Ring|Damm|Ufer){SP}\d{{1,5}}[a-z]?\b)"
)
_NUMBERED = re.compile(rf"[0-9]{{1,5}}(?:[A-Za-z]|{SP}(?:bis|ter|quater))?,?{SP}(?:[A-ZÄÖÜÀ-Þ]|rue|avenue|boulevard|bd|allée|chemin|impasse|place|quai|route|cours)")
_SPACED_DIGIT = re.compile(rf"{SP}[0-9]")
_DE_KINDS = tuple(x + y for x in ("s", "S") for y in ("traße", "trasse", "tr.")) + tuple(c + y for x, y in (("gG", "asse"), ("aA", "llee"), ("wW", "eg"), ("pP", "latz"), ("rR", "ing"), ("dD", "amm"), ("uU", "fer")) for c in x)
#: Characters that a street name may take before its kind.
_STREET_REACH = 60


class Finder:
    """Finds personal information. ``names``: (name, 'given' or 'family'); ``vocabulary`` see ``names.NameModel``."""

    def __init__(self, names: list[tuple[str, str]], vocabulary: str | None = DEFAULT_VOCABULARY):
        self.names = NameModel(names, vocabulary)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Non-overlapping (start, end, kind) in order; at an overlap the kind found first in KINDS stays, dates of birth
        ('date') come before all."""
        if not text:
            return []
        taken: list[tuple[int, int, str]] = []

        def add(s: int, e: int, kind: str) -> None:
            if s < e and not any(s < y and x < e for x, y, _ in taken):
                taken.append((s, e, kind))

        for m in _BIRTH.finditer(text) if any(w in text for w in _BIRTH_WORDS) else ():
            if pseudonyms.date_pseudonym(m[1], b"") != "-":
                add(*m.span(1), "date")
        for s, e in self._emails(text):
            add(s, e, "email")
        regions = [m.span() for m in _DIGITS.finditer(text) if m.end() - m.start() >= 6]
        for a, b in regions:
            if _DATE.fullmatch(text, a, b):
                continue
            for s, e in self._idnums(text, a, b):
                add(s, e, "idnum")
        for a, b in regions:
            for s, e in self._phones(text, a, b):
                add(s, e, "phone")
        for s, e in self._streets(text):
            add(s, e, "street")
        for s, e in self.names.find(text):
            add(s, e, "name")
        return sorted(taken)

    def _emails(self, text: str) -> Iterator[tuple[int, int]]:
        done = 0
        for at in _AT_SIGN.finditer(text):
            if at.start() < done:
                continue
            reach = _EMAIL_REACH
            while True:
                a, b = max(0, at.start() - reach), min(len(text), at.end() + reach)
                m = next((m for m in _EMAIL.finditer(text, a, b) if m.end() > at.start()), None)
                if m is None or (m.start() > a or a == 0) and (m.end() < b - 1 or b == len(text)):
                    break
                reach *= 8
            if m and m.start() < at.end():
                done = m.end()
                if m.group().rsplit(".", 1)[-1].lower() not in _FILE_ENDINGS:
                    yield m.span()

    @staticmethod
    def _idnums(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
        for m in _IDNUM.finditer(text, max(0, a - 4), min(len(text), b + 4)):
            if m.end() < min(len(text), b + 4) or m.end() == len(text) or not (text[m.end()].isalnum() or text[m.end()] in "/-"):
                good = pseudonyms.id_checks(m.group())
                labelled = _ID_LABEL.search(text, max(0, m.start() - 48), m.start())
                if labelled and not (m.group("ssn") and not good) or good and _self_evident(m):
                    yield m.span()

    @staticmethod
    def _phones(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
        for m in _PHONE.finditer(text, max(0, a - 3), min(len(text), b + 40)):
            if m.start() >= b:  # belongs to the next run of digits
                return
            before = text[max(0, m.start() - 28) : m.start()]
            if _NO_PHONE.search(before) or _NO_PHONE_AFTER.match(text, m.end()):
                continue
            core = m.group()
            if core.lstrip("+").isdigit() and not (core[0] == "+" and len(core) > 8) and not _PHONE_LABEL.search(before):
                continue
            if 7 <= sum(map(str.isdigit, core)) <= 20:
                yield m.span()

    @staticmethod
    def _streets(text: str) -> Iterator[tuple[int, int]]:
        for n in _NUMBERED.finditer(text):
            if m := _STREET_AFTER.match(text, n.start()):
                yield m.span()
        yield from (m.span() for m in _STREET_ES.finditer(text))
        for k in _SPACED_DIGIT.finditer(text):
            if text.endswith(_DE_KINDS, max(0, k.start() - 8), k.start()):
                for m in _STREET_DE.finditer(text, max(0, k.start() - _STREET_REACH)):
                    if m.end() >= k.end():
                        yield m.span()
                        break


def _self_evident(m: re.Match) -> bool:
    """Forms that are taken without a label when their check holds: hyphened social security numbers of a real area, and
    forms with check digits."""
    kind, s = pseudonyms.id_kind(m.group())
    return kind == "ssn" and "9" != s[0] and " " not in m.group() or kind in ("nir", "dni") and m.group()[-1] == s[-1]


def placeholder(kind: str, value: str, key: bytes) -> str:
    """The typed placeholder of a value: a pseudonym in its format for numbers and dates, a keyed tag for the rest."""
    if kind == "phone":
        return f"[PHONE {pseudonyms.phone_pseudonym(value, key)}]"
    if kind == "idnum":
        return f"[IDNUM {pseudonyms.id_pseudonym(value, key)}]"
    if kind == "date":
        return f"[DATE {pseudonyms.date_pseudonym(value, key)}]"
    return f"[{kind.upper()} {pseudonyms.tag(kind, value, key)}]"


def redact(text: str, spans: list[tuple[int, int, str]], key: bytes) -> str:
    out, last = [], 0
    for s, e, kind in spans:
        out += [text[last:s], placeholder(kind, text[s:e], key)]
        last = e
    return "".join(out) + text[last:]


# ---------------------------------------------------------------- operators


def _lexicon(spark: SparkSession, names: DataFrame, vocabulary: str | None):
    """The fitted finder, broadcast: its size is bounded by MAX_LEXICON and names.MAX_VOCABULARY."""
    rows = names.select("name", "name_part").filter("name is not null and name_part is not null").limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the lexicon holds more than {MAX_LEXICON} names")
    return spark.sparkContext.broadcast(Finder(sorted((r.name, r.name_part.strip().lower()) for r in rows), vocabulary))


def _columns(documents: DataFrame) -> DataFrame:
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def find_pii(documents: DataFrame, names: DataFrame, vocabulary: str | None = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, pii_kind, pii_text) of every find, with repeats; null and empty texts have none.

    ``names``: name, name_part ('given' or 'family'); an empty lexicon leaves the finds by context. Kinds are those of
    KINDS and 'date' for dates of birth. A labelled identity number counts even if its check digit is wrong; without a
    label it has to be right. ``vocabulary`` is read on the driver only. Other columns are ignored; rows that repeat a
    doc_id are searched each.
    """
    finder = _lexicon(documents.sparkSession, names, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder.value.spans
        for batch in batches:
            rows = [(d, k, t[s:e]) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for s, e, k in spans(t or "")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "pii_kind", "pii_text"],
            )

    return _columns(documents).mapInArrow(run, "doc_id long, pii_kind string, pii_text string")


def redact_pii(documents: DataFrame, names: DataFrame, key: bytes, vocabulary: str | None = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, text, finds): every text with typed placeholders; a null text stays null with no finds.

    ``key`` is the secret of the pseudonyms, at least 16 bytes; whoever has it can take numbers and dates back.
    """
    if len(key) < 16:
        raise ValueError("the key of the pseudonyms needs 16 bytes or more")
    finder = _lexicon(documents.sparkSession, names, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [f.spans(t or "") for t in texts]
            new = [redact(t, s, key) if s else t for t, s in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(new, pa.string()), pa.array([len(s) for s in found], pa.int64())], ["doc_id", "text", "finds"])

    return _columns(documents).mapInArrow(run, "doc_id long, text string, finds long")
