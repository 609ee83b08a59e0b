"""Keyed permutations within a format: numbers, letters and dates become others of the same form.

A value's letters and digits are one number in a mixed radix, permuted by a two-part Feistel network whose round
function is a keyed HMAC. Values that have to satisfy a rule (a valid area, a calendar date) walk the cycle of the
permutation to the next valid one, which keeps it one to one among the valid values; check digits are computed anew. The
same value gives the same pseudonym in every document, whatever way it is written.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable
from datetime import date

ROUNDS = 10
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Days that dates are permuted among: 1900-01-01 to 2099-12-31.
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
# Check letters of Spanish identity numbers by remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _round(key: bytes, tag: str, i: int, value: int, size: int) -> int:
    return int.from_bytes(hmac.new(key, f"{tag}:{i}:{value}".encode(), hashlib.sha256).digest()[:24], "big") % size


def permute(x: int, a: int, b: int, key: bytes, tag: str, back: bool = False) -> int:
    """Keyed permutation of 0 .. a * b - 1; ``back`` is its inverse."""
    left, right = divmod(x, b)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2 == 0:
            left = (left + sign * _round(key, tag, i, right, a)) % a
        else:
            right = (right + sign * _round(key, tag, i, left, b)) % b
    return left * b + right


def permute_chars(value: str, key: bytes, tag: str = "", valid: Callable[[str], bool] | None = None, back: bool = False) -> str:
    """``value`` (digits and A-Z) with each character replaced by one of its kind. If ``valid`` holds for the value, it
    holds for the result; if not, it does not hold for the result either."""
    radix = [10 if c.isdigit() else 26 for c in value]
    half = len(radix) // 2
    a = b = 1
    for r in radix[:half]:
        a *= r
    for r in radix[half:]:
        b *= r
    if a * b < 2:
        return value
    kind = "".join("9" if r == 10 else "A" for r in radix)
    want = valid(value) if valid else None
    while True:
        x = 0
        for c, r in zip(value, radix):
            x = x * r + (int(c) if r == 10 else UPPER.index(c))
        x = permute(x, a, b, key, f"{tag}:{kind}", back)
        out = []
        for r in reversed(radix):
            x, d = divmod(x, r)
            out.append(str(d) if r == 10 else UPPER[d])
        value = "".join(reversed(out))
        if valid is None or valid(value) == want:
            return value


def fill(template: str, chars: str) -> str:
    """``template`` with its ASCII digits and upper-case letters replaced by ``chars`` in turn."""
    new = iter(chars)
    return re.sub("[0-9A-Z]", lambda _: next(new), template)


# ---------------------------------------------------------------- telephone numbers

#: Calling codes of more than the first digit's length rule; others are two digits long.
_ONE_DIGIT_CODES, _THREE_DIGIT_STARTS = ("1", "7"), ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99")


def split_phone(value: str) -> tuple[str, str, str]:
    """(prefix, national number, rest) as slices of the value: prefix holds the country code and the trunk 0, rest the
    extension. Only digits of the middle part identify the line, so all ways to write it share them."""
    ext = re.search(r"(?i)[\s,]*(?:ext\.?|extension|x|durchwahl|poste|anexo|#)\s*\d{1,6}$", value)
    body, rest = (value[: ext.start()], value[ext.start() :]) if ext else (value, "")
    at = 0
    plus = re.match(r"\s*(?:\+|00(?=\s?[1-9]))\s?", body)
    if plus:
        digits = re.sub(r"\D", "", body[plus.end() :])
        n = 1 if digits[:1] in _ONE_DIGIT_CODES else 3 if digits[:2] in _THREE_DIGIT_STARTS else 2
        at = plus.end()
        while n and at < len(body):
            n -= body[at].isdigit()
            at += 1
        trunk = re.match(r"[\s.\-‐‑‒–/]*\(0\)", body[at:])
        at += trunk.end() if trunk else 0
    else:
        digits = re.sub(r"\D", "", body)
        trunk = re.match(r"\(?0", body) or (re.match(r"1", body) if len(digits) == 11 and digits[0] == "1" else None)
        at = trunk.end() if trunk else 0
    return body[:at], body[at:], rest


def valid_nanp(n: str) -> bool:
    return len(n) == 10 and n[0] in "23456789" and n[3] in "23456789"


def phone_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    prefix, line, rest = split_phone(value)
    digits = "".join(re.findall("[0-9]", line))
    inner = "".join(re.findall("[0-9]", rest))
    valid = valid_nanp if len(digits) == 10 else (lambda n: n[:1] != "0")
    new = permute_chars(digits, key, "phone", valid, back) if len(digits) > 1 else digits
    ext = permute_chars(inner, key, "extension", None, back) if len(inner) > 1 else inner
    return prefix + _refill(line, new) + _refill(rest, ext)


def _refill(template: str, digits: str) -> str:
    new = iter(digits)
    return re.sub("[0-9]", lambda _: next(new), template)


# ---------------------------------------------------------------- identity numbers


def _weighted(s: str) -> int:
    """Check digit of machine-readable documents: weights 7, 3, 1 in turn."""
    return sum((int(c) if c.isdigit() else ord(c) - 55) * (7, 3, 1)[i % 3] for i, c in enumerate(s)) % 10


def _nir_key(s: str) -> str:
    """Two check digits of the French register number; department 2A counts as 19, 2B as 18."""
    n = s[:5] + {"2A": "19", "2B": "18"}.get(s[5:7], s[5:7]) + s[7:]
    return f"{97 - int(n) % 97:02d}" if n.isdigit() else "--"


def _dni_number(s: str) -> int:
    return int(s[:-1].translate(str.maketrans("XYZ", "012")))


def valid_ssn(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[3:5] != "00" and s[5:] != "0000"


def valid_nino(s: str) -> bool:
    """Forms in use and the QQ of examples."""
    return s[:2] == "QQ" or s[0] not in "DFIQUV" and s[1] not in "DFIOQUV" and s[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


def id_kind(value: str) -> tuple[str, str]:
    """(kind, characters) of an identity number as written; kind is 'other' for forms not known here."""
    s = re.sub("[^0-9A-Z]", "", value.upper())
    if re.fullmatch(r"\d{9}", s):
        return "ssn", s
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", s):
        return "nino", s
    if re.fullmatch(r"[1-9]\d{5}[\dAB]\d{8}", s):
        return "nir", s
    if re.fullmatch(r"(?:\d{8}|[XYZ]\d{7})[A-Z]", s):
        return "dni", s
    if re.fullmatch(r"[A-Z][0-9A-Z]{8}\d", s):
        return "card", s
    return "other", s


def id_checks(value: str) -> bool | None:
    """Whether the number's own rules hold; None if its form has none."""
    kind, s = id_kind(value)
    if kind == "ssn":
        return valid_ssn(s)
    if kind == "nino":
        return valid_nino(s)
    if kind == "nir":
        return _nir_key(s[:13]) == s[13:]
    if kind == "dni":
        return DNI_LETTERS[_dni_number(s) % 23] == s[-1]
    if kind == "card":
        return _weighted(s[:9]) == int(s[9])
    return None


def id_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """A number of the same kind and form. Where the check digit is right the payload is permuted and the digit computed
    anew; where it is wrong all characters are permuted to another wrong one."""
    kind, s = id_kind(value)
    good = id_checks(value)
    if kind == "ssn":
        new = permute_chars(s, key, kind, valid_ssn, back)
    elif kind == "nino":
        turn = _round(key, "nino-end", 0, 0, 4)
        new = permute_chars(s[:8], key, kind, valid_nino, back) + UPPER[(UPPER.index(s[8]) + (-turn if back else turn)) % 4]
    elif kind == "dni" and good:
        lead = s[0] if s[0] in "XYZ" else ""
        body = lead + permute_chars(s[len(lead) : -1], key, f"dni{len(lead)}", None, back)
        new = body + DNI_LETTERS[_dni_number(body + "A") % 23]
    elif kind == "card" and good:
        body = permute_chars(s[:9], key, kind, None, back)
        new = body + str(_weighted(body))
    elif kind == "nir":
        letter = s[6] if s[6] in "AB" else ""  # of the two Corsican departments; it stays
        whole = lambda x: x[:6] + letter + x[6:] if letter else x
        digits = s.replace(letter, "") if letter else s
        if good:  # sex stays, the month stays in the calendar; year, department, commune and order are permuted
            body = whole(digits[0] + _nir_body(digits[1:-2], key, back))
            new = body + _nir_key(body)
        else:
            new = whole(permute_chars(digits, key, "nir-wrong", lambda x: bool(id_checks(whole(x))), back))
    elif kind == "dni":
        lead = s[0] if s[0] in "XYZ" else ""
        new = lead + permute_chars(s[len(lead) :], key, f"dni-wrong{len(lead)}", lambda x: DNI_LETTERS[_dni_number(lead + x) % 23] == x[-1], back)
    elif kind == "card":
        new = permute_chars(s, key, "card-wrong", lambda x: _weighted(x[:9]) == int(x[9]), back)
    else:
        new = permute_chars(s, key, kind, None, back)
    return fill(value.upper(), new)


def _nir_body(s: str, key: bytes, back: bool) -> str:
    """Digits of year, month, department, commune and order; the month moves among the calendar's or stays."""
    month = s[2:4]
    rest = permute_chars(s[:2] + s[4:], key, "nir", None, back)
    if "01" <= month <= "12":
        step = _round(key, "nir-month", 0, int(s[:2] + s[4:]) if not back else int(rest), 12)
        month = f"{(int(month) - 1 + (-step if back else step)) % 12 + 1:02d}"
    return rest[:2] + month + rest[2:]


# ---------------------------------------------------------------- dates

_MONTHS = {
    name: k // 4 % 12 + 1
    for k, name in enumerate(
        # Months of the four languages, three letters or more of each
        """january januar janvier enero february februar février febrero march märz mars marzo april april avril abril may mai mai mayo june juni juin junio
        july juli juillet julio august august août agosto september september septembre septiembre october oktober octobre octubre
        november november novembre noviembre december dezember décembre diciembre""".split()
    )
}


def parse_date(value: str) -> tuple[date, str] | None:
    """The date and its form (ymd, dmy, mdy or words), None if it is none. dmy is taken where both could be."""
    try:
        if m := re.fullmatch(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", value):
            return date(int(m[1]), int(m[2]), int(m[3])), "ymd"
        if m := re.fullmatch(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", value):
            d, mon = int(m[1]), int(m[2])
            return (date(int(m[3]), mon, d), "dmy") if mon <= 12 else (date(int(m[3]), d, mon), "mdy")
        if m := re.fullmatch(r"(\d{1,2})(?:st|nd|rd|th|er|\.)?(?:\s+de)?\s+([^\W\d]+)\.?(?:\s+de)?\s+(\d{4})", value):
            return date(int(m[3]), month_of(m[2]), int(m[1])), "words"
        if m := re.fullmatch(r"([^\W\d]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", value):
            return date(int(m[3]), month_of(m[1]), int(m[2])), "words"
    except (ValueError, KeyError):
        pass
    return None


def month_of(name: str) -> int:
    low = name.lower()
    return _MONTHS[low] if low in _MONTHS else next(n for w, n in _MONTHS.items() if len(low) >= 3 and w.startswith(low))


def date_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """Another calendar date in the same form; written months come out as numbers, year first."""
    try:
        got = parse_date(value)
    except StopIteration:
        got = None
    if got is None:
        return "-"
    day, form = got
    n = LAST_DAY - FIRST_DAY + 1
    x = day.toordinal() - FIRST_DAY
    if not 0 <= x < n:
        return "-"
    while True:
        x = permute(x, 300, 300, key, "date", back)
        if x < n:
            break
    new = date.fromordinal(FIRST_DAY + x)
    if form == "words":
        return new.isoformat()
    parts = {"ymd": (f"{new.year}", f"{new.month:02d}", f"{new.day:02d}"), "dmy": (f"{new.day:02d}", f"{new.month:02d}", f"{new.year}"), "mdy": (f"{new.month:02d}", f"{new.day:02d}", f"{new.year}")}[form]
    seps = re.findall(r"[-/.]", value)
    return parts[0] + seps[0] + parts[1] + seps[1] + parts[2]


# ---------------------------------------------------------------- words


def canonical_email(value: str) -> str:
    """The address as mail programs take it: marks of every notation as @ and dots, lower case, no blanks."""
    s = value.lower()
    s = re.sub(r"\s*[(\[{<]\s*(?:at|@|arroba)\s*[)\]}>]\s*|%40|&#64;|&commat;|＠", "@", s)
    s = re.sub(r"\s*[(\[{<]\s*(?:dot|punkt|point|punto|\.)\s*[)\]}>]\s*|\s+dot\s+", ".", s)
    return re.sub(r"\s+", "", re.sub(r"\s+at\s+", "@", s))


def canonical_name(value: str) -> str:
    """given family in lower case, without middle initials."""
    s = " ".join(value.lower().split())
    if "," in s:
        last, first = (x.strip() for x in s.split(",", 1))
        s = f"{first} {last}"
    return " ".join(w for i, w in enumerate(s.split()) if not (i and re.fullmatch(r"\w\.", w)))


def tag(kind: str, value: str, key: bytes) -> str:
    """A keyed tag for values without a format."""
    plain = {"email": canonical_email, "name": canonical_name}.get(kind, lambda v: " ".join(re.findall(r"\w+", v.lower())))(value)
    return hmac.new(key, f"{kind}:{plain}".encode("utf-8", "replace"), hashlib.sha256).hexdigest()[:10]
