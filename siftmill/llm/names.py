"""Names of persons in running text: a linear model over word shape, neighbours, lexicon and spelling.

A candidate is a pair (given name or initial, family name) inside a run of capitalised words. Each part and the
surroundings add evidence; from ``THRESHOLD`` on the candidate is a name. Two parts of the evidence are fitted here:
which words are ordinary (from the casing a public tokenizer's vocabulary prefers), and how much a word is spelled like
the lexicon's names (logistic regression over letter n-grams, lexicon entries against ordinary words). The rest are
weights of general cues in four languages, stated below.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable

import numpy as np

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Most entries of a vocabulary; it is broadcast with the lexicon.
MAX_VOCABULARY = 500_000
#: Most lexicon entries of one part, and most ordinary words, that the spelling model is fitted on: those with the
#: smallest checksum.
FIT_SAMPLE = 20_000
#: Evidence a candidate needs.
THRESHOLD = 2.5

SP = "[ \u00a0\u2007\u2009\u202f]"

def _compiled(pattern: str, flags: int = 0) -> re.Pattern:
    """A pattern in which ~ stands for a blank of any kind within a line."""
    return re.compile(pattern.replace("~", SP), flags)


_U, _L = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
CAP = rf"[{_U}](?:['’][{_U}])?(?:[{_L}’']+(?:[{_U}][{_L}]+)?|[{_U}’']+)(?<!['’])"
WORD = rf"{CAP}(?:-{CAP})*"
INITIAL = rf"[{_U}]\."
_PARTICLE = rf"(?:(?:van|von|der|den|de|del|della|di|da|la|le|dos|bin|ibn|zu|ten|ter){SP}){{1,3}}"

#: A run of capitalised words and initials, with at most one comma, particles between words.
RUN = re.compile(rf"(?:{WORD}|{INITIAL})(?:,?{SP}(?:{_PARTICLE})?(?:{WORD}|{INITIAL}))+")
_TOKEN = re.compile(rf"({WORD})(?![\w@])|({INITIAL})")

# Words that open or join sentences in the four languages, or name no person though capitalised.
ENGLISH = """a an and any all after also although as at be before both but by call can choose did do does during each either else
    every except explain few for from given has have he her here his how i if in into is it its just keep let may more most
    my neither never no nobody not now of on once one only or our over per please put read reply she should since so some
    such suppose than that the their then there these they this those though to two under until up we were what when where
    whether which while who whose why will with would yet you your"""
GERMAN = """aber alle als am an auf aus bei beim bis bitte da das dem den der des die dies diese doch durch ein eine einem einen
    einer er es für gegen hat ich ihr im in ist kein keine man mit nach nicht noch nur ob oder ohne seit sich sie sind so
    über um und unter vom von vor wann warum was wenn wer wie wir wird wo zu zum zur zwischen"""
FRENCH = """au aucun avec ce ces cette chaque comme dans de des donc du elle en est et il ils je la le les leur mais ne nous on ou
    où par pas personne pour quand que qui sans ses si son sous sur un une vers vous"""
SPANISH = """al algunos antes aunque cada como con cuando de del desde donde dos el ella en entre es esta este hay la las lo los más
    no nos o para pero por porque que quien se según si sin sobre su sus también todo todos un una y ya"""
FUNCTION_WORDS = frozenset(" ".join((ENGLISH, GERMAN, FRENCH, SPANISH)).split())

# Frequent given names of the four languages, beside those of the lexicon.
COMMON_GIVEN = frozenset(
    """adam alan albert alejandro alexander alice amanda amy ana andrea andreas andrew angela anna anne anthony antoine antonio barbara benjamin
    bernd betty brian bruce camille carlos carmen carol caroline catherine charles charlotte chloé christian christina christine christoph claire
    claudia cristina daniel daniela david deborah dennis diana diego donald dorothy douglas edward eleanor elena elizabeth emily emma eric
    fernando florian françois francisco frank gary george gerald hannah harold helen henry isabel isabelle jacob jacques jaime james jane janet javier
    jean jennifer jeremy jessica joan johannes john jonathan jorge josé joseph joshua joyce juan judith julia julie julien jürgen karen karl katharina
    keith kelly kenneth kevin klaus larry laura lauren laurent léa linda lisa louis lucas lucía luis madison manuel marco margaret maría maria marie
    markus martha martin mary matthew matthias michael michel miguel monica nancy natalie nathalie nicholas nicolas olivia pablo pamela patricia
    patrick paul pedro peter petra philip philippe pierre rachel rafael ralph raymond rebecca richard robert roger ronald russell sabine samantha samuel
    sandra sara sarah scott sergio sharon simon sofía sophie stefan stephanie stephen steven susan susanne teresa theresa thomas timothy uwe victor
    victoria vincent walter werner william wolfgang""".split()
)

_TITLE = _compiled(
    r"(?<![\w.])(?:mr|mrs|ms|miss|mx|dr|prof|sir|rev|herr|herrn|frau|hr|fr|ing|m|mm|mme|mlle|me|monsieur|madame|sr|sra|srta|señor|señora|don|doña)"
    r"\.?~$",
    re.I,
)
_TITLE_WORDS = frozenset("mr mrs ms miss mx dr prof sir rev herr herrn frau hr fr ing mme mlle monsieur madame sr sra srta señor señora don doña".split())
#: Labels and turns of phrase that are followed by a person.
_STRONG = re.compile(
    r"(?:"
    r"(?<![^\W_])(?:by|par|por|durch)\s?[:=]?\s?"
    r"|(?<!\w)(?:author|owner|reviewer|contact(?: person)?|attn\.?|attention|name|sender|recipient|signatory|editor|manager|patient|customer|tenant|employee"
    r"|applicant|prüfer(?:in)?|autor(?:in)?|verfasser(?:in)?|ansprechpartner(?:in)?|kontakt|inhaber(?:in)?|bearbeiter(?:in)?|relecteur|relectrice|auteur|responsable"
    r"|nom|contacto|revisora?|autora?|nombre|firmado|titular|from|to|cc|von|an|de|à|para)\s?[:=]\s{0,2}"
    r"|(?<!\w)(?:according to|belongs to|belonging to|owned by|reports to|selon|appartient à|pertenece a|gehört|laut|según|signed|dear|hi|hello|hey|bonjour|cher|chère"
    r"|hola|estimad[oa]|querid[oa]|liebe[r]?|hallo|named|called|namens)\s"
    r"|(?:regards|cheers|thanks|thank you|sincerely|yours|best|wishes|cordialement|salutations|merci|grüße|grüßen|gruß|dank|saludos|atentamente|gracias),?\s{0,2}"
    r"(?:[\n\r]\s*(?:[*•–-]\s)?|<[a-z]+/?>){1,2}"
    r")$",
    re.I,
)
_MEDIUM = _compiled(r"(?<!\w)(?:with|met|saw|told|asked|thank|ask|tell|see|von|mit|avec|con|es de|est à|est de|and|und|et|y|e)\s$", re.I)
_FRENCH = _compiled(r"(?:^|(?<!\w))(?:par|à|avec|pour|chez|de|et|cher|bonjour)~$", re.I)
#: Words after a person: what persons say, do or have.
_VERB = _compiled(
    r",?~(?:said|says|say|asked|asks|told|tells|wrote|writes|called|calls|thinks|thought|wants|wanted|knows|knew|agreed|agrees|signed|joined|left|met"
    r"|works|worked|lives|lived|sent|sends|explained|replied|confirmed|reported|noticed|decided|approved|who|whose|sagte|sagt|schrieb|fragte|erteilt|bat"
    r"|wohnt|meldete|a dit|dit|écrit|demande|demanda|dijo|dice|pidió|escribió|vive|trabaja)(?!\w)"
)
_SUBJECT = _compiled(rf"(?:'s|’s)?~[{_L}]{{2,}}")
_MIDDLE = _compiled(rf"[{_L}]{{2,}}~$")


def _grams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + n].encode()) & 4095 for n in (2, 3, 4) for i in range(len(w) - n + 1)]


def _vector(word: str) -> np.ndarray:
    v = np.zeros(4097, dtype=np.float64)
    g = _grams(word)
    v[g] = 1.0 / max(1.0, len(set(g)) ** 0.5)
    v[4096] = 1.0
    return v


def _sample(words: Iterable[str]) -> list[str]:
    return sorted(set(words), key=lambda w: (zlib.crc32(w.encode()), w))[:FIT_SAMPLE]


def fit_spelling(names: Iterable[str], ordinary: Iterable[str], rounds: int = 300, ridge: float = 1e-3) -> np.ndarray | None:
    """Weights of a logistic regression of names against ordinary words, both classes weighing the same; None where
    either is too few to tell."""
    good, bad = _sample(names), _sample(ordinary)
    if len(good) < 20 or len(bad) < 20:
        return None
    bad = bad[: max(2000, 4 * len(good))]
    x = np.stack([_vector(w) for w in good + bad])
    y = np.r_[np.ones(len(good)), np.zeros(len(bad))]
    share = np.where(y == 1, 0.5 / len(good), 0.5 / len(bad))
    w, step = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):  # gradient descent with momentum; the problem is convex and small
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = 0.9 * step - 4.0 * (x.T @ (share * (p - y)) + ridge * 0.02 * np.r_[w[:-1], 0])
        w = w + step
    return w


def read_vocabulary(path: str) -> tuple[frozenset[str], frozenset[str]]:
    """(ordinary, proper) lower-case words of a byte-level BPE rank file: those whose lower-case form is about as common
    as the capitalised one or more so, and those mostly written with a capital."""
    rank: dict[str, int] = {}
    with open(path, "rb") as f:
        for n, line in enumerate(f):
            if n >= MAX_VOCABULARY:
                raise ValueError(f"the vocabulary holds more than {MAX_VOCABULARY} entries")
            word = base64.b64decode(line.split()[0])
            if word[:1] == b" " and word[1:].isalpha():
                rank[word[1:].decode()] = n
    ordinary, proper = set(), set()
    for w, r in rank.items():
        low = w.lower()
        if w == low:
            if r <= 4 * rank.get(w.capitalize(), 10**9):
                ordinary.add(w)
        elif w == low.capitalize() and rank.get(low, 10**9) > 4 * r:
            proper.add(low)
    return frozenset(ordinary), frozenset(proper)


class NameModel:
    """Evidence for names. ``names``: (name, 'given' or 'family'); ``vocabulary``: a rank file, None for none."""

    def __init__(self, names: list[tuple[str, str]], vocabulary: str | None = DEFAULT_VOCABULARY):
        self.given = frozenset(n.lower() for n, part in names if part == "given")
        self.family = frozenset(n.lower() for n, part in names if part == "family")
        self.ordinary, self.proper = read_vocabulary(vocabulary) if vocabulary else (frozenset(), frozenset())
        plain = [w for w in self.ordinary | FUNCTION_WORDS if len(w) > 3]
        keep = lambda part: [n for n in part if n.isalpha() and n not in self.ordinary]
        self.weights = {"given": fit_spelling(keep(self.given), plain), "family": fit_spelling(keep(self.family), plain)}
        self.known: dict[tuple[str, bool], float] = {}

    def spelling(self, word: str, part: str) -> float:
        """Log odds, cut to [-0.2, 2.5], that a word is spelled like the lexicon's names of that part; 0 without a model."""
        w = self.weights[part]
        return 0.0 if w is None else float(np.clip(_vector(word) @ w, -0.2, 2.5))

    def part(self, word: str, family: bool) -> float:
        """Evidence of one name part, any hyphenated half of it counting."""
        key = (word, family)
        if key not in self.known:
            if len(self.known) > 200_000:  # the memory of words seen is bounded
                self.known.clear()
            low = word.lower()
            halves = low.split("-")
            got = [self._half(h, family) for h in halves]
            self.known[key] = min(got) if min(got) < -5 else max(got) + (0.7 if family and len(halves) == 2 else 0.0)
        return self.known[key]

    def _half(self, low: str, family: bool) -> float:
        common = low in self.ordinary
        if low in (self.family if family else self.given):
            return 1.7 if common or low in FUNCTION_WORDS else 3.5
        if low in FUNCTION_WORDS or low in _TITLE_WORDS or len(low) < 2:
            return -9.0
        if low in COMMON_GIVEN and not family:
            return 2.5
        if common:
            return -1.5
        like = self.spelling(low, "family" if family else "given")
        return 1.0 + max(0.0, like) if low in self.proper else 0.3 + like

    def around(self, text: str, start: int, end: int) -> tuple[float, float]:
        """Evidence of what stands before and after a candidate."""
        left = text[max(0, start - 40) : start]
        if _TITLE.search(left):
            before = 3.2
        elif _STRONG.search(left):
            before = 3.0
        elif _MEDIUM.search(left):
            before = 1.0
        else:
            before = 0.0
        after = 2.0 if _VERB.match(text, end) else 0.5 if _SUBJECT.match(text, end) else 0.0
        return before, after

    def find(self, text: str) -> list[tuple[int, int]]:
        """Spans of names, without titles, in order."""
        out = []
        for run in RUN.finditer(text):
            s = run.start()
            tokens = [(m.start(), m.end(), m.group(), m.lastindex == 2) for m in _TOKEN.finditer(text, s, run.end())]
            if s and (text[s - 1].isalnum() or text[s - 1] in "@+&_/-" or text[s - 1] == "." and s > 1 and text[s - 2].isalnum()):
                tokens = tokens[1:]  # the end of an address or a number
            out += self._pick(text, tokens)
        return out

    def _pick(self, text: str, tokens: list[tuple[int, int, str, bool]]) -> list[tuple[int, int]]:
        words = sum(not t[3] for t in tokens)
        if words > 6 and not self.given:
            return []
        best: list[tuple[float, int, int, int]] = []
        for i, (_, _, _, initial) in enumerate(tokens[:-1]):
            for j in (i + 1, i + 2):
                if j >= len(tokens):
                    break
                score = self._score(text, tokens, i, j, words)
                if score >= THRESHOLD:
                    whole = j == i + 2 and not initial and tokens[i + 1][3]  # given name, middle initial, family name
                    best.append((score + 4.0 * whole, -i, i, j))
        out, taken = [], set()
        for _, _, i, j in sorted(best, reverse=True):
            if not taken & set(range(i, j + 1)):
                taken |= set(range(i, j + 1))
                out.append((tokens[i][0], tokens[j][1]))
        return sorted(out)

    def _score(self, text: str, tokens, i: int, j: int, words: int) -> float:
        (s, e1, first, initial), (s2, e, last, last_initial) = tokens[i], tokens[j]
        gap = text[e1 : tokens[i + 1][0]]
        comma = gap.startswith(",")
        middle = tokens[i + 1] if j == i + 2 else None
        if not (last_initial or comma or initial) and first.isupper() != last.isupper():
            return -9.0
        if first == "M." and _FRENCH.search(text, max(0, s - 12), s):  # Monsieur
            return -9.0
        if comma:  # Family, Given or Family, G. or Family, Given M.
            if initial or middle and (not last_initial or middle[3]):
                return -9.0
            given, given_initial = (middle[2], False) if middle else (last, last_initial)
            parts = self.part(first, True) + (2.0 if given_initial else self.part(given, False)) - 0.5
            parts += 0.7 if middle else 0.0
        else:
            if last_initial or text[tokens[j - 1][1] : s2].startswith(","):
                return -9.0
            parts = self.part(last, True)
            if middle and not middle[3]:  # three words: only if each of them could be a name
                m = max(self.part(middle[2], False), self.part(middle[2], True))
                if initial or m < 0.8 or parts < 0.8 or last.lower() in self.ordinary:
                    return -9.0
                parts += 0.3
            parts += 2.5 if initial else self.part(first, False)
            parts += 1.5 if middle and middle[3] else 0.0
        if parts < -3 or words > 6 and parts < 4.5:  # a whole sentence in capitals
            return -9.0
        before, after = self.around(text, s, e)
        if len(gap) > 2:  # particles between the two
            parts -= 0.7
        if i and before == 0.0 and not initial and tokens[i - 1][2].lower() not in FUNCTION_WORDS and tokens[i - 1][2].lower().rstrip(".") not in _TITLE_WORDS:
            parts -= 0.4  # inside a longer run
        after_word = tokens[j + 1][2].lower() if j + 1 < len(tokens) else ""
        if after_word in self.ordinary and after_word not in FUNCTION_WORDS:
            parts -= 0.6  # the run goes on with an ordinary word, as titles do
        if initial and not comma and _MIDDLE.search(text, max(0, s - 24), s) and after:
            parts += 1.5  # a lone capital in mid-sentence, and the sentence goes on
        return parts + before + after
