"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score."""

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Order of the kinds, patterns and digit counts of the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "routing", "dni", "nir")
BASE_KINDS = KINDS[:4]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its first digit only: from a later one the rest of the pattern is the same.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ROUTING = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-])")
_DNI = re.compile(r"(?<![0-9A-Za-z.-])([0-9]{8}|[XYZ][0-9]{7})-?([A-Z])(?![0-9A-Za-z-])")
_NIR = re.compile(r"(?<![0-9A-Za-z.-])([12](?:\x20?[0-9]){12})\x20?([0-9]{2})(?![0-9A-Za-z-])")
# Check letters of Spanish identity numbers, weights of American bank routing numbers.
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_ROUTING_WEIGHTS = (3, 7, 1) * 3
_NOT_DIGIT = re.compile(r"[^0-9]")

# Score of a confirmed match, the words nearby that add to it and those that take from it. The checksum of an account
# number is strong, the others need their words.
_SCORES = {
    "email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3, "routing": 0.3, "dni": 0.4, "nir": 0.4
}
_CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|contact|write)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|server|host)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|payment)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security)\b"),
    "routing": re.compile(r"(?i)\b(?:routing|aba|rtn)\b"),
    "dni": re.compile(r"(?i)\b(?:dni|nif|nie|identidad)\b"),
    "nir": re.compile(r"(?i)\b(?:nir|insee|s[ée]curit[ée] sociale)\b"),
}
_AGAINST = re.compile(
    r"(?i)\b(?:order|invoice|serial|part|model|sku|isbn|ean|version|build|ticket|tracking|example|sample|dummy|placeholder)\b"
)
_CONTEXT_SIGNS = 40
_CONTEXT_GAIN = 0.3
MIN_SCORE = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for place, sign in enumerate(reversed(digits)):
        value = int(sign) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """The checksum of an account number: letters as 10 to 35, the first four signs moved to the end."""
    signs = iban.replace(" ", "")
    return int("".join(str(int(s, 36)) for s in signs[4:] + signs[:4])) % 97 == 1


def _emails(text):
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        domain = _DOMAIN.match(text, at)
        # Backwards over the signs of a local part, not into the match before.
        begin = at
        while begin > done and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
            begin -= 1
        if domain and begin < at:
            done = domain.end()
            yield begin, done
            at = done
        else:
            # What was walked over cannot be part of a later match: an at sign ends it.
            done = at = at + 1


def _ips(text):
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.groups()):
            yield m.span()


def _cards(text):
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text):
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text):
    at = 0
    while m := _IBAN.search(text, at):
        # Words in capitals may follow the number: the longest confirmed beginning counts.
        for end in range(m.end(), m.start() + 14, -1):
            signs = text[m.start() : end]
            if signs[-1] != " " and (end == len(text) or not text[end].isalnum()) and mod_97(signs):
                yield m.start(), end
                at = end
                break
        else:
            # Another number may begin inside what was proposed.
            at = m.start() + 1


def _ssns(text):
    """Numbers that can be given out: no area 000, 666 or 900 to 999, no group 00, no serial 0000."""
    for m in _SSN.finditer(text):
        area, group, serial = map(int, m.groups())
        if area not in (0, 666) and area < 900 and group and serial:
            yield m.span()


def _routings(text):
    """Bank routing numbers: a used district in front and a weighted sum that 10 divides."""
    for m in _ROUTING.finditer(text):
        district = int(m[0][:2])
        used = district <= 12 or 21 <= district <= 32 or 61 <= district <= 72 or district == 80
        if used and int(m[0]) and sum(w * int(d) for w, d in zip(_ROUTING_WEIGHTS, m[0])) % 10 == 0:
            yield m.span()


def _dnis(text):
    """Spanish identity numbers: the letter is the number modulo 23; X, Y, Z in front stand for 0, 1, 2."""
    for m in _DNI.finditer(text):
        if _DNI_LETTERS[int(m[1].translate(str.maketrans("XYZ", "012"))) % 23] == m[2]:
            yield m.span()


def _nirs(text):
    """French social security numbers: the last two digits are 97 less the others modulo 97."""
    for m in _NIR.finditer(text):
        if 97 - int(m[1].replace(" ", "")) % 97 == int(m[2]):
            yield m.span()


_FINDERS = dict(zip(KINDS, (_emails, _ips, _cards, _phones, _ibans, _ssns, _routings, _dnis, _nirs)))


def find(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, rank of the kind, end, score), in order: all base matches, and others of ``MIN_SCORE`` or more.

    Words of the kind within 40 signs raise the score of a confirmed match, words of order numbers, versions and
    examples lower it; matches of the kinds that are not base ones go or stay by that score.
    """
    text = text or ""
    found = []
    for rank, kind in enumerate(KINDS):
        for start, end in _FINDERS[kind](text):
            around = f"{text[max(0, start - _CONTEXT_SIGNS) : start]} {text[end : end + _CONTEXT_SIGNS]}"
            moved = _CONTEXT_GAIN * (bool(_CONTEXT[kind].search(around)) - bool(_AGAINST.search(around)))
            score = round(min(1.0, _SCORES[kind] + moved), 6)
            if kind in BASE_KINDS or score >= MIN_SCORE:
                found.append((start, rank, end, score))
    return sorted(found)


_NAMES = ("starts", "ranks", "ends", "scores")
FOUND = T.StructType(
    [T.StructField(n, T.ArrayType(T.DoubleType() if n == "scores" else T.IntegerType())) for n in _NAMES]
)


@F.pandas_udf(FOUND)
def personal_data(texts: pd.Series) -> pd.DataFrame:
    """Column: the personal data of a text as parallel arrays, in order of start and rank (see ``KINDS``).

    Places are code points. Null and empty texts have none; kinds may overlap each other.
    """
    rows = []
    for spans in map(find, texts):
        rows.append(tuple([s[i] for s in spans] for i in (0, 1, 2, 3)))
    return pd.DataFrame(rows, columns=_NAMES)
