"""Personal data under format-preserving pseudonyms.

Numbers, dates, addresses and keys that pass their validation are replaced by another value of the same
format. The replacement is a keyed permutation (a Feistel network over the values of the format, with
cycle walking), so equal values get equal pseudonyms in all documents whatever separators they are
written with, different values stay different, and whoever has the key can restore them.

| kind | validation | what is permuted |
|---|---|---|
| email | one @, a domain with a dot | letters and digits of the local part |
| iban | check digits | the account part, class by class; check digits are set anew |
| card | 13 to 19 digits with a correct check digit | all but the first and the check digit, set anew |
| phone | + and 8 to 15 digits, or 3-3-4 digits | the last digits, country code and area stay |
| ssn | 3-2-4 digits with an assigned area | the number, among the valid ones |
| ip | four numbers up to 255 | the 32-bit number |
| date | a day of the calendar from 1900 to 2099 | the day |
| secret | a long run of letters and digits behind a quote or sign, or a key with a known head | every character in its class |

Defined results: a null text stays null, an empty one empty; a value inside another is part of the
other; kinds are tried in the order of the table; a value that fails its validation stays; digits are those
of ASCII, others are text; letters of an address keep their case; repeated rows are treated alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.base import bounded, small_batches

ROUNDS = 8
_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
_HEX, _DIGIT = "0123456789abcdef", "0123456789"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Permutation:
    """Keyed permutations of 0 .. n - 1."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, half: int, m: int) -> int:
        size = (m.bit_length() + 7) // 8 + 8
        text = f"{tweak}|{i}|{half}".encode()
        return int.from_bytes(hashlib.shake_256(len(self.key).to_bytes(4, "big") + self.key + text).digest(size), "big") % m

    def apply(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """The image of x, or its origin; the network is walked until it falls inside the range."""
        if n < 2:
            return x
        m = isqrt(n - 1) + 1
        while True:
            left, right = divmod(x, m)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = (right - self._round(tweak, i, left, m)) % m, left
                else:
                    left, right = right, (left + self._round(tweak, i, right, m)) % m
            x = left * m + right
            if x < n:
                return x


def _alphabet(c: str) -> str:
    for letters in (_DIGIT, _LOWER, _UPPER):
        if c in letters:
            return letters
    return ""


def permute_characters(text: str, perm: Permutation, tweak: str, back: bool = False, hexadecimal: bool = False) -> str:
    """Permute the ASCII letters and digits, each within its class; other characters stay."""
    sets = [_HEX if hexadecimal and c in _HEX else _alphabet(c) for c in text]
    value, n = 0, 1
    for c, letters in zip(text, sets, strict=True):
        if letters:
            value, n = value * len(letters) + letters.index(c), n * len(letters)
    shape = "".join({_HEX: "h", _DIGIT: "9", _LOWER: "a", _UPPER: "A", "": "-"}[s] for s in sets).replace("-", "")
    value = perm.apply(value, n, f"{tweak}|{shape}", back)
    out = []
    for c, letters in zip(reversed(text), reversed(sets), strict=True):
        if letters:
            value, at = divmod(value, len(letters))
            c = letters[at]
        out.append(c)
    return "".join(reversed(out))


def _refill(form: str, digits: str) -> str:
    """The digits in the places that the written form has for them."""
    given = iter(digits)
    return "".join(next(given) if c in _DIGIT else c for c in form)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGIT)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(text: str, perm: Permutation, back: bool) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + permute_characters(d[1:-1], perm, f"card{d[0]}", back)
    return _refill(text, body + luhn_digit(body))


def _phone(text: str, perm: Permutation, back: bool) -> str | None:
    d = _digits(text)
    if not 8 <= len(d) <= 15:
        return None
    keep = len(d) - 7  # country and area
    # With or without the country code of the same number, the line number maps alike.
    return _refill(text, d[:keep] + permute_characters(d[keep:], perm, f"phone{d[:keep][-3:]}", back))


def _ssn(text: str, perm: Permutation, back: bool) -> str | None:
    d = _digits(text)
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    value = perm.apply(value, len(areas) * 99 * 9999, "ssn", back)
    value, serial = divmod(value, 9999)
    at, group = divmod(value, 99)
    return _refill(text, f"{areas[at]:03d}{group + 1:02d}{serial + 1:04d}")


def _ip(text: str, perm: Permutation, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if any(p > 255 for p in parts):
        return None
    value = perm.apply(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(text: str, perm: Permutation, back: bool) -> str | None:
    numbers = re.findall("[0-9]+", text)
    marks = re.findall("[^0-9]", text)
    year_first = len(numbers[0]) == 4
    year = int(numbers[0] if year_first else numbers[2])
    # With a slash the month stands before the day, as in 12/31/1999, unless that is no date.
    orders = [(1, 2)] if year_first else [(0, 1), (1, 0)] if marks[0] == "/" else [(1, 0)]
    for month, day in orders:
        try:
            at = (date(year, int(numbers[month]), int(numbers[day])) - _FIRST_DAY).days
        except ValueError:
            continue
        if not 0 <= at < _DAYS:
            return None
        # An ambiguous form keeps to days that can be read in that order only, so that it restores.
        new = at
        while True:
            new = perm.apply(new, _DAYS, "date", back)
            moved = _FIRST_DAY + timedelta(days=new)
            if (month, day) == orders[0] or moved.day > 12:
                break
        out = ["", "", ""]
        out[0 if year_first else 2] = f"{moved.year:04d}"
        out[month], out[day] = f"{moved.month:02d}", f"{moved.day:02d}"
        return out[0] + marks[0] + out[1] + marks[1] + out[2]
    return None


def _email(text: str, perm: Permutation, back: bool) -> str | None:
    local, domain = text.rsplit("@", 1)
    return f"{permute_characters(local, perm, 'email', back)}@{domain}"


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def _iban(text: str, perm: Permutation, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(body) <= 30 or _iban_check(country, body) != int(check):
        return None
    new = permute_characters(body, perm, f"iban{country}", back)
    given = iter(f"{country}{_iban_check(country, new):02d}{new}")
    return "".join(c if c == " " else next(given) for c in text)


def _secret(text: str, perm: Permutation, back: bool) -> str | None:
    head = re.match(r"AKIA|gh[pousr]_|sk-|xox[abp]-", text)
    keep = head[0] if head else ""
    body = text[len(keep) :]
    if not keep and not (any(c in _DIGIT for c in body) and any(c not in _DIGIT for c in body)):
        return None
    plain = all(c in _HEX for c in body)
    return keep + permute_characters(body, perm, "secret", back, hexadecimal=plain)


# Kind, where it may stand, and what replaces a valid one.
KINDS: list[tuple[str, re.Pattern, Callable[[str, Permutation, bool], str | None]]] = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+\-@])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9@])"), _email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("card", re.compile(r"(?<![\w.])(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{5})(?!\w)"), _card),
    ("phone", re.compile(r"(?<![0-9+])\+[0-9]{1,3}[ \-.]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ \-.]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[\-.])[0-9]{3}[\-.][0-9]{4}(?![0-9])"), _phone),
    ("ssn", re.compile(r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"), _ssn),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"), _ip),
    ("date", re.compile(r"(?<![0-9\-/.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9\-/])"), _date),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:(?<=[\"'=:])[A-Za-z0-9]{20,128}|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abp]-[A-Za-z0-9\-]{10,64})(?![A-Za-z0-9])"), _secret),
]
_ANY = re.compile(r"[0-9@]")


def pseudonymise(text: str | None, perm: Permutation, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(new text, (kind, start, end) of every value in the old text)."""
    if not text or not _ANY.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken: set[int] = set()
    for kind, pattern, replace in KINDS:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if not taken.isdisjoint(range(m.start(), m.end())):
                continue
            new = replace(m[0], perm, back)
            if new is not None:
                found.append((m.start(), m.end(), kind, new))
                taken.update(range(m.start(), m.end()))
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], [(kind, a, b) for a, b, kind, _ in found]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def pseudonyms(docs: DataFrame, key: bytes, doc_key: str = "doc_id", text: str = "text", restore: bool = False) -> DataFrame:
    """(key, text, values) of every row; ``values`` has kind, start and stop of each value in the old text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perm = Permutation(key)
        for batch in small_batches(batches, 1):
            new, spans = [], []
            for t in batch.column(1).to_pylist():
                changed, values = pseudonymise(t, perm, restore)
                new.append(changed)
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in values])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array(spans, _SPANS)], ["_key", "_text", "_values"])

    rows = bounded(docs).select(F.col(doc_key).alias("_key"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    out = rows.mapInArrow(run, f"_key {kind}, _text string, _values array<struct<kind:string,start:int,stop:int>>")
    return out.select(F.col("_key").alias(doc_key), F.col("_text").alias("text"), F.col("_values").alias("values"))
