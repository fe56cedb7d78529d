"""PII: format-preserving Feistel pseudonyms (operator 1).

Numbers that pass their check (card numbers by Luhn, IBANs by modulo 97, social
security numbers by their ranges, IPv4 addresses by octet, calendar dates) and
telephone numbers, mail addresses and named secrets by their form are replaced by
others of the same format: same length, separators and kind of character, check
digits right again. The replacement is a keyed permutation of the values of the
format, a Feistel network walked until it lands among them, so equal values have
equal pseudonyms in every document, different values have different ones, and
the holder of the key can invert it. What fails its check stays as it is.

Equal values keep their link over formats: separators don't enter, a date is its
day in every notation, the case of ASCII letters in a mail address is left where
it stands, and a telephone number has one pseudonym with and without its country
code. So that a date is read back as it was meant, days after the 12th are
permuted among themselves, which tells that much of them. What is not linked: a
telephone number written with a trunk zero, and secrets, of which case matters.

Null texts count as empty; null ids are kept. Whole texts are read, in time
linear in their values. Repeated rows give repeated results; an empty table gives
an empty one; columns other than id and text are not read.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foilframe.llm.staging import documents
from foilframe.llm.textblocks import lean

ROUNDS = 8
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALPHABETS = (_DIGITS, _LOWER, _UPPER, "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7))
_HEX_LOWER, _HEX_UPPER = _DIGITS + "abcdef", _DIGITS + "ABCDEF"
_FIRST_DAY, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


class Feistel:
    """Keyed permutations of 0..n-1 for any n; tag keeps those of different formats apart."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tag: bytes, number: int, half: int, bits: int) -> int:
        size = -(-bits // 8)
        data = tag + bytes([number]) + half.to_bytes(size, "big")
        out = b"".join(hashlib.blake2b(data + bytes([k]), key=self.key, digest_size=64).digest() for k in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def permute(self, value: int, n: int, tag: bytes, invert: bool = False) -> int:
        if n < 2:
            return value
        bits = max(1, -(-(n - 1).bit_length() // 2))
        mask = (1 << bits) - 1
        while True:
            left, right = value >> bits, value & mask
            for k in reversed(range(ROUNDS)) if invert else range(ROUNDS):
                if invert:
                    left, right = right ^ self._round(tag, k, left, bits), left
                else:
                    left, right = right, left ^ self._round(tag, k, right, bits)
            value = left << bits | right
            if value < n:
                return value

    def spell(self, text: str, tag: bytes, invert: bool = False, alphabet: str = "") -> str:
        """text with each letter or digit replaced by one of its kind; other characters stay."""
        of = [alphabet if c in alphabet else next((a for a in _ALPHABETS if c in a), "") for c in text]
        value, n = 0, 1
        for c, a in zip(text, of):
            if a:
                value, n = value * len(a) + a.index(c), n * len(a)
        shape = "".join(a[0] if a else c for c, a in zip(text, of)).encode()
        value = self.permute(value, n, tag + shape, invert)
        out = []
        for c, a in zip(reversed(text), reversed(of)):
            if a:
                value, k = divmod(value, len(a))
                c = a[k]
            out.append(c)
        return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    """The check digit that follows body."""
    total = 0
    for k, c in enumerate(reversed(body)):
        v = int(c) * (2 - k % 2)
        total += v - 9 * (v > 9)
    return str(-total % 10)


def _refill(shape: str, kept: str) -> str:
    """shape with its letters and digits replaced in order by those of kept."""
    new = iter(kept)
    return "".join(next(new) if c.isalnum() else c for c in shape)


def card(m: re.Match, f: Feistel, invert: bool) -> str | None:
    digits = re.sub(r"\D", "", m.group())
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or not int(digits):
        return None
    body = f.spell(digits[:-1], b"card", invert)
    return _refill(m.group(), body + luhn_digit(body))


_IBAN_LENGTH = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 "
        "HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 "
        "RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def iban(m: re.Match, f: Feistel, invert: bool) -> str | None:
    flat = m.group().replace(" ", "")
    country, check, body = flat[:2], flat[2:4], flat[4:]
    if not 15 <= len(flat) <= 34 or _iban_check(country, body) != check:
        return None
    own = _IBAN_LENGTH.get(country, 0)
    inner = own - 4 if own < len(flat) and own in map(_flat_length, _iban_ends(m), repeat(m)) else 0  # where one of the country's length would be seen first
    while True:
        body = f.spell(body, b"iban" + country.encode(), invert)
        check = _iban_check(country, body)
        if not inner or _iban_check(country, body[:inner]) != check:
            return _refill(m.group(), country + check + body)


def _flat_length(end: int, m: re.Match) -> int:
    return len(m.string[m.start() : end].replace(" ", ""))


def _iban_ends(m: re.Match) -> list[int]:
    """Where an IBAN that starts with m may end: at m's end or before a space in it, longest first."""
    return [m.end()] + [m.start() + k for k in range(len(m.group()) - 1, 0, -1) if m.group()[k] == " "]


def iban_tries(m: re.Match) -> Iterator[re.Match]:
    """m cut to the length of its country and then whole; for a country without a known length, to each length from the longest.

    Only in the last case may a pseudonym be read back at another end, where the
    words behind it pass the check by chance.
    """
    own = _IBAN_LENGTH.get(m.group()[:2])
    ends = _iban_ends(m)
    for end in [e for e in ends if _flat_length(e, m) == own] + ends[:1] if own else [e for e in ends if _flat_length(e, m) >= 15]:
        yield m.re.match(m.string, m.start(), end)


def ssn(m: re.Match, f: Feistel, invert: bool) -> str | None:
    area, group, serial = map(int, m.group().split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(f.permute(value, 898 * 99 * 9999, b"ssn", invert), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def ipv4(m: re.Match, f: Feistel, invert: bool) -> str | None:
    octets = m.group().split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    value = f.permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, b"ipv4", invert)
    return ".".join(map(str, value.to_bytes(4, "big")))


#: Country codes of two digits (fixed values); 1 and 7 have one digit, all others three.
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone(m: re.Match, f: Feistel, invert: bool) -> str | None:
    """All digits but the country code."""
    text = m.group()
    code = re.match(r"(?:\+\d{1,3}(?=[ .\-(]))?", text).group()
    if text[0] == "+" and not code:
        code = text[: 2 if text[1] in "17" else 3 if text[1:3] in _TWO_DIGIT_CODES else 4]
    rest = text[len(code) :]
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 14:
        return None
    return code + _refill(rest, f.spell(digits, b"phone", invert))


def date(m: re.Match, f: Feistel, invert: bool) -> str | None:
    """Dates of 1900 to 2099. Day and month in doubt: the month comes first with slashes, else the day."""
    text = m.group()
    sep = re.search(r"\D", text).group()
    parts = text.split(sep)
    if len(parts[0]) == 4:
        order = (0, 1, 2)
    else:
        order = (2, 0, 1) if sep == "/" else (2, 1, 0)
        if int(parts[order[1]]) > 12:
            order = (2, order[2], order[1])
    try:
        day = dt.date(*(int(parts[k]) for k in order))
    except ValueError:
        return None
    at = day.toordinal() - _FIRST_DAY
    if not 0 <= at < _DAYS:
        return None
    own, places = _days(day.day > 12)
    new = dt.date.fromordinal(own[f.permute(places[at], len(own), b"late" if day.day > 12 else b"early", invert)] + _FIRST_DAY)
    out = [""] * 3
    for k, value, width in zip(order, (new.year, new.month, new.day), (4, 2, 2)):
        padded = width == 4 or all(len(p) == 2 for p in parts if len(p) < 4)
        out[k] = f"{value:0{width}d}" if padded else str(value)
    return sep.join(out)


@cache
def _days(late: bool) -> tuple[list[int], dict[int, int]]:
    """The days up to the 12th of a month, or after it, and the place of each among them."""
    own = [d for d in range(_DAYS) if (dt.date.fromordinal(d + _FIRST_DAY).day > 12) == late]
    return own, {d: k for k, d in enumerate(own)}


_LOWERED = {ord(u): low for u, low in zip(_UPPER, _LOWER)}


def mail(m: re.Match, f: Feistel, invert: bool) -> str | None:
    local, domain = m.group().rsplit("@", 1)
    new = f.spell(local.translate(_LOWERED), b"mail" + domain.translate(_LOWERED).encode(), invert)
    return "".join(n.upper() if c in _UPPER else n for c, n in zip(local, new)) + "@" + domain


def secret(m: re.Match, f: Feistel, invert: bool) -> str | None:
    name, value = m.group("name"), m.group("value")
    letters = set(value)
    alphabet = _HEX_LOWER if letters <= set(_HEX_LOWER) else _HEX_UPPER if letters <= set(_HEX_UPPER) else ""
    return name + f.spell(value, b"secret", invert, alphabet)


KINDS: dict[str, tuple[str, Callable[[re.Match, Feistel, bool], str | None]]] = {
    "secret": (r"(?P<name>(?i:token|secret|passw(?:or)?d|api[_-]?key)[\"']?\s*[:=]\s*[\"']?)(?P<value>[A-Za-z0-9_+/\-]{16,})", secret),
    "mail": (r"[\w.+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+", mail),
    "iban": (r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)", iban),
    "phone": (r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w.\-])\d{3}([.\-])\d{3}\1\d{4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}(?!\w)|(?<!\w)\+(?:\d{8,15}|\d{1,3}[ .\-]\d{7,12})(?!\w)", phone),
    "card": (r"(?<![\w.])(?:\d{13,19}|\d{4}(?P<gap>[ \-])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<gap2>[ \-])\d{6}(?P=gap2)\d{5})(?!\w)", card),
    "ssn": (r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])", ssn),
    "ipv4": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)", ipv4),
    "date": (r"(?<![\w./\-])(?:\d{4}([./\-])\d{1,2}\1\d{1,2}|\d{1,2}([./\-])\d{1,2}\2\d{4})(?!(?!T\d)\w|[/\-])", date),
}
_PATTERNS = {k: re.compile(p) for k, (p, _) in KINDS.items()}


_DIGIT, _NAMED = re.compile(r"\d"), re.compile("[:=]")
#: What a text must hold for a value of the kind; a digit for those that aren't named.
_NEEDED = {"mail": re.compile("@"), "secret": _NAMED}
_MAIL_END = re.compile(r"@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
_MAIL_NAME = re.compile(r"[\w.+\-]")


def _mail_from(text: str, at: int) -> re.Match | None:
    """The first address from a place on, found from its sign backwards: every character is looked at a bounded number of times."""
    while end := _MAIL_END.search(text, at):
        start = end.start()
        while start > at and _MAIL_NAME.match(text, start - 1):
            start -= 1
        if start < end.start():
            return _PATTERNS["mail"].match(text, start, end.end())
        at = end.start() + 1
    return None


def pseudonymise(text: str, f: Feistel, kinds: tuple[str, ...] = tuple(KINDS), invert: bool = False) -> tuple[str, list[dict]]:
    """The text with its values replaced, and where they now stand. Earlier kinds win where two overlap."""
    taken: list[tuple[int, int, str, str]] = []  # in order, none overlaps another
    for kind in kinds:
        at, own = 0, []
        if not _NEEDED.get(kind, _DIGIT).search(text):
            continue
        search = _mail_from if kind == "mail" else _PATTERNS[kind].search
        while longest := search(text, at):
            at = longest.start() + 1 if kind == "iban" else longest.end()
            for m in iban_tries(longest) if kind == "iban" else (longest,):
                if _overlaps(taken, m.start(), m.end()):
                    continue
                new = KINDS[kind][1](m, f, invert)
                if new is not None:
                    own.append((m.start(), m.end(), kind, new))
                    at = m.end()
                    break
        taken = sorted(taken + own) if own else taken
    out, values, at = [], [], 0
    for s, e, kind, new in taken:
        out += [text[at:s], new]
        values.append({"kind": kind, "start": s, "value": new})
        at = e
    return "".join(out) + text[at:], values


def _overlaps(taken: list[tuple[int, int, str, str]], start: int, end: int) -> bool:
    k = bisect_left(taken, (end,))  # the first that begins at end or after it
    return k > 0 and taken[k - 1][1] > start


def pseudonymised(docs: DataFrame, key: bytes, kinds: tuple[str, ...] = tuple(KINDS), invert: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text with pseudonyms, and found: kind, start in the old text and pseudonym of each value."""
    kinds = tuple(kinds)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            done = [pseudonymise(x.as_py() or "", f, kinds, invert) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([v for _, v in done], struct)], names=[id_col, text_col, "found"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(lean(run), f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, `{text_col}` string, found array<struct<kind:string,start:int,value:string>>")


#: The setting that holds the key; without it the queries use a key that is no secret.
KEY = "spark.foilframe.pseudonymKey"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY, "corpus pseudonyms, first key").encode()
    return pseudonymised(documents(spark, sf_dir), key).selectExpr("doc_id", "text", "size(found) AS n_values", "found")
