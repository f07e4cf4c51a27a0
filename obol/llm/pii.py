"""PII pseudonyms: validated numbers and dates are permuted within their format.

A value's digits (or letters) are permuted by an unbalanced-alternating Feistel
network over its own domain, keyed and bound to the kind of value, so an equal
value gets an equal pseudonym in every document and the key owner can invert it.
Cycle walking keeps the pseudonym valid: a card number keeps its first digit,
its length and a right check digit; a date stays a date of its layout; an
address keeps four octets.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from obol.llm.common import ship
from obol.llm.textbytes import slices

ROUNDS = 10
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2100, 1, 1).toordinal() - FIRST_DAY


def _round(key: bytes, tag: bytes, i: int, value: int, modulus: int) -> int:
    digest = hashlib.blake2b(b"%b|%d|%d" % (tag, i, value), key=key, digest_size=16).digest()
    return int.from_bytes(digest, "big") % modulus


def permute(value: int, size: int, key: bytes, tag: bytes, inverse: bool = False) -> int:
    """Keyed permutation of 0..size-1: a Feistel network over a x b >= size, walked until it is back inside."""
    if size < 2:
        return value
    a = int(size ** 0.5)
    while a * a < size:
        a += 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        if not inverse:
            for i in range(ROUNDS):
                if i % 2 == 0:
                    left = (left + _round(key, tag, i, right, a)) % a
                else:
                    right = (right + _round(key, tag, i, left, b)) % b
        else:
            for i in reversed(range(ROUNDS)):
                if i % 2 == 0:
                    left = (left - _round(key, tag, i, right, a)) % a
                else:
                    right = (right - _round(key, tag, i, left, b)) % b
        value = left * b + right
        if value < size:
            return value


def _digits(text: str, key: bytes, tag: bytes, inverse: bool) -> str:
    return str(permute(int(text), 10 ** len(text), key, tag + b"%d" % len(text), inverse)).zfill(len(text))


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _luhn_end(body: str) -> str:
    return next(d for d in "0123456789" if luhn_ok(body + d))


def _layout(old: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``old``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in old)


def _card(text: str, key: bytes, inverse: bool) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or not luhn_ok(d) or len(set(d)) == 1:
        return None
    body = d[0] + _digits(d[1:-1], key, b"card" + d[:1].encode(), inverse)
    return _layout(text, body + _luhn_end(body))


def _iban_value(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def _iban(text: str, key: bytes, inverse: bool) -> str | None:
    """Digits of the account are permuted, letters stay; check digits are computed anew."""
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_value(plain) != 1:
        return None
    digits = "".join(c for c in plain[4:] if c.isdigit())
    if not digits:
        return None
    body = _layout(plain[4:], _digits(digits, key, b"iban" + plain[:2].encode(), inverse))
    new = plain[:2] + f"{98 - _iban_value(plain[:2] + '00' + body):02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def _ssn(text: str, key: bytes, inverse: bool) -> str | None:
    a, b, c = int(text[:3]), int(text[4:6]), int(text[7:])
    if not (a and a != 666 and a < 900 and b and c):
        return None
    areas = a - 1 - (a > 666)
    v = permute((areas * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, key, b"ssn", inverse)
    v, c = divmod(v, 9999)
    areas, b = divmod(v, 99)
    return f"{areas + 1 + (areas >= 665):03d}{text[3]}{b + 1:02d}{text[6]}{c + 1:04d}"


def _phone(text: str, key: bytes, inverse: bool) -> str | None:
    """Area code and the seven digits after it; a 555 exchange stays.

    Numbers whose area code and exchange start with 2-9 are permuted among
    themselves, all others among themselves (own tags), so that each stays of
    its sort and can be inverted.
    """
    d = re.sub(r"\D", "", text)
    lead, d = d[:-10], d[-10:]
    if len(d) != 10 or lead not in ("", "1"):
        return None
    area, exchange, line = int(d[:3]), int(d[3:6]), int(d[6:])
    regular = area >= 200 and exchange >= 200
    if exchange == 555:
        low, areas, tag = (200, 800, b"phone555") if regular else (0, 200, b"phone555low")
        v = permute((area - low) * 10_000 + line, areas * 10_000, key, tag, inverse)
        area, line = v // 10_000 + low, v % 10_000
        return _layout(text, f"{lead}{area:03d}555{line:04d}")
    low, codes, tag = (200, 800, b"phone") if regular else (0, 1000, b"phonelow")
    while True:  # walk on until the number is of the same sort, and not a 555 one
        v = permute(((area - low) * codes + exchange - low) * 10_000 + line, codes * codes * 10_000, key, tag, inverse)
        v, line = divmod(v, 10_000)
        area, exchange = v // codes + low, v % codes + low
        if exchange != 555 and (area >= 200 and exchange >= 200) == regular:
            return _layout(text, f"{lead}{area:03d}{exchange:03d}{line:04d}")


def _ip(text: str, key: bytes, inverse: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    v = 0
    for p in parts:
        v = v * 256 + int(p)
    v = permute(v, 1 << 32, key, b"ip", inverse)
    return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))


_DATE_LAYOUTS = ("ymd", "dmy", "mdy")


def _date(text: str, key: bytes, inverse: bool) -> str | None:
    """A real day of 1900-2099; day first where both readings are real.  Single
    digits without a leading zero stay so; a date that mixes both is written with zeros."""
    sep = re.search(r"[-/.]", text)[0]
    p = text.split(sep)
    if len(p) != 3:
        return None
    for layout in (_DATE_LAYOUTS[:1] if len(p[0]) == 4 else _DATE_LAYOUTS[1:]):
        part = dict(zip(layout, p, strict=True))
        try:
            day = dt.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < DAYS:
            return None
        padded = any(len(part[k]) == 2 and part[k][0] == "0" for k in "md") or len(part["d"]) == len(part["m"]) == 2
        tag = b"date" + layout.encode() + b"0" * padded
        while True:  # walk on until the new text is read back in the same way
            day = permute(day, DAYS, key, tag, inverse)
            new = dt.date.fromordinal(day + FIRST_DAY)
            if (layout != "mdy" or new.day > 12) and (padded or new.day < 10 or new.month < 10):
                break
        fmt = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded else str(new.month), "d": f"{new.day:02d}" if padded else str(new.day)}
        return sep.join(fmt[k] for k in layout)
    return None


_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _email(text: str, key: bytes, inverse: bool) -> str:
    """Letters and digits of the local part are permuted as one number of their own pattern; the host stays."""
    local, _, host = text.rpartition("@")
    value, size = 0, 1
    for c in local:
        r = 10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1
        value, size = value * r + (ord(c) - 48 if r == 10 else _LOWER.index(c.lower()) if r == 26 else 0), size * r
    pattern = re.sub(r"[0-9]", "0", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", local)))
    value = permute(value, size, key, b"mail" + pattern.encode() + b"@" + host.lower().encode(), inverse)
    out = []
    for c in reversed(local):
        r = 10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1
        value, d = divmod(value, r)
        out.append(str(d) if r == 10 else (_LOWER[d].upper() if c.isupper() else _LOWER[d]) if r == 26 else c)
    return "".join(reversed(out)) + "@" + host


#: kind, pattern, pseudonym function; at one place the first kind that validates wins.
KINDS: list[tuple[str, str, Callable[[str, bytes, bool], str | None]]] = [
    # from the head of a run of local characters, so that each run is tried once
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)", _ip),
    ("date", r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)", _date),
    ("ssn", r"(?<![\d-])\d{3}([- ])\d{2}\1\d{4}(?![\d-])", _ssn),
    ("phone", r"(?<![\d.+-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|-\d)", _phone),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])", _card),
]
_COMPILED = [(k, re.compile(p), f) for k, p, f in KINDS]


@functools.lru_cache(maxsize=100_000)
def pseudonym(kind: int, text: str, key: bytes, inverse: bool = False) -> str | None:
    return KINDS[kind][2](text, key, inverse)


_SEED = re.compile(rb"@|[0-9]")


def replace(text: str, key: bytes, inverse: bool = False) -> tuple[str, dict[str, int]]:
    """``text`` with pseudonyms, and the number of values of each kind."""
    found: list[tuple[int, int, str]] = []
    counts: dict[str, int] = {}
    for k, (name, pattern, _) in enumerate(_COMPILED):
        if k == 0 and "@" not in text:
            continue
        fresh, at = [], 0
        for m in pattern.finditer(text):
            # both run through the text in order: skip what ends before this match
            while at < len(found) and found[at][1] <= m.start():
                at += 1
            if at < len(found) and found[at][0] < m.end():
                continue
            new = pseudonym(k, m[0], key, inverse)
            if new is not None:
                fresh.append((m.start(), m.end(), new))
        if fresh:
            counts[name] = len(fresh)
            found = sorted(found + fresh)
    if not found:
        return text, counts
    out, at = [], 0
    for s, e, new in found:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), counts


def pseudonymise(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """All columns of ``docs`` with pseudonyms in ``text``, and ``pii`` (kind -> number of values).

    Null text stays null with no values; empty and clean texts are unchanged;
    repeated rows get equal pseudonyms; no row is added or lost; a column
    already named ``pii`` is replaced.
    """
    ship(docs.sparkSession)
    cols = [c for c in docs.columns if c != "pii"]
    frame = docs.select(*cols).withColumn("text", F.col("text").cast("string"))
    schema = StructType(frame.schema.fields + StructType.fromDDL("pii map<string,long>").fields)
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            out, counts = [], []
            for raw, null in zip(texts, part.column(at).is_null().to_pylist(), strict=True):
                if null or not _SEED.search(raw):
                    out.append(None if null else raw)
                    counts.append({})
                    continue
                new, n = replace(raw.decode(), key, inverse)
                out.append(new.encode())
                counts.append(n)
            columns = list(part.columns)
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int64()))],
                                             names=[*part.schema.names, "pii"])
    return frame.mapInArrow(run, schema)
