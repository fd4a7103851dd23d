"""Format-preserving pseudonyms for personal data and secrets.

Each find is validated (card numbers by their check digit, addresses by their ranges, dates by the calendar, account numbers by their
remainder) and keyed-permuted within its own format by a Feistel network with cycle walking: digits stay digits, letters stay letters of
their case, dates stay dates with as many digits in each place, check digits stay right. Equal values of a kind get equal pseudonyms in every document, and a key's holder can
invert them.

Defined cases: a null text stays null and an empty one empty; of overlapping finds the first kind in the list of KINDS wins; a number that
fails its validation is left as it is (of an account number and the words behind it, the longest valid run of groups counts); the pseudonym
of a value never equals it unless its format has a single value; rows may repeat; very long texts with very many finds take time in
proportion; other columns pass through, but one with the name given for spans gives way to it.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, text_array

KEY = b"nearwell pseudonyms"  # a parameter: give a secret one to publish texts
ROUNDS = 8
PIECE = 128  # letters and digits that are permuted at once: a half of them fits into one hash
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def permute(x: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of 0 .. size-1 as one cycle, hence without fixed points: the successor in an order that a Feistel network gives.

    The network works on two digits of base about sqrt(size).
    """
    if size < 2:
        return x
    m = math.isqrt(size - 1) + 1
    width = (m.bit_length() + 7) // 8 + 8

    def f(r: int, half: int) -> int:
        d = hashlib.blake2b(b"%d:%d:" % (r, half) + size.to_bytes(-(-size.bit_length() // 8), "big") + tweak, key=key[:64], digest_size=min(64, width)).digest()
        return int.from_bytes(d, "big") % m

    def once(v: int, back: bool) -> int:
        a, b = divmod(v, m)
        for r in range(ROUNDS):
            if back:
                a, b = (b - f(ROUNDS - 1 - r, a)) % m, a
            else:
                a, b = b, (a + f(r, b)) % m
        return a * m + b

    def place(v: int, back: bool) -> int:
        v = once(v, back)
        while v >= size:
            v = once(v, back)
        return v

    return place((place(x, False) + (-1 if inverse else 1)) % size, True)


def _radices(text: str, hexadecimal: bool) -> list[str]:
    if hexadecimal:
        return ["0123456789abcdef" if c in "0123456789abcdef" else "" for c in text]
    return [_DIGIT if c in _DIGIT else _LOWER if c in _LOWER else _UPPER if c in _UPPER else "" for c in text]


def shape(text: str, key: bytes, tweak: bytes, hexadecimal: bool = False, inverse: bool = False) -> str:
    """text with its digits and ASCII letters permuted together, each within its class; the rest stays.

    More than PIECE of them are permuted in pieces of about equal numbers, each under a hash of what stands before it in the plain text, so
    that time grows with the length; texts that begin alike may get pseudonyms that begin alike.
    """
    alphabets = _radices(text, hexadecimal)
    places = [i for i, a in enumerate(alphabets) if a]
    many = -(-len(places) // PIECE)
    if many < 2:
        return _shape(text, alphabets, key, tweak, inverse)
    cuts = [0, *(places[len(places) * k // many] for k in range(1, many)), len(text)]
    out, before = [], hashlib.blake2b(b"%d|" % len(text) + tweak, key=key[:64], digest_size=16)
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = _shape(text[a:b], alphabets[a:b], key, tweak + b"|" + before.digest(), inverse)
        before.update((piece if inverse else text[a:b]).encode("utf-8", "surrogatepass"))
        out.append(piece)
    return "".join(out)


def _shape(text: str, alphabets: list[str], key: bytes, tweak: bytes, inverse: bool) -> str:
    x, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    y = permute(x, size, key, tweak + b"|" + "".join(a[0] if a else c for c, a in zip(text, alphabets, strict=True)).encode(), inverse)
    out = []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            y, k = divmod(y, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(t: str, key: bytes) -> str | None:
    digits = re.sub(r"[ -]", "", t)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = shape(digits[:-1], key, b"card")
    new = iter(body + luhn_digit(body))
    return "".join(next(new) if c.isdigit() else c for c in t)


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country) + "00"
    return f"{98 - int(number) % 97:02d}"


def _iban(t: str, key: bytes) -> str | None:
    plain = t.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    body = shape(plain[4:], key, b"iban|" + plain[:2].encode())
    new = iter(plain[:2] + _iban_check(plain[:2], body) + body)
    return "".join(c if c == " " else next(new) for c in t)


def _ipv4(t: str, key: bytes) -> str | None:
    parts = [int(p) for p in t.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in t.split(".")):
        return None
    v = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ipv4")
    return ".".join(map(str, v.to_bytes(4, "big")))


def _date(t: str, key: bytes) -> str | None:
    a, sep, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", t).groups()
    year, month, day = (a, b, c) if len(a) == 4 else (c, b, a)
    swapped = False
    try:
        when = datetime.date(int(year), int(month), int(day))
    except ValueError:
        try:
            when, swapped = datetime.date(int(year), int(day), int(month)), True
        except ValueError:
            return None
    n = (when - _FIRST_DAY).days
    if not 0 <= n < _DAYS:
        return None
    long_month, long_day = (len(day), len(month)) if swapped else (len(month), len(day))
    while True:  # walk on to a date with as many digits in each place
        n = permute(n, _DAYS, key, b"date")
        new = _FIRST_DAY + datetime.timedelta(n)
        if (long_month == 2 or new.month < 10) and (long_day == 2 or new.day < 10):
            break
    y, m, d = f"{new.year:04d}", f"{new.month:0{long_month}d}", f"{new.day:0{long_day}d}"
    if swapped:
        m, d = d, m
    return sep.join((y, m, d) if len(a) == 4 else (d, m, y))


def _phone(t: str, key: bytes) -> str | None:
    if not 9 <= sum(c.isdigit() for c in t) <= 15:
        return None
    country, rest = re.match(r"(\+\d{1,3}(?=[ (.-])|\+|)(.*)", t, re.S).groups()
    return country + shape(rest, key, b"phone|" + country.encode())


def _ssn(t: str, key: bytes) -> str | None:
    area, group, serial = t.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    n = ((int(area) - 1) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    while True:  # walk on over the areas that aren't given out
        n = permute(n, 899 * 99 * 9999, key, b"ssn")
        a = n // (99 * 9999) + 1
        if a != 666:
            return f"{a:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


def _email(t: str, key: bytes) -> str | None:
    local, _, domain = t.rpartition("@")
    host, _, top = domain.rpartition(".")
    return shape(local, key, b"local") + "@" + shape(host, key, b"host") + "." + top


def _cloud_key(t: str, key: bytes) -> str | None:
    # 36 signs in 16 places
    signs = _DIGIT + _UPPER
    x = 0
    for c in t[4:]:
        x = x * 36 + signs.index(c)
    x = permute(x, 36 ** len(t[4:]), key, b"cloud")
    out = ""
    for _ in t[4:]:
        x, k = divmod(x, 36)
        out = signs[k] + out
    return t[:4] + out


def _secret(t: str, key: bytes) -> str | None:
    return shape(t, key, b"secret", hexadecimal=bool(re.fullmatch(r"[0-9a-f]+", t)))


#: (kind, pattern whose group v is the value, permutation within the format), in order of precedence.
KINDS: list[tuple[str, re.Pattern, Callable[[str, bytes], str | None]]] = [
    ("email", re.compile(r"(?P<v>[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})(?![A-Za-z0-9])"), _email),
    ("secret", re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<v>(?-i:[A-Za-z0-9+/_.-]{8,}))"), _secret),
    ("cloud_key", re.compile(r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])"), _cloud_key),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?P<v>(?:ghp|gho|ghs|sk|pk|xoxb|xoxp)[_-][A-Za-z0-9_-]{16,})(?![A-Za-z0-9])"), _secret),
    ("iban", re.compile(r"(?<![A-Za-z0-9])(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])"), _iban),
    ("card", re.compile(r"(?<![\d.-])(?P<v>\d{13,19}|\d{4}(?:([ -])\d{4})(?:\2\d{4}){2}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\d-])"), _card),
    ("ssn", re.compile(r"(?<![\d-])(?P<v>\d{3}-\d{2}-\d{4})(?![\d-])"), _ssn),
    ("ipv4", re.compile(r"(?<![\d.])(?P<v>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)"), _ipv4),
    ("date", re.compile(r"(?<![\d./-])(?P<v>\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})(?![\d/-]|\.\d)"), _date),
    ("phone", re.compile(r"(?<![\d+])(?P<v>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"), _phone),
]
NAMES = list(dict.fromkeys(k for k, _, _ in KINDS))
#: Without one of these signs or words a text holds none of the kinds.
_HINT = r"[0-9@]|(?i:password|passwd|pwd|secret|token|key)|AKIA|ASIA|ghp|gho|ghs|sk[_-]|pk[_-]|xox"


def pseudonymise(text: str, key: bytes = KEY) -> tuple[str, list[tuple[int, int, str]]]:
    """(the text with pseudonyms, spans (start, end, kind) in the given text)."""
    spans: list[tuple[int, int, str, str]] = []  # in order and apart
    starts: list[int] = []
    for kind, pattern, within in KINDS:
        at = 0
        while m := pattern.search(text, at):
            (a, b), at = m.span("v"), m.end()
            # words behind an account number look like its groups: shorter ones are tried, and what begins within
            ends = [b, *(i for i in range(b - 1, a, -1) if text[i] == " ")] if kind == "iban" else [b]
            for end in ends:
                i = bisect.bisect_right(starts, a)
                if i and spans[i - 1][1] > a or i < len(starts) and starts[i] < end:
                    continue
                new = within(text[a:end], key)
                if new is not None:
                    starts.insert(i, a)
                    spans.insert(i, (a, end, kind, new))
                    at = end
                    break
            else:
                if kind == "iban":
                    at = a + 1
    out, at = [], 0
    for a, b, _, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(a, b, k) for a, b, k, _ in spans]


def protect(docs: DataFrame, text: str = "text", key: bytes = KEY, spans: str | None = None) -> DataFrame:
    """docs with pseudonyms in text; spans names a column for what was found: array of (start, end, kind), null for a null text."""
    found = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    if spans:
        docs = docs.drop(spans)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *([T.StructField(spans, found)] if spans else [])])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            some = pc.match_substring_regex(text_array(column), _HINT).to_pylist()
            texts, where = column.to_pylist(), []
            for i, t in enumerate(texts):
                hits = []
                if some[i]:
                    texts[i], hits = pseudonymise(t, key)
                where.append(None if t is None else [{"start": a, "end": b, "kind": k} for a, b, k in hits])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, column.type)
            if spans:
                columns.append(pa.array(where, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *([spans] if spans else [])])

    return docs.mapInArrow(released(run), schema)


def protected(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with pseudonyms, n_found and a count per kind for every row of docs."""
    out = protect(docs.select("doc_id", "text"), key=key, spans="spans")

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).alias(f"n_{kind}")

    counts = [of(kind) for kind in NAMES]
    return out.withColumn("spans", F.coalesce("spans", F.array())).select("doc_id", "text", F.size("spans").alias("n_found"), *counts)
