"""Format-preserving pseudonyms: each validated value is permuted by key within the values of its own format.

A format is a set of values that can be counted (16 digits with a right check digit, days of a calendar, four
octets, letters and digits of an address). A value's number is sent through a keyed Feistel network over exactly that
count, and the new number is written in the same form. Equal values stay equal in every document, unequal
ones stay unequal, and nothing has to be stored or shuffled.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckloom.llm.common import private, slices

ROUNDS = 8
REMEMBERED = 100_000
#: Characters permuted as one number.
BLOCK = 256
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _digest(message: str, key: bytes, size: int) -> bytes:
    """``size`` keyed bytes; more than one digest holds come from numbered ones."""
    if size <= 64:
        return hashlib.blake2b(message.encode(), key=key, digest_size=size).digest()
    return b"".join(hashlib.blake2b(f"{message}|{i}".encode(), key=key, digest_size=64).digest() for i in range(-(-size // 64)))[:size]


def permute(number: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): Feistel rounds over a x b >= size, walked until back inside."""
    if size < 2:
        return number
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(number, b)
        p, q = a, b
        for r in range(ROUNDS):
            digest = _digest(f"{tweak}|{size}|{r}|{right}", key, 32 + (p.bit_length() // 8))
            left, right, p, q = right, (left + int.from_bytes(digest, "big")) % p, q, p
        number = left * q + right
        if number < size:
            return number


def _alphabet(c: str) -> str:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else ""


def written(value: str, key: bytes, tweak: str, alphabet: Callable[[str], str] = _alphabet) -> str:
    """Every letter and digit changes within its own alphabet; other characters stay.

    A long value is permuted in blocks, forwards and then backwards, each under a tweak of the blocks before it. So every block
    depends on all others, each step can be undone, and the work grows with the length.
    """
    if len(value) <= BLOCK:
        return _written(value, key, tweak, alphabet)
    blocks = [value[i : i + BLOCK] for i in range(0, len(value), BLOCK)]
    for way in ("forth", "back"):
        seen = b""
        for i in range(len(blocks)):
            blocks[i] = _written(blocks[i], key, f"{tweak}|{way}|{seen.hex()}", alphabet)
            seen = _digest(seen.hex() + blocks[i], key, 32)
        blocks.reverse()
    return "".join(blocks)


def _written(value: str, key: bytes, tweak: str, alphabet: Callable[[str], str]) -> str:
    number, size = 0, 1
    for c in value:
        if letters := alphabet(c):
            number = number * len(letters) + letters.index(c)
            size *= len(letters)
    number = permute(number, size, key, tweak)
    out = []
    for c in reversed(value):
        if letters := alphabet(c):
            number, k = divmod(number, len(letters))
            c = letters[k]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """Sum whose last digit is 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _number(value: str, key: bytes) -> str | None:
    """9 to 19 digits with spaces or hyphens. A right check digit stays right; other long numbers have none to keep."""
    digits = re.sub(r"\D", "", value)
    if not 9 <= len(digits) <= 19:
        return None
    valid = len(digits) >= 13 and luhn(digits) == 0
    if valid:
        new = written(digits[:-1], key, "card")
        new += str(-luhn(new + "0") % 10)
    else:
        new = written(digits, key, "number")
    left = iter(new)
    return "".join(next(left) if c in DIGITS else c for c in value)


def _checked_number(value: str, key: bytes) -> str | None:
    """13 to 19 digits with a right check digit, which stays right. Shorter numbers have no check digit and stay."""
    digits = re.sub(r"\D", "", value)
    return _number(value, key) if 13 <= len(digits) <= 19 and luhn(digits) == 0 else None


def _phone(value: str, key: bytes) -> str | None:
    """A country code (kept) or an area code in brackets, 9 to 15 digits in all."""
    if not 9 <= sum(c in DIGITS for c in value) <= 15:
        return None
    code = re.match(r"\+\d{1,3}(?=\D)|\+\d", value)
    head = code[0] if code else ""
    return head + written(value[len(head) :], key, "phone")


def _ssn(value: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in re.split(r"[- ]", value))
    areas = [a for a in range(1, 900) if a != 666]
    if not (1 <= area < 900 and area != 666 and group and serial):
        return None
    n = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, "ssn")
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    return f"{areas[area]:03}{value[3]}{group + 1:02}{value[6]}{serial + 1:04}"


def _address(value: str, key: bytes) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    n = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _email(value: str, key: bytes) -> str:
    """All but the last label of the domain changes."""
    head, dot, last = value.rpartition(".")
    return written(head, key, "email") + dot + last


def _iban(value: str, key: bytes) -> str | None:
    plain = value.replace(" ", "")
    check = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    if not 15 <= len(plain) <= 34 or check(plain) != 1:
        return None
    body = written(plain[4:], key, "iban")
    new = f"{plain[:2]}{98 - check(plain[:2] + '00' + body):02}{body}"
    left = iter(new)
    return "".join(next(left) if c != " " else c for c in value)


def _date(value: str, key: bytes) -> str | None:
    """Year first, or day first, or else month first; days of 1900 to 2099 that exist."""
    parts = re.split(r"([-/.])", value)
    a, b, c = int(parts[0]), int(parts[2]), int(parts[4])
    for order in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
        try:
            got = dict(zip(order, (a, b, c)))
            day = datetime.date(got["y"], got["m"], got["d"]).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # of the dates that a day-first reader takes the same way, so that the new value reads back uniquely
        n = permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date")
        new = datetime.date.fromordinal(FIRST_DAY + n)
        while order == "mdy" and new.day <= 12:
            n = permute(n, LAST_DAY - FIRST_DAY + 1, key, "date")
            new = datetime.date.fromordinal(FIRST_DAY + n)
        field = {"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}
        return parts[1].join(field[x] for x in order)
    return None


def _hex(value: str, key: bytes) -> str | None:
    """Keys and digests: 32 hex digits or more, of both kinds, in one case."""
    if not (re.search(r"\d", value) and re.search(r"[A-Fa-f]", value)) or value not in (value.lower(), value.upper()):
        return None
    new = written(value.lower(), key, "hex", lambda c: HEX)
    return new if value == value.lower() else new.upper()


#: Kinds in the order in which they claim text.
KINDS: list[tuple[str, re.Pattern, Callable[[str, bytes], str | None]]] = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9])"), _email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("secret", re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}(?![A-Za-z0-9])"), _hex),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), lambda v, k: v[:4] + written(v[4:], k, "key")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}(?![A-Za-z0-9])"), lambda v, k: v[:3] + written(v[3:], k, "key")),
    ("ssn", re.compile(r"(?<![\d.-])\d{3}[- ]\d{2}[- ]\d{4}(?![\d-])"), _ssn),
    ("date", re.compile(r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?!\d|[-/.]\d)"), _date),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"), _address),
    ("number", re.compile(r"(?<![A-Za-z0-9.+])\d{4}(?:[ -]\d{4}){2}(?:[ -]\d{1,7})?(?![A-Za-z0-9])"), _number),
    ("number", re.compile(r"(?<![A-Za-z0-9.+])\d{4}[ -]\d{6}[ -]\d{5}(?![A-Za-z0-9])"), _number),
    ("number", re.compile(r"(?<![A-Za-z0-9.+])\d{13,19}(?![A-Za-z0-9])"), _number),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?|\(\d{2,4}\)[ .-]?)\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"), _phone),
    ("phone", re.compile(r"(?<![\w.+-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![\d-])"), _phone),
    ("number", re.compile(r"(?<![A-Za-z0-9.+])\d{9,12}(?![A-Za-z0-9])"), _number),
]
_ANY = re.compile(r"[\d@]")


class Pseudonyms:
    """``checked``: only numbers with a right check digit change; otherwise every number of 9 to 19 digits does."""

    def __init__(self, key: bytes, checked: bool = False):
        self.key, self.checked, self.known = key, checked, {}

    def __call__(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The new text, and (start, end, kind) of each value in the old one."""
        if not _ANY.search(text):
            return text, []
        found: list[tuple[int, int, str, str]] = []
        left = text  # what is taken is blotted out for the kinds that follow
        for kind, pattern, change in KINDS:
            taken, at = len(found), 0
            numbers = self.checked and change is _number
            change = _checked_number if numbers else change
            while m := pattern.search(left, at):
                a, b = m.span()
                value, at = m[0], b
                if (kind, value) not in self.known:
                    if len(self.known) > REMEMBERED:
                        self.known.clear()
                    self.known[kind, value] = change(value, self.key)
                if (new := self.known[kind, value]) is not None:
                    found.append((a, b, kind, new))
                elif numbers:
                    at = a + 1  # a valid number may begin at a later group of digits
            for a, b, *_ in found[taken:]:
                left = f"{left[:a]}{chr(0) * (b - a)}{left[b:]}"
        if not found:
            return text, []
        found.sort()
        out, at = [], 0
        for a, b, _, new in found:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), [(a, b, k) for a, b, k, _ in found]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str | None = "pii_spans") -> DataFrame:
    """All columns, ``text`` with its values replaced, and ``spans`` (array of start, end, kind in the old text) if named.

    A column that is named like ``spans`` is replaced. Null texts stay null with no spans; values that fail their check (a wrong check digit, an impossible day, an octet of 300) stay.
    ``key`` is the caller's secret of 1 to 64 bytes; the same key gives the same pseudonyms in every run. No shuffle.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("the key needs 1 to 64 bytes")
    name = private("__spans", docs.columns)
    found = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, found)])
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Pseudonyms(key, checked=True)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for part in slices(batches, text):
            got = [(None, []) if t is None else change(t) for t in part.column(text).to_pylist()]
            arrays = [part.column(i) for i in range(part.num_columns)]
            arrays[where] = pa.array([g[0] for g in got], pa.string())
            arrays.append(pa.array([[dict(zip(("start", "end", "kind"), s)) for s in g[1]] for g in got], kind))
            yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, name])

    out = docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, schema)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != spans]
    return out.select(*kept, F.col(name).alias(spans)) if spans else out.select(*docs.columns)
