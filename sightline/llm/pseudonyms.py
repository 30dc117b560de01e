"""PII: format-preserving pseudonyms from a keyed Feistel permutation.

A value that passes its format's own test (Luhn, mod 97, calendar, octet and dial-plan
ranges) is numbered within the set of valid values of its shape; the number is permuted
by a Feistel network keyed by a secret and by the shape, walking on until it falls in
the set; and the result is written in the same shape.  The permutation depends on the
key alone, so equal values stay equal across documents and workers, different values
stay different, and with the key they can be restored.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

ROUNDS = 10
#: For tests and measurements; a deployment hands in its own secret.
DEMO_KEY = b"sightline demonstration key"
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")


class Feistel:
    """A keyed permutation of 0..n-1 over two unequal halves, with cycle walking."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.a = n, max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = -(-n // self.a)
        self.base = hashlib.blake2b(tweak.encode(), key=hashlib.blake2b(key).digest(), digest_size=24)

    def _f(self, k: int, half: int) -> int:
        h = self.base.copy()
        h.update(b"%d,%d" % (k, half))
        return int.from_bytes(h.digest(), "big")

    def forward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for k in range(0, ROUNDS, 2):
                left = (left + self._f(k, right)) % self.a
                right = (right + self._f(k + 1, left)) % self.b
            x = left * self.b + right
            if x < self.n:
                return x

    def backward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for k in range(ROUNDS - 2, -1, -2):
                right = (right - self._f(k + 1, left)) % self.b
                left = (left - self._f(k, right)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` + it valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 - k % 2)
        total += v - 9 * (v > 9)
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _rank(text: str) -> tuple[int, int]:
    """Letters and digits of a text as one mixed-radix number, and how many there are."""
    x, n = 0, 1
    for c in text:
        size, zero = (10, "0") if c.isdigit() else (26, "A" if c.isupper() else "a") if c.isalpha() else (1, c)
        x, n = x * size + ord(c) - ord(zero), n * size
    return x, n


def _unrank(x: int, like: str) -> str:
    out = []
    for c in reversed(like):
        size, zero = (10, "0") if c.isdigit() else (26, "A" if c.isupper() else "a") if c.isalpha() else (1, c)
        x, d = divmod(x, size)
        out.append(chr(ord(zero) + d))
    return "".join(reversed(out))


def _fill(digits: str, like: str) -> str:
    """``digits`` in place of the digits of ``like``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in like)


# Patterns; a value must also pass the test of its kind in ``Pseudonyms``.
NUMBERS = re.compile(
    r"""(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?P<s1>[./])\d{1,2}(?P=s1)\d{4})(?![\w/-]|\.\d))
    |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<phone>(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-]))
    |(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}(?P<s2>[ -])\d{4}(?P=s2)\d{4}(?P=s2)\d{4}|\d{4}(?P<s3>[ -])\d{6}(?P=s3)\d{5})(?![\w-]|\.\d))
    |(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?:[ ][A-Z0-9]{4}){2,7}(?:[ ][A-Z0-9]{1,3})?)(?!\w))""",
    re.A | re.X,
)
MAILS = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.A)
_ANY_NUMBER = re.compile(r"\d[\d .()/-]*\d", re.A)


class Pseudonyms:
    """Replacements under one key; ``restore`` undoes them."""

    def __init__(self, key: bytes, restore: bool = False):
        self.key, self.restore = key, restore
        self.value = lru_cache(100_000)(self._value)
        self.network = lru_cache(4096)(lambda tweak, n: Feistel(key, tweak, n))

    def permuted(self, tweak: str, n: int, x: int) -> int:
        f = self.network(tweak, n)
        return f.backward(x) if self.restore else f.forward(x)

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None where the text isn't a valid value of its kind."""
        digits = "".join(c for c in text if c.isdigit())
        if kind == "card":
            if digits[0] == "0" or luhn(digits[:-1]) != int(digits[-1]):
                return None
            n = len(digits) - 2  # the first digit names the network and stays
            body = digits[0] + f"{self.permuted(f'card{n}{digits[0]}', 10**n, int(digits[1:-1])):0{n}d}"
            return _fill(body + str(luhn(body)), text)
        if kind == "iban":
            plain = text.replace(" ", "")
            if iban_check(plain[:2], plain[4:]) != plain[2:4]:
                return None
            x, n = _rank(plain[4:])
            shape = re.sub("[A-Z]", "A", re.sub(r"\d", "0", plain[4:]))
            rest = _unrank(self.permuted(f"iban{plain[:2]}{shape}", n, x), plain[4:])
            new = iter(plain[:2] + iban_check(plain[:2], rest) + rest)
            return "".join(c if c == " " else next(new) for c in text)
        if kind == "ssn":
            area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
            x, serial = divmod(self.permuted("ssn", 898 * 99 * 9999, x), 9999)
            area, group = divmod(x, 99)
            return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "phone":
            head, body = digits[:-10], digits[-10:]
            if body[0] in "01" or body[3] in "01":
                return None
            x = (int(body[:3]) - 200) * 8_000_000 + int(body[3:]) - 2_000_000
            area, rest = divmod(self.permuted("phone", 800 * 8_000_000, x), 8_000_000)
            return _fill(f"{head}{area + 200:03d}{rest + 2_000_000:07d}", text)
        if kind == "ip":
            parts = text.split(".")
            if any(int(p) > 255 or str(int(p)) != p for p in parts):
                return None
            x = self.permuted("ip", 1 << 32, sum(int(p) << 8 * (3 - k) for k, p in enumerate(parts)))
            return ".".join(str(x >> 8 * k & 255) for k in (3, 2, 1, 0))
        if kind == "date":
            return self._date(text)
        x, n = _rank(text.split("@")[0])
        local, domain = text.split("@")
        shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", local)))
        return f"{_unrank(self.permuted(f'email{shape}', n, x), local)}@{domain}"

    def _date(self, text: str) -> str | None:
        parts = re.split(r"[-./]", text)
        sep = text[len(parts[0])]
        y, m, d = (int(p) for p in (parts if sep == "-" else (parts[2], parts[1], parts[0])))
        month_first = sep == "/" and m > 12  # else the day leads, as it does with points
        if month_first:
            m, d = d, m
        try:
            x = dt.date(y, m, d).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= x <= LAST_DAY - FIRST_DAY:
            return None
        wide = [len(p) for p in parts]
        tweak, n = "date", LAST_DAY - FIRST_DAY + 1
        # Walk on to a date that reads the same way: same order of parts, same widths.
        while True:
            x = self.permuted(tweak, n, x)
            new = dt.date.fromordinal(x + FIRST_DAY)
            if sep == "-":
                return new.isoformat()
            first, second = (new.month, new.day) if month_first else (new.day, new.month)
            made = f"{first:0{wide[0]}d}{sep}{second:0{wide[1]}d}{sep}{new.year}"
            same_order = (sep == "/" and second > 12) == month_first
            if same_order and [len(p) for p in re.split(r"[./]", made)] == wide:
                return made

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        found: dict[str, int] = {}
        if "@" in text:
            text = MAILS.sub(lambda m: self._mail(m, found), text)
        if _ANY_NUMBER.search(text):
            text = NUMBERS.sub(swap_named(self, found), text)
        return text, found

    def _mail(self, m: re.Match, found: dict[str, int]) -> str:
        found["email"] = found.get("email", 0) + 1
        return self.value("email", m.group(0))


def swap_named(names: Pseudonyms, found: dict[str, int]):
    def swap(m: re.Match) -> str:
        kind = next(k for k in KINDS if k != "email" and m.group(k) is not None)
        new = names.value(kind, m.group(kind))
        if new is None:
            return m.group(0)
        found[kind] = found.get(kind, 0) + 1
        return new

    return swap


_NAMES: dict = {}


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text", restore: bool = False) -> DataFrame:
    """``docs`` with values in ``text_col`` replaced, plus ``n_<kind>`` and ``n_replaced``.

    Null texts stay null and empty ones empty, with counts 0; very long texts are searched
    whole; equal values get equal pseudonyms in any row, so repeated rows and ties change
    alike; values that fail their format's test stay; an empty table gives an empty one.
    Other columns pass through (those named like the counts are replaced).  With
    ``restore`` the same key brings the values back.
    """
    ours = [*(f"n_{k}" for k in KINDS), "n_replaced"]
    keep = [c for c in docs.columns if c not in ours]
    at = keep.index(text_col)

    def run(batches):
        names = _NAMES.setdefault((key, restore), Pseudonyms(key, restore))
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(at).to_pylist():
                new, found = names(t) if t else (t, {})
                texts.append(new)
                counts.append([*(found.get(k, 0) for k in KINDS), sum(found.values())])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(ours)))], names=[*keep, *ours])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep).mapInArrow(run, f"{kinds}, " + ", ".join(f"{n} long" for n in ours))


def op4_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", F.col("text")))
