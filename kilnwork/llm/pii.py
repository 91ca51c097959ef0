"""Personal data replaced by format-preserving pseudonyms.

What is found is validated first (check digits, number ranges, the calendar), then
read as a number in the range of its format and sent through a keyed Feistel
network over exactly that range (values that fall outside are sent through again).
The result is written in the same format: a card number stays a valid card number,
a date a date. As it is a permutation under one key, equal values get equal
pseudonyms in every document and different values different ones. No state and no
shuffle: each task works on its rows alone.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import require

ROUNDS = 10
#: Letters and digits of a value from which it isn't read as one number, whose arithmetic takes the square of its length.
LONG = 64
_DIGITS, _LETTERS, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049
#: Days (from the first) that are written month first and can't be read otherwise: those over the 12th.
_LATE_DAYS = [d for d in range(_DAYS) if datetime.date.fromordinal(_FIRST_DAY + d).day > 12]
_GAP = r"[ \t.|#*$%&!-]{0,6}"


def _compiled(pattern: str) -> re.Pattern:
    r"""ASCII alone counts as letters and digits (\w, \d), so a find may stand right beside letters of other scripts, as in those that don't put spaces between words."""
    return re.compile(pattern, re.ASCII)


#: What is looked for, in order of precedence where finds overlap.
PATTERNS = {
    "secret": _compiled(r"""(?i)(?<![A-Za-z0-9_])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)["']?\s*[=:]\s*["']?(?P<value>[A-Za-z0-9+/_\-]{6,}={0,2})"""),
    "access_key": _compiled(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<value>[A-Z0-9]{16})(?![A-Za-z0-9])"),
    "email": _compiled(r"(?<![\w.+-])(?P<value>[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)\.[A-Za-z]{2,}(?![A-Za-z0-9])"),
    "iban": _compiled(r"(?<![A-Za-z0-9])(?P<value>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "phone": _compiled(rf"(?<![\w.])(?:\+\d{{1,2}}{_GAP})?(?P<value>\(\d{{3}}\){_GAP}\d{{3}}[-. ]\d{{4}}|\d{{3}}[-.]\d{{3}}[-.]\d{{4}})(?!\d)"),
    "phone_abroad": _compiled(r"(?<![\w.])\+(?P<value>\d{1,3}(?:[ -]?\d{2,4}){2,5})(?!\d)"),
    "ip": _compiled(r"(?<![\w.])(?P<value>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\w]|\.\d)"),
    "ssn": _compiled(r"(?<![\w-])(?P<value>\d{3}-\d{2}-\d{4})(?![\w-])"),
    "date": _compiled(r"(?<![\w./-])(?P<value>\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})(?![\w/-]|\.\d)"),
    "card": _compiled(r"(?<![A-Za-z0-9])(?P<value>\d(?:[ -]?\d){12,})(?![A-Za-z0-9])"),
}
#: Lengths of IBANs by country; of other countries any from 15 to 34 may be valid.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: The usual groups of a card's digits (or one group of any length).
_CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
#: A text without any of these has nothing to find.
_WORTH = re.compile(r"\d|[@=:]")


def _card_cuts(value: str) -> list[tuple[int, int]]:
    """Where in a run of numbers a card may be: 13 to 19 digits in whole groups; usual groups first, then the most digits."""
    groups = [m.span() for m in re.finditer(r"\d+", value)]
    cuts = []
    for i, (start, _) in enumerate(groups):
        sizes: tuple[int, ...] = ()
        for first, end in groups[i : i + 19]:
            sizes += (end - first,)
            if sum(sizes) > 19:
                break
            if sum(sizes) >= 13:
                cuts.append((len(sizes) > 1 and sizes not in _CARD_GROUPS, -sum(sizes), start, end))
    return [cut[2:] for cut in sorted(cuts)]


def _shorter(value: str) -> list[tuple[int, int]]:
    """The value and what is left of it without its last groups, longest first."""
    return [(0, end) for end in (len(value), *(m.start() for m in reversed(list(re.finditer("[ -]", value)))))]


def _iban_cuts(value: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The cut of the country's length, and all others, longest first."""
    length = IBAN_LENGTHS.get(value[:2])
    cuts: tuple[list[tuple[int, int]], list[tuple[int, int]]] = [], []
    for cut in _shorter(value):
        cuts[len(value[: cut[1]].replace(" ", "")) != length].append(cut)
    return cuts


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, value: int, modulus: int) -> int:
        """A number that depends on all of value, 128 bits wider than the modulus at least."""
        size = (value.bit_length() + 7) // 8
        told = b"%d|%b|%d" % (i, tweak, size) + value.to_bytes(size, "big")
        digest = hashlib.blake2b(told, key=self.key, digest_size=64).digest()
        for part in range(1, -(-(modulus.bit_length() + 128) // 512)):
            digest += hashlib.blake2b(b"%d|" % part + told, key=self.key, digest_size=64).digest()
        return int.from_bytes(digest, "big")

    def __call__(self, value: int, n: int, tweak: bytes) -> int:
        if n < 2:
            return value
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(value, b)
            for i in range(0, ROUNDS, 2):
                left = (left + self._round(tweak, i, right, a)) % a
                right = (right + self._round(tweak, i + 1, left, b)) % b
            value = left * b + right
            if value < n:
                return value

    def long(self, values: list[int], radix: list[int], tweak: bytes) -> list[int]:
        """The same over lists of digits, each of its own radix, in time by their length: a half's digits move by a stream of numbers that depends on all of the other half."""
        cut = len(values) // 2
        halves, sizes = [values[:cut], values[cut:]], [radix[:cut], radix[cut:]]
        for i in range(ROUNDS):
            own, other = i % 2, 1 - i % 2
            told = hashlib.blake2b(b"%d|%b|%d|%d|" % (i, tweak, len(values), cut) + bytes(halves[other]), key=self.key, digest_size=64).digest()
            stream = hashlib.shake_256(self.key + told).digest(4 * len(halves[own]))
            steps = (int.from_bytes(stream[k : k + 4], "big") for k in range(0, len(stream), 4))
            halves[own] = [(v + s) % r for v, s, r in zip(halves[own], steps, sizes[own])]
        return halves[0] + halves[1]


def _luhn(digits: str) -> int:
    """The check digit that the digits before it ask for."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


class Pseudonyms:
    """Replacements by kind; None where a find isn't valid."""

    def __init__(self, key: bytes):
        self.permuted = Feistel(hashlib.blake2b(key, digest_size=32).digest())
        self.of = lru_cache(100_000)(self._of)

    def _characters(self, value: str, tweak: bytes, hexadecimal: bool = False) -> str:
        """Letters for letters (in their case), digits for digits, hexadecimal digits for such; other characters stay."""
        radix = [(_HEX if hexadecimal else _DIGITS if c in _DIGITS else _LETTERS) if c.isascii() and c.isalnum() else "" for c in value]
        if sum(map(bool, radix)) > LONG:
            digits = [(c, alphabet) for c, alphabet in zip(value, radix) if alphabet]
            moved = iter(self.permuted.long([a.index(c.lower()) for c, a in digits], [len(a) for _, a in digits], tweak + b" long"))
            capital = lambda c: value.isupper() if hexadecimal else c.isupper()
            return "".join((alphabet[next(moved)].upper() if capital(c) else alphabet[next(moved)]) if alphabet else c for c, alphabet in zip(value, radix))
        number, n = 0, 1
        for c, alphabet in zip(value, radix):
            if alphabet:
                number, n = number * len(alphabet) + alphabet.index(c.lower()), n * len(alphabet)
        number = self.permuted(number, n, tweak)
        out = []
        for c, alphabet in zip(reversed(value), reversed(radix)):
            if alphabet:
                number, i = divmod(number, len(alphabet))
                c = alphabet[i].upper() if (value.isupper() if hexadecimal else c.isupper()) else alphabet[i]
            out.append(c)
        return "".join(reversed(out))

    def _digits(self, value: str, tweak: bytes) -> str:
        """The digits of the value permuted together, the rest of it left; the same digits in another layout give the same digits."""
        digits = "".join(c for c in value if c in _DIGITS)
        new = iter(str(self.permuted(int(digits), 10 ** len(digits), tweak)).zfill(len(digits)))
        return "".join(next(new) if c in _DIGITS else c for c in value)

    def _of(self, kind: str, value: str) -> str | None:
        return getattr(self, f"_{kind}")(value)

    def _secret(self, value: str) -> str:
        hexadecimal = len(value) >= 16 and all(c in _HEX for c in value.lower())
        return self._characters(value, b"secret", hexadecimal)

    def _access_key(self, value: str) -> str:
        return self._characters(value, b"access key")

    def _email(self, value: str) -> str:
        return self._characters(value, b"email")

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        checked = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
        if not 15 <= len(plain) <= 34 or checked(plain) != 1:
            return None
        body = self._characters(plain[4:], b"iban " + plain[:2].encode())
        check = 98 - checked(plain[:2] + "00" + body)
        new = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in value)

    def _phone(self, value: str) -> str:
        return self._digits(value, b"phone")

    def _phone_abroad(self, value: str) -> str | None:
        digits = sum(c in _DIGITS for c in value)
        return value[0] + self._digits(value[1:], b"phone abroad") if 8 <= digits <= 15 else None

    def _ip(self, value: str) -> str | None:
        written_ = value.split(".")
        parts = [int(x) for x in written_]
        if max(parts) > 255:
            return None
        new = self.permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
        padded = any(len(x) > 1 and x[0] == "0" for x in written_)
        return ".".join(f"{x:03d}" if padded else str(x) for x in new.to_bytes(4, "big"))

    def _ssn(self, value: str) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        area -= area > 666
        area, group, serial = area - 1, group - 1, serial - 1
        new = self.permuted((area * 99 + group) * 9999 + serial, 898 * 99 * 9999, b"ssn")
        new, serial = divmod(new, 9999)
        area, group = divmod(new, 99)
        area += 1 + (area + 1 >= 666)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _date(self, value: str) -> str | None:
        sign = next(c for c in value if c not in _DIGITS)
        parts = value.split(sign)
        numbers = [int(x) for x in parts]
        if len(parts[0]) == 4:
            order = (0, 1, 2)
        else:
            order = (2, 1, 0) if numbers[1] <= 12 else (2, 0, 1)
        try:
            day = datetime.date(*(numbers[i] for i in order)).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        if order == (2, 0, 1):  # stays among the dates that only this layout can hold, so no day-first date comes out alike
            new = _LATE_DAYS[self.permuted(bisect_left(_LATE_DAYS, day), len(_LATE_DAYS), b"date month first")]
        else:
            new = self.permuted(day, _DAYS, b"date")
        new = datetime.date.fromordinal(_FIRST_DAY + new)
        padded = any(len(p) == 2 and p[0] == "0" for p in parts) or all(len(p) > 1 for p in parts)
        out = [""] * 3
        for i, x in zip(order, (new.year, new.month, new.day)):
            out[i] = f"{x:02d}" if padded else str(x)
        return sign.join(out)

    def _card(self, value: str) -> str | None:
        digits = "".join(c for c in value if c in _DIGITS)
        if not 13 <= len(digits) <= 19 or _luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = digits[0] + str(self.permuted(int(digits[1:-1]), 10 ** (len(digits) - 2), b"card")).zfill(len(digits) - 2)
        new = iter(f"{body}{_luhn(body)}")
        return "".join(next(new) if c in _DIGITS else c for c in value)

    def replaced(self, text: str, kinds: dict[str, re.Pattern]) -> tuple[str, Counter]:
        found: Counter = Counter()
        if not _WORTH.search(text):
            return text, found
        spans: list[tuple[int, int, str]] = []

        def take(kind: str, start: int, end: int) -> bool:
            """Whether the find is valid and free of others."""
            # The spans are sorted and don't overlap, so only the neighbours matter.
            at = bisect_left(spans, (start,))
            if at < len(spans) and spans[at][0] < end or at and spans[at - 1][1] > start:
                return False
            new = self.of(kind, text[start:end])
            if new is None:
                return False
            insort(spans, (start, end, new))
            found[kind] += 1
            return True

        long: list[tuple[int, str]] = []
        for kind, pattern in kinds.items():
            if kind == "email" and "@" not in text or kind == "access_key" and "IA" not in text or kind == "phone_abroad" and "+" not in text:
                continue
            if kind == "iban":  # one may begin within a find that isn't valid, or right after its valid part
                for other in (False, True):
                    m = pattern.search(text)
                    while m:
                        start = m.start("value")
                        m = pattern.search(text, next((start + e for _, e in _iban_cuts(m["value"])[other] if take(kind, start, start + e)), start + 1))
                continue
            for m in pattern.finditer(text):
                start, end = m.span("value")
                if kind == "card":
                    for s, e in _card_cuts(m["value"]):
                        take(kind, start + s, start + e)
                elif not take(kind, start, end) and kind == "phone_abroad":
                    long.append((start, m["value"]))
        for start, value in long:  # what follows a number may be a card, so after these
            any(take("phone_abroad", start, start + e) for _, e in _shorter(value))
        out, at = [], 0
        for start, end, new in spans:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), found


def pseudonymised(docs: DataFrame, key: bytes, id: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS), keep_columns: bool = False) -> DataFrame:
    """Each row once: id, the text with pseudonyms, n_replaced, and `kinds` found (sorted, comma-joined); with keep_columns all columns of docs, and only the text changed.

    A null text stays null, an empty one empty; whatever fails its validation
    stays as it is; rows with equal or null ids are treated each by itself; an
    empty table gives an empty result. A text of any length is looked through whole,
    in time by its length. The `key` is a secret of your own: with it, and only with it,
    pseudonyms can be linked. Other columns don't matter, or stay as they are.
    """
    if isinstance(key, str):
        key = key.encode()
    chosen = {k: PATTERNS[k] for k in kinds}
    source = docs if keep_columns else require(docs, id, text)
    at = source.columns.index(text)
    names = source.columns if keep_columns else [id, text, "n_replaced", "kinds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                rows = [(None, Counter()) if t is None else pseudonyms.replaced(t, chosen) for t in part.column(at).to_pylist()]
                columns = part.columns
                columns[at] = pa.array([t for t, _ in rows], part.column(at).type)
                if not keep_columns:
                    columns += [pa.array([sum(f.values()) for _, f in rows], pa.int64()), pa.array([",".join(sorted(f)) for _, f in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, schema if keep_columns else schema + ", n_replaced long, kinds string")


