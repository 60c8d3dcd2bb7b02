"""Format-preserving pseudonyms for personal data.

Validated numbers, dates, addresses and keys are found in whole texts and replaced by a keyed Feistel permutation of
their own format: a card number becomes another Luhn-valid card number of that length, a date another date in the same
notation. Equal values give equal pseudonyms in every document, and the key owner can invert them.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.shared import free_name

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutation of 0..size-1: a balanced Feistel network on two halves, walked until it lands in range."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = hashlib.blake2b(key, digest_size=64).digest()  # all of the key counts, however long

    def _round(self, kind: str, size: int, i: int, half: int) -> int:
        msg = f"{kind}|{size}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(msg, key=self.key, digest_size=16).digest(), "big")

    def _once(self, x: int, size: int, kind: str, back: bool) -> int:
        base = 1 << ((max(size - 1, 1).bit_length() + 1) // 2)
        a, b = divmod(x, base)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = (b - self._round(kind, size, i, a)) % base, a
            else:
                a, b = b, (a + self._round(kind, size, i, b)) % base
        return a * base + b

    def permute(self, x: int, size: int, kind: str, ok: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """The image of ``x``; both lie in 0..size-1 and satisfy ``ok``."""
        if size < 2:
            return x
        while True:
            x = self._once(x, size, kind, back)
            if x < size and ok(x):
                return x


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mix(value: str, digits: str, of: re.Pattern) -> str:
    """Put new characters where the old value has characters of that class; separators stay."""
    new = iter(digits)
    return of.sub(lambda _: next(new), value)


_DIGIT, _ALNUM = re.compile(r"[0-9]"), re.compile(r"[0-9A-Za-z]")
#: Ten digits of the North American plan: neither area code nor exchange begins with 0 or 1.
_NANP = re.compile(r"[2-9][0-9]{2}[2-9][0-9]{6}")


def card(f: Feistel, value: str, back: bool = False) -> str | None:
    d = re.sub(r"[ -]", "", value)
    if len(set(d)) == 1 or luhn(d[:-1]) != int(d[-1]):
        return None
    n = len(d) - 2
    body = d[0] + f"{f.permute(int(d[1:-1]), 10**n, f'card{d[0]}', back=back):0{n}d}"
    return _mix(value, body + str(luhn(body)), _DIGIT)


def phone(f: Feistel, value: str, back: bool = False) -> str | None:
    d = re.sub(r"[^0-9]", "", value)
    if value.startswith("+") and not (value.startswith("+1") and len(d) == 11):
        if not 8 <= len(d) <= 15:
            return None
        n = len(d) - 2  # the country's first two digits stay
        return _mix(value, d[:2] + f"{f.permute(int(d[2:]), 10**n, 'phone' + d[:2], back=back):0{n}d}", _DIGIT)
    head, d = d[:-10], d[-10:]
    if len(d) != 10 or head not in ("", "1"):
        return None
    if not _NANP.fullmatch(d):  # a phone by its format only; it stays outside the plan, so both maps can be inverted
        x = f.permute(int(d), 10**10, "phone10", lambda x: not _NANP.fullmatch(f"{x:010d}"), back)
        return _mix(value, f"{head}{x:010d}", _DIGIT)
    x = (int(d[0]) - 2) * 8 * 10**8 + int(d[1:3]) * 8 * 10**6 + (int(d[3]) - 2) * 10**6 + int(d[4:])
    x = f.permute(x, 64 * 10**8, "nanp", back=back)
    area, rest = divmod(x, 8 * 10**6)
    return _mix(value, head + f"{area // 100 + 2}{area % 100:02d}{rest // 10**6 + 2}{rest % 10**6:06d}", _DIGIT)


def address(f: Feistel, value: str, back: bool = False) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, octets)), "big"), 2**32, "ipv4", back=back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def ssn(f: Feistel, value: str, back: bool = False) -> str | None:
    ok = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 and x % 10**4
    x = int(value.replace("-", ""))
    return _mix(value, f"{f.permute(x, 10**9, 'ssn', ok, back):09d}", _DIGIT) if ok(x) else None


def iban(f: Feistel, value: str, back: bool = False) -> str | None:
    v = value.replace(" ", "")
    mod = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    if not 15 <= len(v) <= 34 or mod(v[4:] + v[:4]) != 1:
        return None
    body = _permuted_chars(f, v[4:], "iban" + v[:2], back)
    new = v[:2] + f"{98 - mod(body + v[:2] + '00'):02d}" + body
    return _mix(value, new, _ALNUM)


def _permuted_chars(f: Feistel, chars: str, kind: str, back: bool) -> str:
    """Permute a string within its pattern of digits and letters; case and other characters stay where they are."""
    radix = [10 if c.isdigit() else 26 for c in chars if c.isascii() and c.isalnum()]
    shape = "".join("0" if c in "0123456789" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in chars)
    x, size = 0, 1
    for c, r in zip((c for c in chars if c.isascii() and c.isalnum()), radix):
        x, size = x * r + (int(c) if r == 10 else ord(c.lower()) - 97), size * r
    x = f.permute(x, size, f"{kind}|{shape.lower()}", back=back)
    out = []
    for c in reversed(shape):
        if c not in ("0", "a", "A"):
            out.append(c)
            continue
        x, d = divmod(x, 10 if c == "0" else 26)
        out.append(str(d) if c == "0" else chr(ord(c) + d))
    return "".join(reversed(out))


def email(f: Feistel, value: str, back: bool = False) -> str | None:
    local, _, domain = value.rpartition("@")
    return _permuted_chars(f, local, "email@" + domain.lower(), back) + "@" + domain


def access_key(f: Feistel, value: str, back: bool = False) -> str | None:
    return value[:4] + _permuted_chars(f, value[4:], "key" + value[:4], back)


def _date(order: str, f: Feistel, value: str, back: bool) -> str | None:
    sep = re.search(r"[^0-9]", value)[0]
    p = dict(zip(order, value.split(sep)))

    def day(p: dict) -> int | None:
        try:
            n = datetime.date(int(p["y"]), int(p["m"]), int(p["d"])).toordinal()
        except ValueError:
            return None
        return n if FIRST_DAY <= n <= LAST_DAY else None

    n = day(p)
    if n is None:
        return None
    padded = len(p["d"]) == 2 and len(p["m"]) == 2
    at = lambda x: datetime.date.fromordinal(x + FIRST_DAY)
    ok = lambda x: (order != "mdy" or at(x).day > 12) and (padded or at(x).day < 10 or at(x).month < 10)
    if not ok(n - FIRST_DAY):
        return None
    short = "".join(c for c in "dm" if len(p[c]) == 1)
    size = LAST_DAY - FIRST_DAY + 1
    fits = lambda x: ok(x) and all((at(x).day if c == "d" else at(x).month) < 10 for c in short) and all(len(p[c]) == 2 or c in short for c in "dm")
    # dates of two-digit days and months, year first or day first, share one map, so equal days stay equal
    kind = "date" if padded and order != "mdy" else f"date{order}{short}"
    t = at(f.permute(n - FIRST_DAY, size, kind, fits, back))
    w = {"y": f"{t.year:04d}", "m": str(t.month) if "m" in short else f"{t.month:02d}", "d": str(t.day) if "d" in short else f"{t.day:02d}"}
    return sep.join(w[c] for c in order)


def date(f: Feistel, value: str, back: bool = False) -> str | None:
    """Year first, or day first where that is a date, or else month first."""
    if re.match(r"\d{4}", value):
        return _date("ymd", f, value, back)
    return _date("dmy", f, value, back) or _date("mdy", f, value, back)


#: kind, pattern, pseudonym; the first that matches and validates at a place wins.
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@])", email),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", iban),
    ("access_key", r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)", access_key),
    ("ipv4", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\w)", address),
    ("date", r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?!(?!T[0-9]{2}:)[\w/-])", date),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", ssn),
    ("card", r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])", card),
    ("phone", r"(?<![\w+(])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){1,6}(?!\w)", phone),
]
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in KINDS))
_MARK = re.compile(r"[0-9@]")
_STEP = re.compile(r"\w+|\W")
_BY_KIND = {k: fn for k, _, fn in KINDS}
_ONE = [(k, re.compile(p)) for k, p, _ in KINDS]


def pseudonymise(text: str, f: Feistel, found: list | None = None, back: bool = False) -> str:
    """The text with every validated value replaced; ``found`` gets (kind, start, length) in the original text."""

    def line(own: str, base: int) -> str:
        at, out = 0, []
        while True:
            hit = _ANY.search(own, at)
            if not hit:
                out.append(own[at:])
                return "".join(out)
            for kind, pattern in _ONE:  # a match that does not validate leaves the place to the next kind
                one = hit if hit.lastgroup == kind else pattern.match(own, hit.start())
                value = one and one[0]
                new = value and _BY_KIND[kind](f, value, back)
                while kind == "iban" and value and not new and " " in value:  # a capital word may follow
                    value = value.rpartition(" ")[0]
                    new = iban(f, value, back)
                if new:
                    out += [own[at : one.start()], new]
                    at = one.start() + len(value)
                    if found is not None:
                        found.append((kind, base + one.start(), len(value)))
                    break
            else:
                step = _STEP.match(own, hit.start()).end()
                out.append(own[at:step])
                at = step

    parts, done = [], 0
    while mark := _MARK.search(text, done):  # only lines with a digit or an at-sign can hold a value
        start = text.rfind("\n", done, mark.start()) + 1 or done
        end = text.find("\n", mark.start())
        end = len(text) if end < 0 else end
        parts += [text[done:start], line(text[start:end], start)]
        done = end
    return "".join([*parts, text[done:]])


def pseudonymise_documents(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and a column ``pii``: array of (kind, start, length) in the original.

    Null text stays null with no findings. Every other column passes unchanged, repeated rows and ties included; a
    column named ``pii`` is replaced. Empty in, empty out. Rows are independent, so no shuffle is needed.
    """

    @F.pandas_udf("struct<text string, pii array<struct<kind string, start int, length int>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        f = Feistel(key.encode())
        out, spans = [], []
        for t in texts:
            found: list = []
            out.append(pseudonymise(t, f, found) if isinstance(t, str) else None)
            spans.append([{"kind": k, "start": s, "length": n} for k, s, n in found])
        return pd.DataFrame({"text": out, "pii": spans})

    name = free_name(docs, "_made")
    made = docs.withColumn(name, run(F.col(text_col).cast("string")))
    return made.withColumn(text_col, F.col(f"{name}.text")).withColumn("pii", F.col(f"{name}.pii")).drop(name)
