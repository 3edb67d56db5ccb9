"""Format-preserving pseudonyms: personal numbers, dates and addresses are permuted, under a key, among those of their format.

A balanced Feistel network over mixed-radix digits permutes 0 to n - 1; walking on until the value is back in range keeps any n.
Separators, lengths, check digits and the calendar stay valid. A value is mapped alike everywhere, so documents stay linked, and the
key's holder can invert the map.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batches, by_document

#: The setting that holds the key in production, and the example key of tests where it is unset.
KEY_SETTING, KEY = "spark.tessera.pii.key", b"tessera example key"
ROUNDS = 10


class Feistel:
    """A keyed permutation of range(n) for each n and tweak."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _round(self, tweak: str, n: int, i: int, half: int, modulus: int) -> int:
        said = f"{tweak}|{n}|{i}|{half}".encode()
        return int.from_bytes(hmac.digest(self.key, said, "sha256")[:16] * (1 + modulus.bit_length() // 128), "big") % modulus

    def _once(self, x: int, n: int, a: int, b: int, tweak: str, backward: bool) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if backward else range(ROUNDS):
            if i % 2:
                right = (right + (-1 if backward else 1) * self._round(tweak, n, i, left, b)) % b
            else:
                left = (left + (-1 if backward else 1) * self._round(tweak, n, i, right, a)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, backward: bool = False) -> int:
        if n < 2:
            return x
        b = 1
        while b * b < n:
            b += max(1, b // 8) if b < 64 else 1 + b // 64
        a = -(-n // b)
        while True:  # a * b is little over n, so this ends soon
            x = self._once(x, n, a, b, tweak, backward)
            if x < n:
                return x


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


#: A replacer gives the pseudonym of a match, or None where the value isn't valid.
Replacer = Callable[[Feistel, str, bool], str | None]


def _card(f: Feistel, text: str, back: bool) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    body = str(f.permute(int(d[:-1]), 10 ** (len(d) - 1), "card", back)).zfill(len(d) - 1)
    return _refill(text, body + next(c for c in "0123456789" if luhn(body + c)))


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    """The country code stays."""
    head = re.match(r"\+\d{1,3}(?=[ (.-])", text)
    rest = text[head.end() :] if head else text
    d = _digits(rest)
    if not 7 <= len(d) <= 14:
        return None
    return text[: len(text) - len(rest)] + _refill(rest, str(f.permute(int(d), 10 ** len(d), "phone", back)).zfill(len(d)))


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = f.permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn", back)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(int(p) for p in parts), "big"), 2**32, "ip", back)
    return ".".join(str(b) for b in x.to_bytes(4, "big"))


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    """Digits behind the country and check digits are permuted, the check digits computed anew."""
    bare = text.replace(" ", "")
    spelled = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(bare) <= 34 or spelled(bare[4:] + bare[:4]) % 97 != 1:
        return None
    d = _digits(bare[4:])
    body = _refill(bare[4:], str(f.permute(int(d), 10 ** len(d), f"iban{len(d)}", back)).zfill(len(d))) if d else bare[4:]
    whole = iter(bare[:2] + f"{98 - spelled(body + bare[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(whole) for c in text)


_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _date(order: str) -> Replacer:
    """Days of 1900 to 2099 in the order of y, m and d given; the separator and padding stay.

    Month-day-year is what day-month-year can't be: its days are over 12 and stay so, so that the new date is read alike.
    """

    def run(f: Feistel, text: str, back: bool) -> str | None:
        parts = re.split(r"(\D)", text)
        said = dict(zip(order, parts[::2], strict=True))
        try:
            n = (date(int(said["y"]), int(said["m"]), int(said["d"])) - _FIRST).days
        except ValueError:
            return None
        if not 0 <= n < _DAYS or (order == "mdy" and int(said["d"]) < 13):
            return None
        unpadded = len(said["m"]) == 1 or len(said["d"]) == 1
        while True:
            n = f.permute(n, _DAYS, "date", back)
            new = _FIRST + timedelta(n)
            alike = all((v < 10) == (len(was) == 1 or was[0] == "0") for was, v in ((said["m"], new.month), (said["d"], new.day))) if unpadded else True
            if alike and (order != "mdy" or new.day > 12):
                break
        shown = {"y": f"{new.year:04d}", "m": str(new.month).zfill(len(said["m"])), "d": str(new.day).zfill(len(said["d"]))}
        return parts[1].join(shown[k] for k in order)

    return run


# Fixed names of months, in order.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_SHORT = tuple(m[:3] for m in MONTHS)


def _named_date(order: str) -> Replacer:
    """The same for dates whose month is an English name, whole or its first three letters, in the order of y, m and d.

    May is both, so it stays May, and no other month becomes it; case, padding and what stands between the parts stay as well.
    """

    def run(f: Feistel, text: str, back: bool) -> str | None:
        parts = re.split(r"([^0-9A-Za-z]+)", text)
        said = dict(zip(order, parts[::2], strict=True))
        names = MONTHS if said["m"].capitalize() in MONTHS else _SHORT
        month = [n.lower() for n in names].index(said["m"].lower()) + 1
        try:
            n = (date(int(said["y"]), month, int(said["d"])) - _FIRST).days
        except ValueError:
            return None
        if not 0 <= n < _DAYS:
            return None
        short = len(said["d"]) == 1 or said["d"][0] == "0"
        while True:
            n = f.permute(n, _DAYS, "date", back)
            new = _FIRST + timedelta(n)
            if (new.month == 5) == (month == 5) and (new.day < 10) == short:
                break
        name = names[new.month - 1]
        name = name.upper() if said["m"].isupper() else name.lower() if said["m"].islower() else name
        shown = iter([{"y": f"{new.year:04d}", "m": name, "d": str(new.day).zfill(len(said["d"]))}[k] for k in order])
        return "".join(next(shown) if i % 2 == 0 else p for i, p in enumerate(parts))

    return run


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _email(f: Feistel, text: str, back: bool) -> str | None:
    """Letters and digits of the local part, each within its kind; dots and the domain stay."""
    local, _, domain = text.rpartition("@")
    radix = [26 if c in _LOWER or c in _UPPER else 10 if c.isascii() and c.isdigit() else 1 for c in local]
    n, x = 1, 0
    for c, r in zip(local, radix, strict=True):
        n *= r
        x = x * r + (int(c) if r == 10 else (_LOWER + _UPPER).index(c) % 26 if r == 26 else 0)
    shape = re.sub(r"[0-9]", "0", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", local)))
    x = f.permute(x, n, f"email|{shape}|{domain.lower()}", back)
    out = []
    for c, r in zip(reversed(local), reversed(radix), strict=True):
        x, v = divmod(x, r)
        out.append(str(v) if r == 10 else (_UPPER if c in _UPPER else _LOWER)[v] if r == 26 else c)
    return "".join(reversed(out)) + "@" + domain


_NAME = "|".join((*MONTHS, *_SHORT))

#: Kind, pattern, replacer; at one place the first valid kind is taken. Patterns are bounded, so scanning is linear.
KINDS: tuple[tuple[str, str, Replacer], ...] = (
    ("email", r"[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    ("date", r"(?<![0-9/.\-])(?:19|20)[0-9]{2}([/.\-])[0-9]{1,2}\1[0-9]{1,2}(?![0-9]|[/.\-][0-9])", _date("ymd")),
    ("date", r"(?<![0-9/.\-])[0-9]{1,2}([/.\-])[0-9]{1,2}\1(?:19|20)[0-9]{2}(?![0-9]|[/.\-][0-9])", _date("dmy")),
    ("date", r"(?<![0-9/.\-])[0-9]{1,2}([/.\-])[0-9]{1,2}\1(?:19|20)[0-9]{2}(?![0-9]|[/.\-][0-9])", _date("mdy")),
    ("date", rf"(?<![0-9A-Za-z])[0-9]{{1,2}}[ \-](?i:{_NAME})[ \-.,]{{1,2}}(?:19|20)[0-9]{{2}}(?![0-9A-Za-z])", _named_date("dmy")),
    ("date", rf"(?<![0-9A-Za-z])(?i:{_NAME})[. ]{{1,2}}[0-9]{{1,2}}, ?(?:19|20)[0-9]{{2}}(?![0-9A-Za-z])", _named_date("mdy")),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", _ssn),
    ("card", r"(?<![A-Za-z0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![A-Za-z0-9])", _card),
    ("phone", r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])", _phone),
    ("phone", r"(?<![A-Za-z0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])", _phone),
)
NAMES = tuple(dict.fromkeys(k for k, _, _ in KINDS))
#: Texts without any of these have nothing to find.
_HINT = re.compile(r"[0-9@]")


def _ends(pattern: re.Pattern[str], text: str, start: int, end: int) -> Iterator[int]:
    """The end of a match, then those before it, at separators, where the pattern matches too."""
    yield end
    for b in range(end - 1, start, -1):
        if not text[b].isalnum() and text[b - 1].isalnum() and pattern.fullmatch(text, start, b):
            yield b


class Pseudonyms:
    def __init__(self, key: bytes) -> None:
        feistel = Feistel(key)
        self.kinds = [(kind, re.compile(pattern), lru_cache(50_000)(lambda text, back, f=replace: f(feistel, text, back))) for kind, pattern, replace in KINDS]

    def replace(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of what was found, in code points of the text given.

        Kinds are taken in order of KINDS; what one has taken is closed to the next. Where a match fails its check or is closed in
        part, shorter ends and then later starts at separators are tried; what never passes is left alone. A longer span that passes
        by chance only after the change is read in its place on the way back: one in 10 for digits next to a card, in 97 for an IBAN.
        """
        if not _HINT.search(text):
            return text, []
        taken: list[tuple[int, int, str, str]] = []
        closed = bytearray(len(text))
        for kind, pattern, new in self.kinds:
            if kind == "email" and "@" not in text:
                continue
            at = 0
            while m := pattern.search(text, at):
                a, at = m.start(), m.start() + 1
                for b in _ends(pattern, text, a, m.end()):
                    if closed.find(1, a, b) < 0 and (said := new(text[a:b], back)) is not None:
                        taken.append((a, b, kind, said))
                        closed[a:b] = b"\1" * (b - a)
                        at = b
                        break
        taken.sort()
        out, at = [], 0
        for a, b, _, said in taken:
            out += [text[at:a], said]
            at = b
        return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in taken]


def key_of(spark: SparkSession) -> bytes:
    """The session's key; anyone can invert pseudonyms made without one, by the example key."""
    said = spark.conf.get(KEY_SETTING, None)
    return said.encode() if said else KEY


def pseudonymised(docs: DataFrame, key: bytes | None = None, back: bool = False) -> DataFrame:
    """docs with its columns, the text replaced, by the session's key if none is given; back inverts it with the same key.

    Null texts stay null, empty ones empty; rows with equal texts come out alike, whatever their ids; an empty table stays one.
    """
    key = key or key_of(docs.sparkSession)

    @F.pandas_udf("string")
    def replaced(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = Pseudonyms(key)
        for part in texts:
            yield part.map(lambda t: names.replace(t, back)[0], na_action="ignore")

    return docs.withColumn("text", replaced("text"))


def query(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, text (with pseudonyms; null counts as empty), n_found and a count a kind, spans as kind:start:end in the old text.

    Whole texts are read, however long, in time by their length; repeated rows and null ids come out like others; other columns play
    no part, whatever their names; an empty table gives an empty result.
    """
    key = key or key_of(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Pseudonyms(key)
        for rows in batches(frames):
            out = []
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                new, spans = names.replace(text or "")
                kinds = [k for k, _, _ in spans]
                out.append((doc, new, len(spans), *[kinds.count(k) for k in NAMES], ",".join(f"{k}:{a}:{b}" for k, a, b in spans)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "n_found", *[f"n_{k}" for k in NAMES], "spans"])

    counts = ", ".join(f"n_{k} long" for k in NAMES)
    found = by_document(docs.select("doc_id", "text"), run, f"text string, n_found long, {counts}, spans string")
    return found.withColumn("text_sha256", F.sha2("text", 256))
