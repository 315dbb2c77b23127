"""Format-preserving pseudonyms for personal data.

Cards, bank accounts, social security numbers, phone numbers, network addresses, dates in digits or with their month in
English letters, hexadecimal tokens in quotes or after =, and the names in mail addresses are found by pattern, validated (check digits, ranges, calendar), and replaced by another valid value of the same
format. A keyed Feistel network permutes each format's values, so equal values get equal pseudonyms in all documents
and different ones stay different; no value is its own pseudonym. Whoever has the key can undo it.

A card or account may have other numbers beside it, so each span of whole groups is tried. Where a pseudonym would be
read as another span or kind than the value was, the permutation is applied again until it isn't.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe, scratch

ROUNDS = 10
LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of 0..size-1 without fixed points (for size > 1), and its inverse."""

    def __init__(self, key: bytes, label: str, size: int):
        self.size, self.side = size, math.isqrt(max(0, size - 1)) + 1
        self.width = max(16, (self.side.bit_length() + 7) // 8 + 8)
        self.seed = hashlib.blake2b(f"{label}/{size}".encode(), key=key[:64], digest_size=32).digest()
        self.shift = 1 + int.from_bytes(hashlib.blake2b(b"shift", key=self.seed, digest_size=64).digest()) % max(1, size - 1)

    def _round(self, i: int, half: int) -> int:
        return int.from_bytes(hashlib.shake_256(self.seed + bytes([i]) + half.to_bytes(self.width)).digest(self.width)) % self.side

    def _there(self, x: int) -> int:
        while True:  # walks on while outside the values
            left, right = divmod(x, self.side)
            for i in range(ROUNDS):
                left, right = right, (left + self._round(i, right)) % self.side
            x = left * self.side + right
            if x < self.size:
                return x

    def _back(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.side)
            for i in reversed(range(ROUNDS)):
                left, right = (right - self._round(i, left)) % self.side, left
            x = left * self.side + right
            if x < self.size:
                return x

    def apply(self, x: int, undo: bool = False) -> int:
        """There, a keyed step on, and back: a conjugate of a step, which leaves no value in place."""
        if self.size < 2:
            return x
        step = -self.shift if undo else self.shift
        return self._back((self._there(x) + step) % self.size)


#: Each digit's double, less nine where that has two digits.
DOUBLED = str.maketrans(DIGITS, "".join(str(2 * d - 9 * (d > 4)) for d in range(10)))


def luhn(digits: str) -> int:
    """What the digits lack to a multiple of ten, the last being the check digit."""
    whole, twice = digits[::-2], digits[-2::-2].translate(DOUBLED)
    return (48 * len(digits) - sum(whole.encode()) - sum(twice.encode())) % 10


def mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def alphabet(c: str) -> str:
    return next((a for a in (LOW, UP, DIGITS) if c in a), c)


class Pseudonyms:
    """Replaces the values of a text under one key."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo, self.nets, self.known = key, undo, {}, {}

    def permute(self, label: str, size: int, x: int) -> int:
        net = self.nets.get((label, size))
        if net is None:
            if len(self.nets) > 10_000:
                self.nets.clear()
            net = self.nets[label, size] = Feistel(self.key, label, size)
        return net.apply(x, self.undo)

    def letters(self, label: str, text: str) -> str:
        """Letters and digits permuted within their kind, other characters in place."""
        kinds = [alphabet(c) for c in text]
        size, x = 1, 0
        for a, c in zip(kinds, text, strict=True):
            size, x = size * len(a), x * len(a) + a.index(c)
        # the kinds of the places are part of the format
        x, out = self.permute(label + "".join(a[0] for a in kinds), size, x), []
        for a in reversed(kinds):
            x, d = divmod(x, len(a))
            out.append(a[d])
        return "".join(reversed(out))

    def digits(self, label: str, text: str, new: str) -> str:
        """``text`` with its letters and digits replaced by those of ``new``."""
        it = iter(new)
        return "".join(next(it) if c.isalnum() else c for c in text)

    def card(self, text: str) -> str | None:
        own = "".join(c for c in text if c.isdigit())
        if luhn(own) or len(set(own)) == 1:
            return None
        body = self.letters("card", own[:-1])
        return self.digits("card", text, body + str(luhn(body + "0")))

    def account(self, text: str) -> str | None:
        own = text.replace(" ", "")
        if not 15 <= len(own) <= 34 or mod97(own) != 1:
            return None
        body = self.letters("account", own[4:])
        return self.digits("account", text, own[:2] + f"{98 - mod97(own[:2] + '00' + body):02d}" + body)

    def security(self, text: str) -> str | None:
        a, g, s = int(text[:3]), int(text[4:6]), int(text[7:])  # with one mark between
        if not (0 < a < 900 and a != 666 and g and s):
            return None
        x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
        x, s = divmod(self.permute("security", 898 * 99 * 9999, x), 9999)
        a, g = divmod(x, 99)
        return text[3].join((f"{a + 1 + (a >= 665):03d}", f"{g + 1:02d}", f"{s + 1:04d}"))

    def phone(self, text: str) -> str | None:
        at = next(i for i in range(len(text)) if sum(c.isdigit() for c in text[i:]) == 10)
        own = "".join(c for c in text[at:] if c.isdigit())
        return text[:at] + self.digits("phone", text[at:], self.letters("phone", own))

    def address(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        return ".".join(map(str, self.permute("address", 1 << 32, int.from_bytes(bytes(map(int, parts)))).to_bytes(4)))

    def mail(self, text: str) -> str | None:
        name, at, host = text.rpartition("@")
        new = self.letters("mail", name)
        return new + at + host if new != name else None

    def day(self, y: str, m: str, d: str) -> tuple[str, str, str] | None:
        try:
            x = date(int(y), int(m), int(d)).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= x < DAYS:
            return None
        new = date.fromordinal(FIRST_DAY + self.permute("day", DAYS, x))
        return f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"

    def iso(self, text: str) -> str | None:
        new = self.day(text[:4], text[5:7], text[8:])
        return new and text[4].join(new)

    def dmy(self, text: str) -> str | None:
        new = self.day(text[6:], text[3:5], text[:2])
        return new and text[2].join(reversed(new))

    def mdy(self, text: str) -> str | None:
        new = self.day(text[6:], text[:2], text[3:5])
        return new and text[2].join((new[1], new[2], new[0]))

    def worded(self, text: str, short: bool, padded: bool) -> str | None:
        """A date with its month in letters. The new day and month may be of another kind, and are permuted on then."""
        m = WORDED.fullmatch(text)
        names = [n[:3] for n in MONTHS] if short else MONTHS
        new = self.day(m["year"], str(names.index(m["month"]) + 1), m["day"] or m["first"])
        if not new:
            return None
        day = new[2] if padded else str(int(new[2]))
        parts = {"first": day, "day": day, "month": names[int(new[1]) - 1], "year": new[0]}
        return "".join(parts.get(name, m[name]) for name in sorted((n for n in m.groupdict() if m[n] is not None), key=m.start))

    def home(self, text: str) -> str | None:
        """A number with its area code; the zero stays."""
        return text[0] + self.digits("home", text[1:], self.letters("home", "".join(c for c in text[1:] if c.isdigit())))

    def abroad(self, text: str) -> str | None:
        """All but the country code, which is taken to be the first group or, where that is longer, two digits."""
        first = GROUP.search(text).group()
        at = 1 + (len(first) if len(first) <= 3 else 2)
        own = "".join(c for c in text[at:] if c.isdigit())
        return text[:at] + self.digits("abroad", text[at:], self.letters("abroad", own))

    def secret(self, text: str) -> str | None:
        size = 16 ** len(text)
        return f"{self.permute('secret', size, int(text, 16)):0{len(text)}x}"

    def one(self, kind: str, text: str) -> str | None:
        seen = self.known.get((kind, text), 0)
        if seen == 0:
            if len(self.known) > 200_000:
                self.known.clear()
            base, _, how = kind.partition("_")
            seen = self.known[kind, text] = getattr(self, base)(text, *((how[0] == "s", how[1] == "p") if how else ()))
        return seen

    def at(self, text: str, start: int, least: str | None = None) -> tuple[int, int, str] | None:
        """The value that begins at ``start``: begin, end, kind; none before the kind ``least`` fits there."""
        for kind in FROM[least]:
            m = KINDS[kind].match(text, start)
            for end in spans(kind, m) if m else ():
                if self.one(kind, text[start:end]) is not None:
                    return start, end, kind
        return None

    def first(self, text: str, pos: int, pattern: re.Pattern | None = None) -> tuple[int, int, str] | None:
        """The first value from ``pos`` on. ``pattern``: one that misses no value of the text."""
        pattern = pattern or PATTERN
        while m := pattern.search(text, pos):
            hit = self.at(text, m.start(), m.lastgroup)
            if hit and hit[2] == "card" and not usual("card", text[hit[0] : hit[1]]):
                for g in GROUP.finditer(text, hit[0] + 1, hit[1]):
                    later = self.at(text, g.start(), "card")
                    if later and usual("card", text[later[0] : later[1]]) and later == self.at(text, g.start()):
                        return later
            if hit:
                return hit
            pos = m.start() + 1
        return None

    def text(self, text: str, counts: Counter) -> str:
        years = any(y in text for y in YEARS)
        if not years and not HINT.search(text):
            return text
        out, done = [], 0
        while hit := self.first(text, done, PATTERN if years else PLAIN):
            start, end, kind = hit
            # what stands before may be read together with the new value
            near = max(done, start - REACH)
            head, tail = text[max(0, near - 1) : start], text[end : end + REACH]
            old = new = text[start:end]
            while True:
                new = self.one(kind, new)
                if new == old or self.first(head + new + tail, near - max(0, near - 1)) == (len(head), len(head) + len(new), kind):
                    break
            counts[kind] += 1
            out += [text[done:start], new]
            done = end
        return "".join(out) + text[done:]


def usual(kind: str, text: str, sizes: tuple[int, ...] | None = None) -> bool:
    """Whether a card's digits are grouped (into ``sizes``), or an account is as long, as usual."""
    if kind == "card":
        sizes = tuple(map(len, GROUP.findall(text))) if sizes is None else sizes
        return len(sizes) == 1 or sizes in GROUPED and (" " in text) != ("-" in text)
    return ACCOUNTS.get(text[:2]) == len(text.replace(" ", ""))


def spans(kind: str, m: re.Match) -> list[int]:
    """Ends of the spans to try of a match: the whole, or those of whole groups, usual and then long ones first."""
    if kind not in ("card", "account"):
        return [m.end()]
    text, start, least = m.string, m.start(), 13 if kind == "card" else 15
    first, rest, sizes, total = [], [], (), 0
    for g in GROUP.finditer(text, start, m.end()):
        end = g.end()
        sizes += (end - g.start(),)
        total += sizes[-1]
        if total >= least:
            (first if usual(kind, text[start:end], sizes) else rest).append(end)
    return first[::-1] + rest[::-1]


#: Fixed value: how the digits of cards are grouped.
GROUPED = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}
GROUP = re.compile(r"[A-Za-z0-9]+")
#: Characters before and after a value that may be read together with it.
REACH = 400
#: Lengths of bank accounts by country.
ACCOUNTS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}
#: Fixed value: English months.
MONTHS = "January February March April May June July August September October November December".split()
LONG, BRIEF = "|".join(MONTHS), "|".join(n[:3] for n in MONTHS if n != "May")
DAY = {"p": r"0[1-9]", "o": r"[1-9]", "t": r"[12]\d|3[01]"}
WORDED = re.compile(rf"(?:(?P<first>\d\d?)(?P<gap> ))?(?P<month>{LONG}|{BRIEF})(?:(?P<space> )(?P<day>\d\d?))?(?P<mark>,? )(?P<year>\d{{4}})", re.ASCII)
#: Texts without a match of this hold none of the values.
HINT = re.compile(r"@|\d[\d().\-/ ]{6,}|[A-Z]{2}\d\d|[\"'=][0-9a-f]{32}")
#: Nor do those without a year like these, where they have no match of HINT.
YEARS = (" 19", " 20")
DIGIT_DATE = r"(?<![\w/.])\d{2}(?:/\d{2}/|\.\d{2}\.)\d{4}(?![\w]|[/.]\d)|(?<![\w-])\d{2}-\d{2}-\d{4}(?![\w]|-\d)"
KINDS = {
    kind: re.compile(pattern, re.ASCII)
    for kind, pattern in {
        "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9\u00a1-\uffff-]{1,63}(?:\.[A-Za-z0-9\u00a1-\uffff-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
        "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|(?<![^\s.,;:\"'(\[-])\d{3}[ .-]|(?<!\d)\d{3}[.-])\d{3}[ .-]\d{4}(?![\w]|[.-]\d)",
        "abroad": r"(?<![\w+])\+[1-9](?:[ .-]?[()]?[ .-]?\d){7,14}(?![\w]|[.-]\d)",
        "home": r"(?<![\w+-])0\d{2,4} \d{3,4} \d{3,4}(?![\w]|[ .-]\d)",
        "security": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)|(?<![\w-])(?<!\d )\d{3} \d{2} \d{4}(?![\w]|[- ]\d)",
        "iso": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?=T\d\d|(?![\w]|-\d))|(?<![\w/])\d{4}/\d{2}/\d{2}(?![\w]|/\d)",
        "dmy": DIGIT_DATE,
        "mdy": DIGIT_DATE,
        **{f"worded_{style}{form}{order}": rf"(?<!\w)(?:{f'(?:{day}) (?:{names}),?' if order == 'd' else f'(?:{names}) (?:{day}),?'}) \d{{4}}(?!\w)" for style, names in (("l", LONG), ("s", BRIEF)) for form, day in DAY.items() for order in "dm"},
        "address": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
        "secret": r"(?<=[\"'])[0-9a-f]{32,64}(?=[\"'])|(?<==)[0-9a-f]{32,64}(?!\w)",
        "card": r"(?<![\w])\d(?:[ -]?\d){12,18}(?![\w])",
    }.items()
}
FROM = {kind: list(KINDS)[k:] for k, kind in enumerate(KINDS)} | {None: list(KINDS)}
PATTERN, PLAIN = (re.compile("|".join(f"(?P<{kind}>{p.pattern})" for kind, p in KINDS.items() if worded or not kind.startswith("worded")), re.ASCII) for worded in (True, False))


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = "n_replaced", undo: bool = False) -> DataFrame:
    """``df`` with the values in ``text_col`` replaced under ``key``, and their number in ``count_col`` (None: no such column).

    Null texts stay null with 0 replaced, empty ones empty. Other columns and all rows stay; a column named
    ``count_col`` is replaced. Repeated rows get equal texts, an empty table gives none, very long texts are read whole in
    time in proportion to their length. Under another key, as another session has without one of its own, pseudonyms
    differ and don't link. Dates outside 1900 to 2099, numbers whose check digits are wrong and addresses out of
    range are no values and stay. A mail address without a letter or digit before the @ stays.
    """
    keep = [c for c in df.columns if c != count_col]
    schema = T.StructType([*(df.schema[c] for c in keep), *([T.StructField(count_col, T.LongType())] if count_col else [])])

    def run(chunks):
        names = Pseudonyms(key, undo)
        for b in chunks:
            at = b.schema.get_field_index(text_col)
            for lo, hi in bpe.batches(b.column(at)):
                part = b.slice(lo, hi - lo)
                texts, found = [], []
                for t in part.column(at).to_pylist():
                    counts: Counter = Counter()
                    texts.append(None if t is None else names.text(t, counts))
                    found.append(counts.total())
                cols = [pa.array(texts, pa.string()) if c == text_col else part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(found, pa.int64())] if count_col else []), names=[f.name for f in schema])

    return df.select(*keep).mapInArrow(scratch.lean(run), schema)
