"""Personal data replaced by format-preserving pseudonyms from keyed Feistel permutations."""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from demandloom.llm.common import bound_batches, pick

ROUNDS = 10
#: For demonstration and tests; give a secret key in production.
DEFAULT_KEY = b"demandloom-demonstration-key"
KINDS = ("email", "card", "iban", "phone", "ssn", "ip", "date")
RESULT = "doc_id long, text string, n_found long, found string, " + ", ".join(f"n_{k} long" for k in KINDS)


class Feistel:
    """Keyed permutations of whole numbers below a size, and of digit and letter strings."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, half: int, size: int) -> int:
        said = f"{tweak}|{i}|{half}".encode()
        return int.from_bytes(hmac.digest(self.key, said, hashlib.sha256)[:16], "big") % size

    def _once(self, value: int, left: int, right: int, tweak: str, back: bool) -> int:
        """One pass over left * right values; the halves keep their own sizes."""
        a, b = divmod(value, right)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * self._round(tweak, i, a, right)) % right
            else:
                a = (a + sign * self._round(tweak, i, b, left)) % left
        return a * right + b

    def permute(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """A permutation of 0..size-1; values beyond the size are walked on until they fall inside.

        The walk starts and ends inside, so it is a permutation too, and its inverse walks back.
        """
        if size < 2:
            return value
        right = isqrt(size - 1) + 1
        left = -(-size // right)
        value = self._once(value, left, right, tweak, back)
        while value >= size:
            value = self._once(value, left, right, tweak, back)
        return value

    def digits(self, text: str, tweak: str, back: bool = False) -> str:
        n = len(text)
        return f"{self.permute(int(text), 10**n, f'{tweak}{n}', back):0{n}d}" if n else text

    def letters(self, text: str, tweak: str, back: bool = False) -> str:
        """Lower-case ASCII letters of the same length."""
        value = 0
        for c in text:
            value = value * 26 + ord(c) - 97
        value = self.permute(value, 26 ** len(text), f"{tweak}{len(text)}", back)
        out = []
        for _ in text:
            value, rest = divmod(value, 26)
            out.append(chr(97 + rest))
        return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """Check digit that completes a card number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 if i % 2 else 2)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    moved = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(moved) % 97:02d}"


def _refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in shape)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


# One function per kind: the pseudonym of a match, or None if the match is not valid.


def _email(text: str, f: Feistel, back: bool) -> str | None:
    name, host = text.split("@")
    head, _, top = host.rpartition(".")
    if ".." in text or not head:
        return None
    body = f"{name}@{head}"
    letters = "".join(c.lower() for c in body if c.isascii() and c.isalpha())
    letters_of = iter(f.letters(letters, "email", back))
    digits_of = iter(f.digits(_only_digits(body), "email", back))
    out = []
    for c in body:
        if c.isascii() and c.isalpha():
            new = next(letters_of)
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(next(digits_of) if c in "0123456789" else c)
    return "".join(out) + "." + top


def _card(text: str, f: Feistel, back: bool) -> str | None:
    digits = _only_digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = f.digits(digits[:-1], "card", back)
    return _refill(text, body + luhn_digit(body))


def _iban(text: str, f: Feistel, back: bool) -> str | None:
    flat = text.replace(" ", "")
    country, check, account = flat[:2], flat[2:4], flat[4:]
    if not 11 <= len(account) <= 30 or iban_digits(country, account) != check:
        return None
    digits = f.digits(_only_digits(account), "iban" + country, back)
    new = _refill(account, digits)
    flat = iter(country + iban_digits(country, new) + new)
    return "".join(c if c == " " else next(flat) for c in text)


# Country codes of two digits; 1 and 7 stand alone, all others have three.
TWO_DIGIT_CODES = set(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def country_code(digits: str) -> str:
    """The country code that begins an international number; no code begins another, so no separator is needed."""
    return digits[: 1 if digits[:1] in ("1", "7") else 2 if digits[:2] in TWO_DIGIT_CODES else 3]


def _american(digits: str, f: Feistel, back: bool) -> str:
    """Ten national digits of +1: numbers with a valid area and exchange become such, all others others."""
    valid = lambda d: d[0] >= "2" and d[3] >= "2"
    if valid(digits):
        value = ((int(digits[:3]) - 200) * 800 + int(digits[3:6]) - 200) * 10_000 + int(digits[6:])
        value, line = divmod(f.permute(value, 800 * 800 * 10_000, "phone1", back), 10_000)
        return f"{value // 800 + 200}{value % 800 + 200}{line:04d}"
    new = f.digits(digits, "phone", back)
    while valid(new):  # a walk that starts and ends among the others permutes them
        new = f.digits(new, "phone", back)
    return new


def _phone(text: str, f: Feistel, back: bool) -> str | None:
    """The country code stays, and equal numbers stay equal in all written forms; 7 to 15 digits in all.

    Ten digits without a code count as a number of +1.
    """
    digits = _only_digits(text)
    if not 7 <= len(digits) <= 15:
        return None
    code = country_code(digits) if text.startswith("+") else ""
    own = digits[len(code) :]
    if code in ("", "1") and len(own) == 10:
        return _refill(text, code + _american(own, f, back))
    return _refill(text, code + f.digits(own, "phone", back))


def _ssn(text: str, f: Feistel, back: bool) -> str | None:
    area, group, serial = text.split("-")
    if not 1 <= int(area) <= 899 or area == "666" or group == "00" or serial == "0000":
        return None
    # Areas 1 to 899 but 666, groups 1 to 99, serials 1 to 9999, numbered without gaps.
    a = int(area) - 1 - (int(area) > 666)
    value = (a * 99 + int(group) - 1) * 9999 + int(serial) - 1
    value, serial_at = divmod(f.permute(value, 898 * 99 * 9999, "ssn", back), 9999)
    a, group_at = divmod(value, 99)
    a += 1
    return f"{a + (a >= 666):03d}-{group_at + 1:02d}-{serial_at + 1:04d}"


def _ip(text: str, f: Feistel, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if any(p > 255 or str(p) != s for p, s in zip(parts, text.split("."))):
        return None
    value = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
    return ".".join(str(b) for b in value.to_bytes(4, "big"))


FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
#: Groups of each written form, in the order year, month, day.
DATE_FORMS = (
    (re.compile(r"(\d{4})-(\d{2})-(\d{2})"), (1, 2, 3)),
    (re.compile(r"(\d{4})/(\d{2})/(\d{2})"), (1, 2, 3)),
    (re.compile(r"(\d{2})\.(\d{2})\.(\d{4})"), (3, 2, 1)),
    (re.compile(r"(\d{2})/(\d{2})/(\d{4})"), (3, 1, 2)),
    (re.compile(r"(\d{2})-(\d{2})-(\d{4})"), (3, 2, 1)),
)


def _date(text: str, f: Feistel, back: bool) -> str | None:
    """Equal days get equal pseudonyms in every written form. Slash dates are read month first."""
    for form, order in DATE_FORMS:
        m = form.fullmatch(text)
        if not m:
            continue
        try:
            day = date(*(int(m[g]) for g in order))
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        size = (LAST_DAY - FIRST_DAY).days + 1
        new = FIRST_DAY + timedelta(f.permute((day - FIRST_DAY).days, size, "date", back))
        value = dict(zip(order, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")))
        return "".join(value[g] + text[m.end(g) : (m.start(g + 1) if g < 3 else m.end())] for g in (1, 2, 3))
    return None


#: Characters of an IBAN by country, and digits after the country code of a phone where all numbers have as many.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC",
}
IBAN_LENGTHS = {country: n for n, countries in IBAN_COUNTRIES.items() for country in countries.split()}
PHONE_DIGITS = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "44": 10, "48": 9, "61": 9, "91": 10, "351": 9}


def _stops(text: str, m: re.Match, follows: str) -> list[int]:
    """Ends of words in a match, the last first; none of the characters that `follows` names stands behind."""
    behind = re.compile(follows, re.ASCII)
    return [e for e in range(m.end(), m.start(), -1) if text[e - 1].isalnum() and not behind.match(text, e)]


def _whole(text: str, m: re.Match) -> list[int]:
    return [m.end()]


def _card_ends(text: str, m: re.Match) -> list[int]:
    return [e for e in _stops(text, m, r"\d") if len(_only_digits(text[m.start() : e])) >= 13]


def _iban_ends(text: str, m: re.Match) -> list[int]:
    """The length of the country first."""
    ends = {e: len(text[m.start() : e].replace(" ", "")) for e in _stops(text, m, "[A-Za-z0-9]")}
    own = IBAN_LENGTHS.get(m[0][:2])
    return sorted((e for e, n in ends.items() if n >= 15), key=lambda e: (ends[e] != own, -e))


def _phone_ends(text: str, m: re.Match) -> list[int]:
    """The country's own length first, or all of a number written without separators."""
    code = re.match(r"\+(\d{1,3})[ ().-]", m[0])
    plain = re.match(r"\+\d{7,15}(?!\d)", m[0])
    own = len(plain[0]) - 1 if plain else len(code[1]) + PHONE_DIGITS.get(code[1], 15) if code else 0
    ends = {e: len(_only_digits(text[m.start() : e])) for e in _stops(text, m, r"\w")}
    return sorted((e for e, n in ends.items() if n == own or text[e : e + 1] != "-"), key=lambda e: (ends[e] != own, -e))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    change: Callable[[str, Feistel, bool], str | None]
    #: Where a match may end, in the order to try.
    ends: Callable[[str, re.Match], list[int]] = _whole


#: Tried in this order; where no end of a match is valid, the search goes on one character after its start.
#: Cards in the usual groups go before other numbers of as many digits.
RULES = (
    Kind("email", r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-])", _email),
    Kind("date", r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})(?![\d/-]|\.\d)", _date),
    Kind("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", _ip),
    Kind("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _iban, _iban_ends),
    Kind("card", r"(?<![\d+])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -]?)\d{6}\2\d{4,5})(?!\d)", _card, _card_ends),
    Kind("card", r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)", _card, _card_ends),
    Kind("phone", r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-])", _phone, _phone_ends),
    Kind("phone", r"(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\w-])", _phone),
)
FINDERS = tuple((k, re.compile(k.pattern, re.ASCII)) for k in RULES)
MAY_HOLD = re.compile(r"[0-9@]")


Match = tuple[int, int, Kind]


def _matches(text: str, f: Feistel, back: bool) -> tuple[list[Match], list[Match]]:
    """The valid matches in order of their starts, and those that were tried and are not valid."""
    found: list[Match] = []
    refused: list[Match] = []
    taken = bytearray(len(text))
    for kind, finder in FINDERS:
        at = 0
        while m := finder.search(text, at):
            start = m.start()
            at = start + 1
            for end in kind.ends(text, m):
                if taken.find(1, start, end) >= 0:
                    continue
                if kind.change(text[start:end], f, back) is None:
                    refused.append((start, end, kind))
                    continue
                found.append((start, end, kind))
                taken[start:end] = b"\1" * (end - start)
                at = end
                break
    return sorted(found, key=lambda x: x[0]), sorted(refused, key=lambda x: x[0])


def pseudonymise(text: str, f: Feistel, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with every valid match replaced, and (start, end, kind) of the matches in the input.

    A pseudonym must not make a refused match valid, or the way back would find other values. It is
    replaced by its own pseudonym until it does not; the way back takes the same steps from the last
    match to the first, so each sees the neighbours that it was chosen beside.
    """
    if not MAY_HOLD.search(text):
        return text, []
    found, refused = _matches(text, f, back)
    starts, longest = [a for a, _, _ in refused], max((b - a for a, b, _ in refused), default=0)
    out = list(text)
    for start, end, kind in reversed(found) if back else found:
        beside = refused[bisect_left(starts, start - longest) : bisect_left(starts, end)]
        rivals = [x for x in beside if x[1] > start]
        while True:
            new = kind.change("".join(out[start:end]), f, back)
            # An address may change its length; no other match cuts it.
            out[start:end] = new if len(new) == end - start else [new] + [""] * (end - start - 1)
            if all(k.change("".join(out[a:b]), f, back) is None for a, b, k in rivals):
                break
    return "".join(out), [(a, b, k.name) for a, b, k in found]


def replace_personal_data(docs: DataFrame, key: bytes = DEFAULT_KEY, back: bool = False) -> DataFrame:
    """Whole texts with personal data replaced, spans in the input (`start:end:kind`), and counts by kind.

    Numbers and dates are replaced only if valid (check digits, ranges, calendar). Equal values get
    equal pseudonyms in every document, but for values whose pseudonym would read otherwise beside
    the numbers next to them; `back` with the same key restores the input. Needs
    doc_id and text; other columns are ignored. NULL stays NULL and finds nothing; repeated rows
    give repeated results.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            done = [(None, []) if t is None else pseudonymise(t, f, back) for t in texts]
            counts = [pa.array([sum(s[2] == k for s in spans) for _, spans in done], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([t for t, _ in done], pa.string()),
                    pa.array([len(spans) for _, spans in done], pa.int64()),
                    pa.array([",".join(f"{a}:{b}:{k}" for a, b, k in spans) for _, spans in done], pa.string()),
                    *counts,
                ],
                names=["doc_id", "text", "n_found", "found", *[f"n_{k}" for k in KINDS]],
            )

    return pick(docs, "doc_id", "text").mapInArrow(run, RESULT)
