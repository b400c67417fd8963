"""Format-preserving pseudonyms for validated numbers, dates and addresses.

A value is split into two halves, each a number below a known bound, and a
keyed Feistel network adds to each half in turn a keyed hash of the other. That
is a permutation of all values of the format: equal values get equal pseudonyms
in all documents, different ones stay different, and the key's owner can turn
them back. Separators, lengths and check digits stay valid.

Kinds: payment cards (Luhn digit), bank account numbers (mod 97), social
security numbers, telephone numbers with a country code, IPv4 addresses, dates
of the years 1900 to 2099, and the local part of e-mail addresses. What doesn't
validate isn't touched. A card or account number may stand between other numbers
and words: the part that validates is replaced. Where several readings validate
the usual way of writing is taken.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
ROUNDS = 10

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})@((?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})")
NUMBERS = re.compile(
    r"(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    r"|(?<![\w-])(?P<iso>\d{4}-\d{2}-\d{2})(?:(?![\w-])|(?=T\d\d))"
    r"|(?<![\w./])(?P<dmy>\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4})(?![\w/])"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}(?:[ .-]?\(\d{2,4}\))?(?:[ .-]?\d{2,4}){2,4})(?!\d)"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\w-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w]|-\d)"
)
#: A card as it is usually written: unbroken, or in groups of 4-4-4-4, 4-6-5 or 4-6-4.
USUAL = re.compile(r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})(?!\w)")
#: Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    n: set(countries.split())
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST LY",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
DAY_0, DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


class Feistel:
    """A keyed permutation of pairs (a, b) with a < bound_a and b < bound_b."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _hash(self, turn: int, tweak: str, value: int, bound: int) -> int:
        size = (bound.bit_length() + 7) // 8 + 8
        data = f"{turn}|{tweak}|{value}".encode()
        out = b"".join(hashlib.blake2b(data + bytes([i]), key=self.key, digest_size=32).digest() for i in range(-(-size // 32)))
        return int.from_bytes(out[:size], "big") % bound

    def permute(self, a: int, b: int, bound_a: int, bound_b: int, tweak: str, back: bool = False) -> tuple[int, int]:
        tweak = f"{tweak}|{bound_a}|{bound_b}"
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if turn % 2 == 0:
                step = self._hash(turn, tweak, b, bound_a)
                a = (a - step if back else a + step) % bound_a
            else:
                step = self._hash(turn, tweak, a, bound_b)
                b = (b - step if back else b + step) % bound_b
        return a, b

    def number(self, value: int, bound: int, tweak: str, back: bool = False) -> int:
        """A permutation of range(bound): steps on until the result is in it."""
        low = 1
        while low * low < bound:
            low += 1 if bound < 1 << 16 else max(1, low // 2)
        high = -(-bound // low)
        while True:
            a, b = self.permute(value // low, value % low, high, low, tweak, back)
            value = a * low + b
            if value < bound:
                return value

    def symbols(self, text: str, tweak: str, back: bool = False) -> str:
        """Digits to digits and ASCII letters to letters of their case, in place."""
        at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
        if not at:
            return text
        kinds = ["0" if text[i].isdigit() else "A" if text[i].isupper() else "a" for i in at]
        radix = [10 if k == "0" else 26 for k in kinds]
        half = (len(at) + 1) // 2

        def pack(part: range) -> tuple[int, int]:
            value, bound = 0, 1
            for j in part:
                value, bound = value * radix[j] + ord(text[at[j]]) - ord(kinds[j]), bound * radix[j]
            return value, bound

        (a, bound_a), (b, bound_b) = pack(range(half)), pack(range(half, len(at)))
        a, b = self.permute(a, b, bound_a, bound_b, tweak + "".join(kinds), back)
        out = list(text)
        for value, part in ((a, range(half)), (b, range(half, len(at)))):
            for j in reversed(part):
                value, digit = divmod(value, radix[j])
                out[at[j]] = chr(ord(kinds[j]) + digit)
        return "".join(out)


def luhn_digit(digits: str) -> str:
    """Check digit after ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def respell(shape: str, symbols: str) -> str:
    """``symbols`` in the places of the letters and digits of ``shape``."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def is_card(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def card(f: Feistel, found: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not is_card(digits):
        return None
    # a longer value steps on until its first 16 digits are a card or none as before: it's read back at the same length
    as_before = is_card(digits[:16])
    while True:
        body = f.symbols(digits[:-1], "card", back)
        digits = body + luhn_digit(body)
        if len(digits) <= 16 or is_card(digits[:16]) == as_before:
            return respell(found, digits)


def card_ends(found: str, odd: bool) -> list[int]:
    """Ends of what may be a card at the start of ``found``, best first: as
    usually written; groups of four digits or more and a last one, from long to
    short; with ``odd`` all of ``found`` in whatever groups."""
    usual = USUAL.match(found)
    ends = [usual.end()] if usual else []
    groups = list(re.finditer(r"\d+", found))
    for k in reversed(range(len(groups))):
        end = groups[k].end()
        if all(len(g[0]) >= 4 for g in groups[:k]) and 13 <= sum(len(g[0]) for g in groups[: k + 1]):
            ends.append(end)
    return list(dict.fromkeys([*ends, *([len(found)] if odd else [])]))


def usual_card_later(found: str, text: str, start: int) -> bool:
    """A card as usually written starts at a later group of ``found``."""
    for g in re.finditer(r"(?<= )\d+", found):
        usual = USUAL.match(text, start + g.start())
        if usual and is_card(re.sub(r"\D", "", usual[0])):
            return True
    return False


def iban_ends(found: str) -> tuple[list[int], list[int]]:
    """Ends of what may be an account number: at its country's length; others from long to short."""
    ends = [m.end() for m in re.finditer(r"[A-Z0-9]+", found)][::-1]
    of_country = [e for e in ends if found[:2] in IBAN_LENGTHS.get(len(found[:e].replace(" ", "")), ())]
    return of_country, [e for e in ends if e not in of_country]


def country_iban_later(found: str, text: str, start: int) -> bool:
    """An account number of its country's length starts at a later word of ``found``."""
    for g in re.finditer(r"(?<= )[A-Z]{2}\d{2}", found):
        m = NUMBERS.match(text, start + g.start())
        if m and m["iban"] and any(is_iban(m["iban"][:e]) for e in iban_ends(m["iban"])[0]):
            return True
    return False


def _mod97(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def is_iban(found: str) -> bool:
    plain = found.replace(" ", "")
    return 15 <= len(plain) <= 34 and _mod97(plain[:2], plain[2:4], plain[4:]) == 1


def iban(f: Feistel, found: str, back: bool) -> str | None:
    plain = found.replace(" ", "")
    country, body = plain[:2], plain[4:]
    if not is_iban(found):
        return None
    body = f.symbols(body, "iban" + country, back)
    return respell(found, f"{country}{98 - _mod97(country, '00', body):02d}{body}")


def valid_ssn(area: int, group: int, serial: int) -> bool:
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def ssn(f: Feistel, found: str, back: bool) -> str | None:
    if not valid_ssn(*map(int, found.split("-"))):
        return None
    out = found
    while True:  # steps on to the next valid number
        out = respell(found, f.symbols(out.replace("-", ""), "ssn", back))
        if valid_ssn(*map(int, out.split("-"))):
            return out


def phone(f: Feistel, found: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 8 <= len(digits) <= 15:
        return None
    country = re.match(r"\+\d{1,3}", found)[0]
    return country + f.symbols(found[len(country) :], "phone" + country, back)


def ip(f: Feistel, found: str, back: bool) -> str | None:
    parts = [int(x) for x in found.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
        return None
    a, b = f.permute(parts[0] << 8 | parts[1], parts[2] << 8 | parts[3], 1 << 16, 1 << 16, "ip", back)
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def date(f: Feistel, found: str, back: bool) -> str | None:
    iso = found[4] == "-"
    sep = "-" if iso else "." if "." in found else "/"
    x = [int(v) for v in found.split(sep)]
    try:
        day = datetime.date(*(x if iso else x[::-1])).toordinal() - DAY_0
    except ValueError:
        return None
    if not 0 <= day < DAYS or (not iso and len(found) not in (8, 9, 10)):
        return None
    new = datetime.date.fromordinal(DAY_0 + f.number(day, DAYS, "date", back))
    return new.isoformat() if iso else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year:04d}"


def email(f: Feistel, local: str, domain: str, back: bool) -> str:
    return f"{f.symbols(local, 'email', back)}@{domain}"


MAKERS = {"card": card, "iban": iban, "ssn": ssn, "phone": phone, "ip": ip, "iso": date, "dmy": date}


def pseudonymise(text: str, f: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts = dict.fromkeys(KINDS, 0)

    def of_email(m: re.Match) -> str:
        counts["email"] += 1
        return email(f, m[1], m[2], back)

    def numbers(part: str) -> str:
        if not DIGIT.search(part):
            return part
        out, at, pos, odd_from = [], 0, 0, 0
        while m := NUMBERS.search(part, pos):
            kind = m.lastgroup if m.lastgroup != "sep" else "dmy"
            found, start, made = m[kind], m.start(kind), None
            ends = [len(found)]
            if kind == "card":
                ends = card_ends(found, start >= odd_from)
                if len(ends) and usual_card_later(found, part, start):
                    ends = ends[:1] if USUAL.match(found) else []
            elif kind == "iban":
                ends, others = iban_ends(found)
                if not country_iban_later(found, part, start):
                    ends = ends + others
            for end in ends:
                made = MAKERS[kind](f, found[:end], back)
                if made is not None:
                    break
            if made is None:
                # another value may start inside what was matched
                pos = start + 1
                odd_from = max(odd_from, m.end()) if kind == "card" else odd_from
                continue
            counts["date" if kind in ("iso", "dmy") else kind] += 1
            out += [part[at:start], made]
            at = pos = start + end
        return "".join([*out, part[at:]])

    if "@" not in text:
        return numbers(text), counts
    out, at = [], 0
    for m in EMAIL.finditer(text):
        out += [numbers(text[at : m.start()]), of_email(m)]
        at = m.end()
    return "".join([*out, numbers(text[at:])]), counts


DIGIT = re.compile(r"\d")


def pseudonymise_table(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in its whole texts and ``n_<kind>`` counts.

    A null text stays null with counts of 0, an empty one stays empty; repeated
    rows get equal results; an empty table gives an empty result. Columns named
    like a count are replaced, others are kept. With ``back`` the pseudonyms of
    the same key are turned back (dates with one-digit days come back with two; a
    card or account number whose pseudonym validates together with a number beside
    it may be read otherwise and not come back).
    """
    added = [f"n_{k}" for k in KINDS]
    docs = docs.drop(*added)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in added]])
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for x in batch.column(at):
                new, found = pseudonymise(x.as_py(), f, back) if x.is_valid else (None, dict.fromkeys(KINDS, 0))
                texts.append(new)
                for k in KINDS:
                    counts[k].append(found[k])
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(counts[k], pa.int64()) for k in KINDS]], schema.fieldNames())

    return docs.mapInArrow(run, schema)
