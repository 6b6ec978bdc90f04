"""Format-preserving pseudonyms for personal numbers, dates, addresses and keys in texts.

A value is found by pattern and checked (Luhn, mod 97, calendar, octets). What may vary of it is read
as one number, which a keyed Feistel network permutes within the numbers of that format (walking on
while the result falls outside), and written back in the same format with new check digits. The same
key maps equal values to equal pseudonyms in every document, whatever stands beside them and in whatever
layout they are written (digits of cards and telephone numbers, days, IBANs with and without blanks, mail
names in any case). With the key, and the spans that say where pseudonyms stand, the way back is exact.
"""

from __future__ import annotations

import re
import string
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, without

OUT = ["n_values", "spans"]
ROUNDS = 8
SPANS = T.ArrayType(
    T.StructType().add("start", "integer").add("end", "integer").add("kind", "string").add("pseudonym", "string")
)
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
Rule = Callable[[str, bytes, bool], str | None]
CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)


# ---------------------------------------------------------------- permutation

def feistel(number: int, size: int, key: bytes, tweak: str, inverse: bool = False, valid: Callable[[int], bool] | None = None) -> int:
    """Keyed permutation of 0 .. ``size`` - 1, or of those numbers among them that are ``valid``."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    octets = (half + 7) // 8

    def scramble(turn: int, x: int) -> int:
        data = turn.to_bytes(1, "big") + x.to_bytes(octets, "big") + f"{size}|{tweak}".encode()
        out = b""
        while len(out) < octets:
            out += blake2b(data + len(out).to_bytes(4, "big"), key=key, digest_size=32).digest()
        return int.from_bytes(out[:octets], "big") & low

    while True:
        a, b = number >> half, number & low
        for turn in range(ROUNDS):
            if inverse:
                a, b = b ^ scramble(ROUNDS - 1 - turn, a), a
            else:
                a, b = b, a ^ scramble(turn, b)
        number = a << half | b
        if number < size and (valid is None or valid(number)):
            return number


def _class(char: str) -> str | None:
    return next((c for c in CLASSES if char in c), None)


@lru_cache(4096)
def _letters(char: str) -> str | None:
    """The class of a character; beyond ASCII: letters or digits of its category among the 256 characters around."""
    if char.isascii() or not (char.isalpha() or char.isdecimal()):
        return _class(char)
    block, category = ord(char) & ~255, unicodedata.category(char)
    return "".join(c for c in map(chr, range(max(block, 128), block + 256)) if unicodedata.category(c) == category)


def permute_text(
    text: str, key: bytes, tweak: str, inverse: bool = False, valid: Callable[[str], bool] | None = None, kind: Callable[[str], str | None] = _class
) -> str:
    """Permute digits among digits and ASCII letters among letters of their case; all else stays.

    ``kind`` gives the characters that a character is permuted among (default: as said).
    """
    form = "".join({string.digits: "9", CLASSES[1]: "a", CLASSES[2]: "A"}.get(c, c[0]) if (c := kind(x)) else x for x in text)
    number, size = 0, 1
    for x in text:
        if c := kind(x):
            number, size = number * len(c) + c.index(x), size * len(c)

    def spell(n: int) -> str:
        out = []
        for x in reversed(text):
            if c := kind(x):
                n, at = divmod(n, len(c))
                x = c[at]
            out.append(x)
        return "".join(reversed(out))

    if size == 1:
        return text
    return spell(feistel(number, size, key, f"{tweak}|{form}", inverse, valid and (lambda n: valid(spell(n)))))


# ---------------------------------------------------------------- kinds

def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in string.digits)


def _refill(text: str, digits: str) -> str:
    given = iter(digits)
    return "".join(next(given) if c in string.digits else c for c in text)


def is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1


def card(text: str, key: bytes, inverse: bool) -> str | None:
    if not is_card(text):
        return None
    body = permute_text(_digits(text)[:-1], key, "card", inverse, lambda d: len(set(d)) > 1)
    return _refill(text, body + next(c for c in string.digits if luhn(body + c)))


def issued(digits: str) -> bool:
    """Does a number begin, and is it as long, as an issuer's?"""
    return any(low <= digits[: len(low)] <= high and len(digits) in lengths for low, high, lengths in ISSUERS)


def card_spans(text: str, start: int, end: int, usual: bool) -> list[tuple[int, int]]:
    """Parts of a run of digit groups that have 13 to 19 digits and begin and end with a group.

    The usual layouts (one group, 4-4-4-4, then 4-6-5) from left to right, or all others, longest first;
    of either, parts that look like an issuer's number come before the rest.
    """
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    last = len(groups) - 1
    first = 0 if start == 0 or not re.match(r"[\w.-]", text[start - 1]) else 1
    final = last if end == len(text) or not re.match(r"[\w-]", text[end]) else last - 1
    out = []
    for i in range(first, final + 1):
        sizes: tuple[int, ...] = ()
        digits = ""
        for j in range(i, final + 1):
            sizes += (groups[j][1] - groups[j][0],)
            digits += text[slice(*groups[j])]
            if (n := len(digits)) > 19:
                break
            if n >= 13 and usual == (len(sizes) == 1 or sizes in LAYOUTS):
                out.append((not issued(digits), sizes == LAYOUTS[1] if usual else -n, groups[i][0], groups[j][1]))
    return [part[2:] for part in sorted(out)]


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def is_iban(text: str) -> bool:
    return iban_number(text) % 97 == 1


def iban(text: str, key: bytes, inverse: bool) -> str | None:
    """Blanks stay where they are."""
    plain = text.replace(" ", "")
    if not is_iban(plain):
        return None
    body = permute_text(plain[4:], key, f"iban|{plain[:2]}", inverse)
    given = iter(f"{plain[:2]}{98 - iban_number(plain[:2] + '00' + body) % 97:02d}{body}")
    return "".join(c if c == " " else next(given) for c in text)


def iban_ends(text: str) -> list[int]:
    """Where an IBAN that begins ``text``, groups with single blanks between, can end, best first.

    The country's length counts, or, where that isn't known, all lengths in groups of four, longest
    first; then an unbroken run of any length.
    """
    groups = text.split(" ")
    length, out, n, at = IBAN_LENGTHS.get(text[:2]), [], 0, -1
    for group in groups:
        n, at = n + len(group), at + 1 + len(group)
        if n == length or (length is None and 15 <= n <= 34 and len(group) <= 4):
            out.append(at)
        if length is None and len(group) != 4:
            break
    out.reverse()
    run = len(groups[0])
    return out if not 15 <= run <= 34 or run in out else [*out, run]


def spaced_iban(text: str, key: bytes, inverse: bool) -> tuple[int, str] | None:
    """Length and pseudonym of the IBAN that begins ``text``."""
    for end in iban_ends(text):
        if (new := iban(text[:end], key, inverse)) is not None:
            return end, new
    return None


def _social(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def social(text: str, key: bytes, inverse: bool) -> str | None:
    digits = _digits(text)
    return _refill(text, permute_text(digits, key, "social", inverse, _social)) if _social(digits) else None


def calling_code(digits: str) -> int:
    """How many digits the country code of an international number has."""
    return 1 if digits[:1] in CODES_OF_ONE else 2 if digits[:2] in CODES_OF_TWO else 3


def phone(text: str, key: bytes, inverse: bool) -> str | None:
    """The national digits are permuted, whatever the layout; a country code stays."""
    digits = _digits(text)
    if not 8 <= len(digits) <= 15:
        return None
    code = calling_code(digits) if text[0] == "+" else 0
    return _refill(text, digits[:code] + permute_text(digits[code:], key, "phone", inverse))


def address(text: str, key: bytes, inverse: bool) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    number = feistel(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, "address", inverse)
    return ".".join(map(str, number.to_bytes(4, "big")))


def day(text: str, key: bytes, inverse: bool, width: int = 2) -> str | None:
    """A date from 1900 to 2099, year first, day first, or (only where that is no date) month first.

    One day has one pseudonym in the first two forms; the third form keeps to days that only it can write.
    Days and months are written with at least ``width`` digits.
    """
    mark = next(c for c in text if c not in string.digits)
    parts = text.split(mark)
    forms = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for form in forms:
        try:
            given = date(*(int(parts[k]) for k in form)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= given <= LAST_DAY:
            return None
        month_first = form == (2, 0, 1)
        valid = (lambda n: date.fromordinal(FIRST_DAY + n).day > 12) if month_first else None
        number = feistel(given - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "month first" if month_first else "day", inverse, valid)
        new = date.fromordinal(FIRST_DAY + number)
        out = [""] * 3
        for k, value, digits in zip(form, (new.year, new.month, new.day), (4, width, width)):
            out[k] = f"{value:0{digits}d}"
        return mark.join(out)
    return None


def short_day(text: str, key: bytes, inverse: bool) -> str | None:
    """A date without leading zeros, linked with the same day written with them."""
    return day(text, key, inverse, 1)


def email(text: str, key: bytes, inverse: bool) -> str | None:
    """The part before the @ is permuted as in lower case, letters beyond ASCII among like ones; the domain and the case of ASCII letters stay."""
    name, domain = text.split("@")
    folded = "".join(c.lower() if c.isascii() else c for c in name)
    new = permute_text(folded, key, f"email|{domain.lower()}", inverse, kind=_letters)
    return "".join(n.upper() if c.isascii() and c.isupper() else n for c, n in zip(name, new)) + f"@{domain}"


def access_key(text: str, key: bytes, inverse: bool) -> str | None:
    return text[:4] + permute_text(text[4:], key, "access key", inverse)


def secret(text: str, key: bytes, inverse: bool) -> str | None:
    return permute_text(text, key, "secret", inverse)


MARKS = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c) in ("Mn", "Mc"))  # accents of letters before them
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 "
        "GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 "
        "MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 "
        "TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
GROUP = re.compile(r"[0-9]+")
CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
LAYOUTS = ((4, 4, 4, 4), (4, 6, 5))
# First and last prefix of card issuers, and the lengths of their numbers.
ISSUERS = [
    ("300", "305", range(14, 20)), ("34", "34", (15,)), ("3528", "3589", range(16, 20)), ("36", "36", range(14, 20)), ("37", "37", (15,)),
    ("38", "39", range(14, 20)), ("4", "4", (13, 16, 19)), ("50", "50", range(13, 20)), ("51", "55", (16,)), ("56", "58", range(13, 20)),
    ("6", "6", range(13, 20)), ("2200", "2204", range(16, 20)), ("2221", "2720", (16,)),
]
# Country calling codes of one and of two digits; all others have three.
CODES_OF_ONE = ("1", "7")
CODES_OF_TWO = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()

# Kinds in order of precedence where matches overlap: name, a lower-case text that must occur (None: a
# digit), pattern (group 1, if any, is the value), rule.
KINDS = [
    ("email", "@", re.compile(rf"(?<![\w{MARKS}.%+-])[\w{MARKS}.%+-]++@(?:[\w{MARKS}-]+\.)+[^\W\d_]{{2,}}(?![\w-])"), email),
    ("access_key", "akia", re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"), access_key),
    ("secret", "password", re.compile(r"(?i:password)\s*[=:]\s*[\"']?([A-Za-z0-9]{8,})"), secret),
    ("secret", "token", re.compile(r"(?i:token)\s*[=:]\s*[\"']?([A-Za-z0-9]{16,})"), secret),
    ("iban", None, re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])))"), iban),
    ("card", None, CARD_RUN, card),
    ("phone", None, re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"), phone),
    ("phone", "-", re.compile(r"(?<![\w+.-])\d{3}-\d{3}-\d{4}(?![\w-])"), phone),
    ("phone", ".", re.compile(r"(?<![\w+.-])\d{3}\.\d{3}\.\d{4}(?![\w-]|\.\d)"), phone),
    ("phone", "+", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\w)"), phone),
    ("social", "-", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), social),
    ("date", None, re.compile(r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2})(?![\d-])"), day),
    ("date", None, re.compile(r"(?<![\w.-])(?:\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})(?![\d-])"), day),
    ("short date", None, re.compile(r"(?<![\w./-])\d{4}([-/])(?:[1-9]\1[1-9]\d?|[1-9]\d\1[1-9])(?![\d/-])"), short_day),
    ("address", ".", re.compile(r"(?<![\w.-])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w-]|\.\d)"), address),
    ("card", None, CARD_RUN, card),  # unusual layouts
]
DIGIT = re.compile(r"[0-9]")
RULES = {kind: rule for kind, _, _, rule in KINDS}


def find(text: str, key: bytes, inverse: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of every checked value, in order and without overlaps.

    A pseudonym follows from the value and the key alone. A card beside other numbers is one of several
    parts of a run of digits; which of them is taken follows from the layout and the issuer's prefix.
    """
    taken: list[tuple[int, int, str, str]] = []
    digit = DIGIT.search(text)
    lower = text.lower()

    def take(a: int, b: int, kind: str, rule: Rule) -> None:
        n = bisect_left(taken, (a,))
        if (n == 0 or taken[n - 1][1] <= a) and (n == len(taken) or b <= taken[n][0]) and (new := rule(text[a:b], key, inverse)) is not None:
            taken.insert(n, (a, b, kind, new))

    for rank, (kind, must, pattern, rule) in enumerate(KINDS):
        if not (digit if must is None else must in lower):
            continue
        for m in pattern.finditer(text):
            if kind == "card":
                for a, b in card_spans(text, *m.span(), usual=rank < len(KINDS) - 1):
                    take(a, b, kind, rule)
            elif kind == "iban":
                if (hit := spaced_iban(m[1], key, inverse)) is not None:
                    take(m.start(1), m.start(1) + hit[0], kind, rule)
            else:
                take(*m.span(1 if kind == "secret" else 0), kind, rule)
    return taken


def pseudonymise(text: str, key: bytes, inverse: bool = False) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with all values replaced, and where they stood."""
    found, out, at = find(text, key, inverse), [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), found


def restore(text: str, spans: list[tuple[int, int, str, str]], key: bytes) -> str:
    """The text that ``pseudonymise`` was given, from what it returned. Exact whatever stands beside a value."""
    out, at, shift = [], 0, 0
    for a, b, kind, new in spans:
        out += [text[at : a + shift], RULES[kind](new, key, True)]
        at = a + shift + len(new)
        shift += len(new) - (b - a)
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- operator

def replace_private(df: DataFrame, key: bytes, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """All rows and columns of ``df`` with the text's values replaced, plus n_values and spans
    (start, end in the given text, kind, pseudonym).

    Null texts stay null without values; texts are read whole and rows never meet, so ties and
    repeated rows get equal results. ``inverse`` turns a result of this function back with the same key:
    the texts where ``spans`` says (null spans: none), less the two added columns. Input columns named
    like an output column are replaced. An empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    base = without(df, OUT)
    if inverse:
        return _restored(df, base.columns, key, text_col)
    names = base.columns
    at = [n.lower() for n in names].index(text_col.lower())
    schema = T.StructType([*base.schema.fields, T.StructField("n_values", T.IntegerType()), T.StructField("spans", SPANS)])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, spans = [], [], []
            for value in batch.column(at):
                text = value.as_py()
                new, found = pseudonymise(text, key) if text else (text, [])
                texts.append(new)
                counts.append(len(found))
                spans.append([dict(zip(("start", "end", "kind", "pseudonym"), f)) for f in found])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            added = [pa.array(counts, pa.int32()), pa.array(spans, spans_type)]
            yield pa.RecordBatch.from_arrays([*columns, *added], [*names, "n_values", "spans"])

    return base.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def _restored(df: DataFrame, names: list[str], key: bytes, text_col: str) -> DataFrame:
    at = [n.lower() for n in names].index(text_col.lower())
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)[:-1]
            spans = ([tuple(s.values()) for s in found or ()] for found in batch.column(len(names)).to_pylist())
            texts = [text and restore(text, found, key) for text, found in zip(columns[at].to_pylist(), spans)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, T.StructType(rows.schema.fields[:-1]))
