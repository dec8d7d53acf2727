"""Pseudonyms for personal data that keep its format.

Numbers and dates are found by pattern and validated (check digits, ranges, the calendar); what passes is permuted
within the set of all values of its format by a Feistel network under a secret key. The permutation depends on the
kind and the number of characters only, never on the document or the separators, so equal values stay equal in every
document, and different ones stay different. Check digits are computed anew, so a pseudonym is as valid as its value.

A date moves among those whose day and month are written with as many digits and read in the same order, so the same
date keeps its link whether it is written year first, day first or month first, with or without leading noughts.

A match may have swallowed a neighbour (an expiry date behind a card, a word behind an IBAN). One that fails validation
is tried again without its last groups, the longest first, and then from its next group on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from cartulary.llm.shared import table, with_columns

ROUNDS = 8
#: The country codes of two digits (ITU E.164). 1 and 7 are codes of one digit, all others have three.
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: For tests and the registered query only; a deployment passes its own.
EXAMPLE_KEY = b"an example key, not a secret"
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on the next even number of bits, walked until
    the result is in range (four steps are expected at most)."""
    half = max((size - 1).bit_length() + 1, 2) // 2
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            data = b"%d|%s|%d|" % (i, tweak.encode(), size) + right.to_bytes(width, "little")
            mixed = int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=min(width, 56) + 8).digest(), "little") & mask
            left, right = right, left ^ mixed
        value = left << half | right
        if value < size:
            return value


def _radixed(characters: str, key: bytes, tweak: str) -> str:
    """ASCII letters and digits permuted together, each within its own class; others stay in their places."""
    bases = [(10, 48) if "0" <= c <= "9" else (26, 97) if "a" <= c <= "z" else (26, 65) if "A" <= c <= "Z" else (1, ord(c)) for c in characters]
    value, size = 0, 1
    for (base, first), c in zip(bases, characters, strict=True):
        value, size = value * base + ord(c) - first, size * base
    if size == 1:
        return characters
    value, out = feistel(value, size, key, tweak), []
    for base, first in reversed(bases):
        value, digit = divmod(value, base)
        out.append(chr(first + digit))
    return "".join(reversed(out))


def _into(shape: str, digits: str) -> str:
    """The digits of ``shape`` replaced, in order, by ``digits``."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def _card(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    if luhn(digits) or not digits.strip("0"):
        return None
    body = _radixed(digits[:-1], key, "card")
    return _into(text, body + str(-luhn(body + "0") % 10))


def _iban(text: str, key: bytes) -> str | None:
    flat = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _radixed(flat[4:], key, "iban")
    made = flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body
    left = iter(made)
    return "".join(c if c == " " else next(left) for c in text)


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    value = feistel(int.from_bytes(bytes(parts), "big"), 2**32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(text: str, key: bytes) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = _digits(text)
    if not valid(digits):
        return None
    while True:  # walks the permutation until the pseudonym is valid too
        digits = _radixed(digits, key, "ssn")
        if valid(digits):
            return _into(text, digits)


def _country(digits: str) -> int:
    """The length of the country code that a number in international form begins with."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGITS else 3


def _phone(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    if not 7 <= len(digits) <= 15:
        return None
    country = _country(digits) if text[0] == "+" else 0
    return _into(text, digits[:country] + _radixed(digits[country:], key, "phone"))


def _kind_of(day: date) -> tuple[int, bool]:
    """How a date can be written: its day has one digit, two but could be a month, or two and could not; its month has
    one digit or two."""
    return (day.day > 9) + (day.day > 12), day.month > 9


@lru_cache(maxsize=1)
def _calendar() -> tuple[dict[tuple[int, bool], list[int]], list[int]]:
    """The days of each kind, and each day's place among those of its kind."""
    days: dict[tuple[int, bool], list[int]] = {}
    places = []
    for n in range(FIRST_DAY, LAST_DAY + 1):
        of_kind = days.setdefault(_kind_of(date.fromordinal(n)), [])
        places.append(len(of_kind))
        of_kind.append(n)
    return days, places


def _date(text: str, key: bytes) -> str | None:
    iso = re.fullmatch(r"(\d{4})(-)(\d\d)-(\d\d)", text)
    found = iso or re.fullmatch(r"(\d{1,2})([./-])(\d{1,2})\2(\d{4})", text)
    order = (1, 3, 4) if iso else (4, 3, 1) if int(found[3]) <= 12 else (4, 1, 3)  # of year, month and day
    try:
        day = date(*(int(found[i]) for i in order))
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    days, places = _calendar()
    own, kind = days[_kind_of(day)], _kind_of(day)
    new = date.fromordinal(own[feistel(places[day.toordinal() - FIRST_DAY], len(own), key, f"date {kind[0]} {kind[1]:d}")])
    parts = dict(zip(order, (new.year, new.month, new.day), strict=True))
    return found[2].join(str(parts[i]).zfill(len(found[i])) for i in sorted(parts))


def _email(text: str, key: bytes) -> str | None:
    local, at, domain = text.rpartition("@")
    return _radixed(local, key, "email") + at + domain


#: The kinds in order of precedence, their patterns, and how a match is validated and replaced.
KINDS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4})(?![0-9]|[./-][0-9])", _date),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    # Cards grouped as they are printed come first, so that no number beside one takes a part of it.
    (
        "card",
        r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{13,19})(?![0-9])",
        _card,
    ),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", _card),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    (
        "phone",
        r"(?<![0-9+])(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}"
        r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
        _phone,
    ),
)
_PATTERNS = [(kind, re.compile(pattern), replace) for kind, pattern, replace in KINDS]
#: What may part the groups of a value, by kind.
_BORDERS = {"card": re.compile("[ -]"), "iban": re.compile(" "), "phone": re.compile("[ .()-]")}
#: Whatever has none of these has no match of any kind.
_ANY = re.compile("[0-9@]")


def _values(kind: str, pattern: re.Pattern, replace: Callable[[str, bytes], str | None], text: str, key: bytes, taken: bytearray):
    """(start, end, pseudonym) of the values of a kind: of each match the longest prefix that is valid and not taken."""
    borders, at = _BORDERS.get(kind), 0
    while m := pattern.search(text, at):
        a, b = m.span()
        ends = [b, *(x.start() for x in reversed(list(borders.finditer(text, a + 1, b))))] if borders else [b]
        at = a + 1 if borders else b  # no pattern starts within a group, so the next match is one group later
        for end in ends:
            if any(taken[a:end]) or (end < b and not pattern.fullmatch(text, a, end)):
                continue
            if (new := replace(text[a:end], key)) is not None:
                yield a, end, new
                at = end
                break


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the (start, end, kind) of each value in the text as it was."""
    if not _ANY.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind, pattern, replace in _PATTERNS:
        for a, b, new in _values(kind, pattern, replace, text, key, taken):
            taken[a:b] = b"\x01" * (b - a)
            found.append((a, b, kind, new))
    if not found:
        return text, []
    out, at = [], 0
    for a, b, _, new in sorted(found):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(a, b, kind) for a, b, kind, _ in sorted(found)]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Replaces ``text``, and adds n_values and spans (kind:start:end of each value in the original, comma-joined).

    A null text stays null with no values; repeated rows are treated alike. Other columns stay; those named n_values
    or spans are replaced. Texts of any length are searched whole; where two kinds could match, the first of ``KINDS``
    does. An empty table gives an empty one. A narrow step: nothing is shuffled.
    """
    kept = docs.drop("n_values", "spans")
    names = kept.columns

    def run(batches):
        for batch in batches:
            out = {"n_values": [], "spans": []}
            new = []
            for value in batch.column(text):
                source = value.as_py()
                made, found = (None, []) if source is None else replaced(source, key)
                new.append(made)
                out["n_values"].append(len(found))
                out["spans"].append(",".join(f"{k}:{a}:{b}" for a, b, k in found))
            at = batch.schema.get_field_index(text)
            batch = batch.set_column(at, text, pa.array(new, batch.schema.field(text).type))
            yield with_columns(batch, names, out, {"spans": pa.string()})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "n_values long, spans string"])
    return kept.mapInArrow(run, schema)


def op2_pseudonyms(spark, sf_dir: str, key: bytes = EXAMPLE_KEY) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
