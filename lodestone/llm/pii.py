"""PII: format-preserving Feistel pseudonyms.

Found values are checked (Luhn, mod 97, octets, calendar, plausible phone and id numbers) and replaced by a keyed
permutation of the same format: a card number becomes another valid card number, a date another date, an address another
address of the same shape. The permutation is a Feistel network on the format's own numbers (radix and length, or days of
1900 to 2099) with HMAC-SHA-256 rounds, so it is one-to-one: equal values keep equal pseudonyms in all documents, different
values stay different, and the key's holder can turn it back.

A format's numbers 0 .. size-1 are split as evenly as their factors allow: x = left * b + right with left < a, right < b,
a * b = size; rounds add the other half's keyed hash modulo a or b in turn. Check digits are worked out anew.

Kinds, in this order where spans overlap: e-mail addresses (letters and digits before the last dot permuted in place),
IBANs (of their country's length), cards (13 to 19 digits, Luhn), IPv4 addresses (not after "version" or the like), ISO and
day/month or month/day dates of four-digit years, US social-security numbers, phone numbers (with +, or brackets, or
separators, 10 to 15 digits). Spans are code points.

All dates are permuted alike, on along the permutation's cycle until the new date can be written in the old one's form: as
many characters in each place, and day first still seen to be day first. So a date keeps its pseudonym in all documents and
forms that set no such condition (ISO, or two characters each for day and month), and in all texts of one form otherwise.

The key is the caller's: it is a parameter without a default, and whoever has it can turn pseudonyms back.

Defined results: null text stays null; a text without such values stays as it is, byte for byte; other columns pass
through; repeated rows change alike.
"""

from __future__ import annotations

import datetime
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType

from .shared import mapped, slices, widened

ROUNDS = 10
_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST + 1

_FIND = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-]))
    |(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
    |(?P<ipv4>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\w))
    |(?P<iso>(?<![\w-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-]))
    |(?P<day>(?<![\w/.-])[0-9]{1,2}(?P<mark>[/.-])[0-9]{1,2}(?P=mark)[0-9]{4}(?![\w/-]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?!\w|-(?![0-9])))
    |(?P<phone>(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![\w-])|(?<![\w.])\+[0-9]{10,15}(?![\w]))""",
    re.X | re.A,
)
#: No value is without a digit or an at sign; texts without both are passed by.
_HINT = re.compile(r"[0-9@]")


@lru_cache(maxsize=4096)
def _halves(size: int) -> tuple[int, int]:
    """The most even factors a * b = size; radix powers are split by digits before, so sizes here are small or smooth."""
    a = int(size**0.5)
    while size % a:
        a -= 1
    return a, size // a


class Feistel:
    """Keyed permutations of the numbers below any product of two factors."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _value(self, tweak: str, turn: int, half: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tweak}|{turn}|{half}".encode(), "sha256")[:16], "big")

    def permute(self, x: int, a: int, b: int, tweak: str, back: bool = False) -> int:
        left, right = divmod(x, b)
        for turn in range(self.rounds)[:: -1 if back else 1]:
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * self._value(tweak, turn, left)) % b
            else:
                left = (left + sign * self._value(tweak, turn, right)) % a
        return left * b + right

    def digits(self, text: str, tweak: str, back: bool = False, radix: int = 10, alphabet: str = "0123456789") -> str:
        """A string over the alphabet as another of its length."""
        n = len(text)
        if not n:
            return text
        x = 0
        for c in text:
            x = x * radix + alphabet.index(c)
        a, b = _halves(radix) if n == 1 else (radix ** (n // 2), radix ** (n - n // 2))
        y = self.permute(x, a, b, f"{tweak}|{radix}|{n}", back)
        out = []
        for _ in range(n):
            y, r = divmod(y, radix)
            out.append(alphabet[r])
        return "".join(reversed(out))

    def days(self, date: datetime.date, tweak: str, back: bool = False) -> datetime.date:
        return datetime.date.fromordinal(_FIRST + self.permute(date.toordinal() - _FIRST, *_halves(_DAYS), tweak, back))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _check_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn(body + c))


def iban_ok(value: str) -> bool:
    moved = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _refit(shape: str, inner: str, kind: Callable[[str], bool]) -> str:
    """inner's characters in place of those of shape that are of the kind."""
    it = iter(inner)
    return "".join(next(it) if kind(c) else c for c in shape)


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Top-level names and the country letters of an IBAN tell the format and stay.
_CLASSES = (_LOWER, _UPPER, _DIGITS)


def _by_class(f: Feistel, text: str, tweak: str, back: bool) -> str:
    """Small letters, capitals and digits of text, each permuted as one string in its places."""
    for alphabet in _CLASSES:
        own = "".join(c for c in text if c in alphabet)
        # The shape is part of the tweak, so that equal letters in another shape map on their own.
        text = _refit(text, f.digits(own, tweak, back, len(alphabet), alphabet), lambda c, a=alphabet: c in a) if own else text
    return text


def _date(f: Feistel, y: int, m: int, d: int, fits: Callable[[datetime.date], bool], back: bool) -> datetime.date | None:
    """The next date of the permutation's cycle that fits the form, which is a permutation of the dates that fit."""
    try:
        date = datetime.date(y, m, d)
    except ValueError:
        return None
    if not _FIRST <= date.toordinal() < _FIRST + _DAYS:
        return None
    date = f.days(date, "date", back)
    while not fits(date):
        date = f.days(date, "date", back)
    return date


def pseudonym(kind: str, value: str, f: Feistel, back: bool = False) -> str | None:
    """The value's pseudonym, or None if it isn't valid for its kind."""
    only = "".join(c for c in value if c in _DIGITS)
    if kind == "email":
        head, _, top = value.rpartition(".")
        return _by_class(f, head, "email", back) + "." + top
    if kind == "iban":
        plain = value.replace(" ", "")
        if not iban_ok(plain):
            return None
        body = _by_class(f, plain[4:], "iban" + plain[:2], back)
        rest = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        return _refit(value, plain[:2] + f"{98 - rest:02d}" + body, lambda c: c != " ")
    if kind == "card":
        if not luhn(only) or len(set(only)) == 1:
            return None
        body = f.digits(only[:-1], "card", back)
        return _refit(value, body + _check_digit(body), str.isdigit)
    if kind == "ipv4":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        x = int.from_bytes(bytes(octets), "big")
        return ".".join(map(str, f.permute(x, 1 << 16, 1 << 16, "ipv4", back).to_bytes(4, "big")))
    if kind == "iso":
        new = _date(f, *map(int, value.split("-")), lambda date: True, back)
        return new and new.isoformat()
    if kind == "day":
        mark = next(c for c in value if c in "/.-")
        p, q, y = value.split(mark)
        month_first = mark == "/" and int(p) <= 12
        order = (lambda date: (date.month, date.day)) if month_first else (lambda date: (date.day, date.month))

        def fits(date: datetime.date) -> bool:
            one, two = order(date)
            # One character holds no number above 9, and a first number up to 12 would read as a month.
            return (len(p) == 2 or one < 10) and (len(q) == 2 or two < 10) and (mark != "/" or month_first or one > 12)

        m, d = (int(p), int(q)) if month_first else (int(q), int(p))
        if (new := _date(f, int(y), m, d, fits, back)) is None:
            return None
        one, two = order(new)
        return f"{one:0{len(p)}d}{mark}{two:0{len(q)}d}{mark}{new.year:04d}"
    if kind == "ssn":
        if only[:3] in ("000", "666") or only[0] == "9" or only[3:5] == "00" or only[5:] == "0000":
            return None
        area, group, serial = int(only[:3]) - 1, int(only[3:5]) - 1, int(only[5:]) - 1
        area -= area > 665
        x = f.permute((area * 99 + group) * 9999 + serial, 898 * 3, 33 * 9999, "ssn", back)
        serial, x = x % 9999, x // 9999
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        if not 10 <= len(only) <= 15:
            return None
        # The country code stays with a leading +, as far as it is set apart.
        keep = len(m[1]) if (m := re.match(r"\+([0-9]{1,3})[ .-]", value)) else 0
        return _refit(value, only[:keep] + f.digits(only[keep:], "phone" + only[:keep], back), str.isdigit)
    raise ValueError(kind)


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Characters of the shortest value of kinds whose match can run on into what follows, such as a card's expiry date.
_LEAST = {"card": 13, "iban": 15}
#: What stands before a release number that looks like an address.
_RELEASE = re.compile(r"(?:\b(?:version|release|build|rev|ver)s?|(?<![A-Za-z])v)\.?[ :=]{0,2}\Z", re.I | re.A)


def _ends(kind: str, value: str) -> Iterator[int]:
    """Where a value of the kind may end in the match: all of it, then its groups' ends, the longest first."""
    fixed = IBAN_LENGTHS.get(value[:2]) if kind == "iban" else None
    for at in range(len(value), 0, -1):
        if at == len(value) or kind in _LEAST and value[at] in " -":
            size = sum(c not in " -" for c in value[:at])
            if fixed in (None, size) and size >= _LEAST.get(kind, 0):
                yield at


def found(text: str, f: Feistel) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of every valid value, left to right."""
    out, at = [], 0
    while m := _FIND.search(text, at):
        kind, new, end = m.lastgroup if m.lastgroup != "mark" else "day", None, m.end()
        if kind != "ipv4" or not _RELEASE.search(text[max(0, m.start() - 12) : m.start()]):
            for size in _ends(kind, m[0]):
                if (new := pseudonym(kind, m[0][:size], f)) is not None:
                    end = m.start() + size
                    break
        if new is None and kind == "card" and (p := _FIND_PHONE.match(text, m.start())):
            m, end, kind, new = p, p.end(), "phone", pseudonym("phone", p[0], f)
        if new is None:
            # A value that isn't one hides no other in its first word; an address that isn't one hides none at all.
            at = m.end() if kind == "ipv4" else m.start() + max(1, len(re.match(r"\w*", m[0], re.A)[0]))
            continue
        out.append((kind, m.start(), end, new))
        at = end
    return out


_FIND_PHONE = re.compile(re.search(r"\(\?P<phone>.*", _FIND.pattern, re.S)[0], re.X | re.A)


def replaced(text: str, f: Feistel) -> tuple[str, int]:
    """The text with pseudonyms, and how many."""
    if not _HINT.search(text):
        return text, 0
    spans = found(text, f)
    parts, at = [], 0
    for _, s, e, new in spans:
        parts += [text[at:s], new]
        at = e
    return "".join([*parts, text[at:]]), len(spans)


def pseudonymised(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """docs with pseudonyms in its texts; n_chars follows where there is one; count: name of a column for their number."""
    schema = widened(docs.schema, **({count: LongType()} if count else {}))
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").to_pylist()
                new = [(None, 0) if t is None else replaced(t, f) for t in texts]
                columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                columns["text"] = pa.array([t for t, _ in new], columns["text"].type)
                if "n_chars" in kinds:
                    sizes = [n if a == b else len(b) for n, a, (b, _) in zip(columns["n_chars"].to_pylist(), texts, new)]
                    columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
                if count:
                    columns[count] = pa.array([n for _, n in new], pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return mapped(docs, run, schema)
