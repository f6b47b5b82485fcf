"""Format-preserving pseudonyms for personal data: validated values are permuted by a keyed Feistel network.

Each kind of value is a finite set of a format (all card numbers of 16 digits with a valid check digit, all days of
two centuries, ...), and its pseudonym another member of that set. The map is a permutation that depends on the key
and the format only, so equal values get equal pseudonyms in all documents without any table being kept or
shared, and different values never meet. Whoever holds the key can invert it; it must be kept as a secret.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of the network (as the published format-preserving modes use).
ROUNDS = 10
#: Days that count as dates.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
#: Lengths of international bank account numbers by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
KINDS = ("email", "iban", "date", "card", "ssn", "ip", "phone", "secret")

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})@([A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8})\.([A-Za-z]{2,24})(?![A-Za-z0-9-])")
#: Kind and shape, in the order in which they are tried at a place.
SHAPES = (
    ("iban", r"[A-Za-z]{2}[0-9]{2}(?:[ ]?[A-Za-z0-9]{4}){2,7}(?:[ ]?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ymd", r"[0-9]{4}(?P<ymd_mark>[-/.])[0-9]{1,2}(?P=ymd_mark)[0-9]{1,2}(?![0-9]|[-/.][0-9])"),
    ("dmy", r"[0-9]{1,2}(?P<dmy_mark>[-/.])[0-9]{1,2}(?P=dmy_mark)[0-9]{4}(?![0-9]|[-/.][0-9])"),
    ("ip", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9])"),
    ("secret", r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"),
    ("card", r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    ("local", r"\([0-9]{3}\)[ ]?[0-9]{3}[-. ][0-9]{4}(?![0-9])"),
)
SHAPE = {kind: re.compile(r"(?<![A-Za-z0-9])" + shape) for kind, shape in SHAPES}
NUMERIC = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(shape for _, shape in SHAPES) + ")")
KIND_OF = {"ymd": "date", "dmy": "date", "local": "phone"}
#: A number of the North American plan is complete with these digits.
TEN_DIGITS = re.compile(r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
#: Digits by group as cards are printed, the longest first; without blanks any length will do.
CARD_GROUPS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 3), (4, 6, 4), (4, 4, 4, 2), (4, 4, 4, 1))
DIGITS = re.compile(r"[0-9]+")
#: What goes on after a digit as one number, date or address.
GOES_ON = re.compile(r"[-./:][0-9]")


class Feistel:
    """Keyed permutations of 0 .. n - 1."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, value: int, size: int) -> int:
        data = b"%s|%d|%d|%d" % (tweak, size, i, value)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=(size.bit_length() + 7) // 8 + 8).digest(), "big") % size

    def permute(self, value: int, n: int, tweak: bytes, inverse: bool = False) -> int:
        """Unbalanced network over pairs (x, y) with x < a, y < b, a b >= n; walks on while outside 0 .. n - 1."""
        if n < 2:
            return value
        a = 1 << ((n - 1).bit_length() + 1) // 2
        b = -(-n // a)
        order = range(ROUNDS)
        while True:
            x, y = value % a, value // a
            for i in reversed(order) if inverse else order:
                sign = -1 if inverse else 1
                if i % 2:
                    y = (y + sign * self._round(tweak, i, x, b)) % b
                else:
                    x = (x + sign * self._round(tweak, i, y, a)) % a
            value = y * a + x
            if value < n:
                return value


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _luhn_digit(front: str) -> str:
    return next(c for c in "0123456789" if luhn(front + c))


def _laid(pattern: str, characters: Iterator[str], where: Callable[[str], bool]) -> str:
    """`pattern` with the characters that `where` picks replaced in order."""
    return "".join(next(characters) if where(c) else c for c in pattern)


class Pseudonyms:
    """Validation of each kind, and its permutation. None means the value is no member of the kind."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.feistel, self.inverse = Feistel(key), inverse

    def _walk(self, value: int, n: int, tweak: str) -> int:
        return self.feistel.permute(value, n, tweak.encode(), self.inverse)

    def _digits(self, digits: str, tweak: str) -> str:
        return str(self._walk(int(digits), 10 ** len(digits), f"{tweak}{len(digits)}")).zfill(len(digits)) if digits else ""

    def _letters(self, text: str, tweak: str) -> str:
        """Letters among letters, digits among digits; place and case stay."""
        low = text.lower()
        letters = [ord(c) - 97 for c in low if "a" <= c <= "z"]
        number = 0
        for v in letters:
            number = number * 26 + v
        number = self._walk(number, 26 ** len(letters), f"{tweak}:{len(letters)}") if letters else 0
        fresh = []
        for _ in letters:
            number, v = divmod(number, 26)
            fresh.append(chr(97 + v))
        out = iter(fresh[::-1])
        mixed = "".join((next(out).upper() if c.isupper() else next(out)) if c.isascii() and c.isalpha() else c for c in text)
        digits = "".join(c for c in low if "0" <= c <= "9")
        return _laid(mixed, iter(self._digits(digits, tweak + "#")), lambda c: "0" <= c <= "9")

    def email(self, local: str, domain: str, top: str) -> str:
        return f"{self._letters(local, 'local')}@{self._letters(domain, 'domain')}.{top}"

    def date(self, text: str, day_first: bool) -> str | None:
        parts = re.split(r"([-/.])", text)
        mark, numbers = parts[1], [int(x) for x in parts[::2]]
        orders = ((2, 1, 0), (2, 0, 1)) if day_first else ((0, 1, 2),)  # day before month where both would do
        for order in orders:
            try:
                day = datetime.date(*(numbers[k] for k in order))
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                continue
            # Month-first is read only where the day is over 12, and its pseudonym must be so too: such days are permuted
            # among themselves, in every order of the fields, so that a day has one pseudonym however it is written.
            members = _days(day.day > 12)
            fresh = members[self._walk(bisect.bisect_left(members, day), len(members), f"date{day.day > 12}")]
            fields = [0, 0, 0]
            for k, v in zip(order, (fresh.year, fresh.month, fresh.day)):
                fields[k] = v
            padded = any(len(x) == 2 and x[0] == "0" for x in parts[::2]) or all(len(x) > 1 for x in parts[::2])
            return mark.join(str(v).zfill(4 if k == order[0] else 2 if padded else 1) for k, v in enumerate(fields))
        return None

    def card(self, text: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", text)
        if not 13 <= len(digits) <= 19 or not luhn(digits):
            return None
        front = self._digits(digits[:-1], "card")
        return _laid(text, iter(front + _luhn_digit(front)), str.isdigit)

    def ssn(self, text: str) -> str | None:
        area, group, serial = (int(x) for x in text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        row = area - 1 - (area > 666)
        value = self._walk((row * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        value, serial = divmod(value, 9999)
        row, group = divmod(value, 99)
        area = row + 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, text: str) -> str | None:
        try:
            value = int(ipaddress.IPv4Address(".".join(str(int(x)) for x in text.split("."))))
        except ValueError:
            return None
        return str(ipaddress.IPv4Address(self._walk(value, 1 << 32, "ip")))

    def phone(self, text: str) -> str | None:
        code = re.match(r"\+[0-9]{1,3}|", text)[0]
        digits = re.sub(r"[^0-9]", "", text[len(code) :])
        if not 6 <= len(digits) <= 14:
            return None
        return code + _laid(text[len(code) :], iter(self._digits(digits, "phone" + code)), str.isdigit)

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "").upper()
        if IBAN_LENGTHS.get(plain[:2]) != len(plain) or not plain.isalnum() or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        bank = self._letters(plain[4:], "iban" + plain[:2])
        fresh = plain[:2] + f"{98 - _mod97(bank + plain[:2] + '00'):02d}" + bank
        out = _laid(text.upper(), iter(fresh), str.isalnum)
        return out.lower() if text.islower() else out

    def secret(self, text: str) -> str | None:
        if text.isdigit():
            return None
        fresh = format(self._walk(int(text, 16), 16 ** len(text), f"hex{len(text)}"), f"0{len(text)}x")
        return fresh.upper() if text.isupper() else fresh

    def value_at(self, text: str, start: int, kinds: Iterable[str] = tuple(SHAPE)) -> tuple[int, str, str] | None:
        """(end, kind, pseudonym) of the value that begins at `start`: the first kind and end that are valid.

        Shapes run over blanks into what follows, so the ends within a match are tried as well, complete forms first.
        """
        for kind in kinds:
            if m := SHAPE[kind].match(text, start):
                for end in self._ends(kind, text, start, m.end()):
                    value = text[start:end]
                    fresh = self.date(value, kind == "dmy") if kind in ("ymd", "dmy") else getattr(self, KIND_OF.get(kind, kind))(value)
                    if fresh is not None:
                        return end, KIND_OF.get(kind, kind), fresh
        return None

    def _ends(self, kind: str, text: str, start: int, last: int) -> list[int]:
        """Where a value of this kind that begins at `start` may end, up to `last`, in the order to try."""
        if kind == "iban":  # its country says how long it is
            places = [i for i in range(start, last) if text[i] != " "][: IBAN_LENGTHS.get(text[start : start + 2].upper(), 0)]
            return [places[-1] + 1] if places and not text[places[-1] + 1 : places[-1] + 2].isalnum() else []
        if kind not in ("card", "phone"):
            return [last]
        ends = [e for e in range(last - 1, start, -1) if text[e - 1] in "0123456789)" and text[e] not in "0123456789)" and not GOES_ON.match(text, e)]
        if kind == "phone":
            if m := TEN_DIGITS.match(text, start):
                return [m.end(), last]
            ends = [e for e in ends if SHAPE[kind].fullmatch(text, start, e)]
            others = [k for k in SHAPE if k != "phone"]
            parted = [e for e in reversed(ends) if text[e] == " " and self.value_at(text, e + 1, others)]
            return [*parted, last, *ends]
        further = (s for s in range(start + 1, last) if text[s - 1] in " -")
        if any(self.card(text[s:e]) for s in further for e in _printed(text, s)):  # then only a printed form will do here
            return _printed(text, start)
        return [*_printed(text, start), last, *ends]

    def found(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of every value, by place; values do not overlap."""
        out = []
        if "@" in text:
            out = [(*m.span(), "email", self.email(*m.groups())) for m in EMAIL.finditer(text)]
        taken = [(a, b) for a, b, _, _ in out]
        at = 0
        while m := NUMERIC.search(text, at):
            value = self.value_at(text, m.start())
            if value is not None and not any(a < value[0] and m.start() < b for a, b in _near(taken, m.start())):
                out.append((m.start(), *value))
                at = value[0]
            else:  # no valid value begins here: one may further on
                at = m.start() + 1
                while at < len(text) and text[at].isalnum() and text[at - 1].isalnum():
                    at += 1
        return sorted(out)


def _printed(text: str, start: int) -> list[int]:
    """Ends of what is grouped like a card from `start` on, with one mark between all groups."""
    groups = [m.span() for m in itertools.islice(DIGITS.finditer(text, start), 5)]
    out = [b for a, b in groups[:1] if 13 <= b - a <= 19]
    for form in CARD_GROUPS:
        some = groups[: len(form)]
        marks = {text[a:b] for (_, a), (b, _) in zip(some, some[1:])}
        if tuple(b - a for a, b in some) == form and marks in ({" "}, {"-"}):
            out.append(some[-1][1])
    return out


def _near(taken: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
    """The span that begins last before `at`, or there, and the next one."""
    k = max(0, bisect.bisect_right(taken, (at, 1 << 60)) - 1)
    return taken[k : k + 2]


_DAYS: dict[bool, list[datetime.date]] = {}


def _days(late: bool) -> list[datetime.date]:
    """Days of all months over 12, or up to it."""
    if late not in _DAYS:
        every = (FIRST_DAY + datetime.timedelta(k) for k in range((LAST_DAY - FIRST_DAY).days + 1))
        _DAYS[late] = [d for d in every if (d.day > 12) == late]
    return _DAYS[late]


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def pseudonymise(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """doc_id, text, n_values, kinds, spans for each row of `docs`.

    text has every valid value replaced by its pseudonym; spans lists start, end (characters of the original),
    kind and pseudonym; kinds is the distinct kinds, sorted and comma-joined. Look-alikes that fail validation
    stay. `key` has no default: who holds it can go back, with `inverse`. Days keep to one side of the 12th of a month,
    since dates that could be read two ways must be read as before. An empty table gives an empty result. Null texts count as empty; repeated rows and
    null ids pass through; other columns are ignored. Rows are independent: nothing is shuffled.
    """
    import pyarrow as pa

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_values", pa.int64()), ("kinds", pa.string()), ("spans", span)])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, inverse)
        for batch in batches:
            texts, counts, kinds, spans = [], [], [], []
            for cell in batch.column("text"):
                text = cell.as_py() or ""
                got = names.found(text)
                pieces, at = [], 0
                for a, b, _, fresh in got:
                    pieces += [text[at:a], fresh]
                    at = b
                texts.append("".join(pieces) + text[at:] if got else text)
                counts.append(len(got))
                kinds.append(",".join(sorted({k for _, _, k, _ in got})))
                spans.append([{"start": a, "end": b, "kind": k, "pseudonym": p} for a, b, k, p in got])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(spans, span)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, text string, n_values long, kinds string, spans array<struct<start:int,end:int,kind:string,pseudonym:string>>"
    )
