"""Pseudonyms for personal values in texts by keyed Feistel permutations that keep their format.

Numbers and dates are found by shape and validated (check digits, ranges, the calendar). A valid value
is an index into the set of all values of its format, and the index is permuted by an eight-round
Feistel network whose round function is keyed BLAKE2b; values outside the valid set are walked on
(cycle walking), so that the pseudonym is valid too and the map is one to one. Equal values have equal
pseudonyms in all documents, whatever their separators, and the holder of the key can invert them.

Where a match is no valid value, its readings that end at an earlier separator are tried, the longest first
(an IBAN's by its country's length before all), then those that start at a later one. In such a run a card's
groups have four digits or more, but for the last: in rows of shorter numbers some reading would always pass.
Values in such a run are walked on together until the result is read as the text was, so that the run can be
inverted; cards keep what they add to the check of a longer number, so that this is hardly ever needed.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt, prod

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "ipv4", "iban", "card", "phone", "ssn", "date", "secret")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

# A match starts and ends where a value can: not inside a longer run of the same characters.
SHAPES = re.compile(r"""
  (?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9-]))
| (?P<secret>\b(?i:token|secret|password|passwd|api_key|apikey)\s{0,3}[=:]\s{0,3}["'][^"'\s]{8,}+["']
            |(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))
| (?P<ipv4>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))
| (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9]))
| (?P<phone>(?<![\w+(])(?:(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\+\d{1,5}(?:[ .-]\d{1,4}){1,5}[ .-]\d{2,12}|\+\d{1,6}[ -]\d{5,14}|\+\d{8,15}
            |(?<![.-])\d{3}(?P<mark>[.-])\d{3}(?P=mark)\d{4})(?![\w-]|\.\d))
| (?P<ssn>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]))
| (?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?![\w/-]))
| (?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w|-(?!\d)))
""", re.VERBOSE)
REST = re.compile(r"(?P<card>\d(?:[ -]?\d){12,18}(?!\w|-(?!\d)))")  # after a hyphen inside a run of digits
GROUPED = re.compile(r"(?:\d{4,}[ -])*\d+")
CUTS = {"card": re.compile("[ -]"), "iban": re.compile(" "), "phone": re.compile("[ .-]")}  # separators inside a value
COUNTRY = re.compile(  # calling codes: a number's digits tell where its country code ends
    r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
IBAN_LENGTHS = {country: int(n) for n, countries in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC 33:RU").split())
    for country in countries.split(",")}


def permute(index: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of ``range(size)``; other tweaks give unrelated permutations."""
    if size < 2:
        return index
    half = isqrt(size - 1) + 1
    width = (half.bit_length() + 7) // 8

    def mixed(number: int, value: int) -> int:
        data = bytes([number]) + tweak + b"\0" + value.to_bytes(width, "big")
        out = hashlib.blake2b(data, key=key, digest_size=min(64, width + 8)).digest()
        while len(out) < width + 8:
            out += hashlib.blake2b(out, key=key).digest()
        return int.from_bytes(out, "big")

    while True:
        left, right = divmod(index, half)
        for number in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            sign = -1 if inverse else 1
            if number % 2:
                right = (right + sign * mixed(number, left)) % half
            else:
                left = (left + sign * mixed(number, right)) % half
        index = left * half + right
        if index < size:
            return index


def walk(index: int, size: int, valid: Callable[[int], bool], key: bytes, tweak: bytes, inverse: bool) -> int:
    """The permutation of the valid indices among ``range(size)``."""
    while True:
        index = permute(index, size, key, tweak, inverse)
        if valid(index):
            return index


CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
PART = 512  # the arithmetic on one number grows faster than its digits
HEX = (("0123456789abcdef",), ("0123456789ABCDEF",))


def permute_text(text: str, key: bytes, tweak: bytes, inverse: bool, classes: tuple[str, ...] = CLASSES) -> str:
    """Every character that is in a class becomes one of the same class; the others stay in place.

    Longer texts than ``PART`` are permuted part by part, each under a tweak of the parts before it.
    """
    if len(text) > PART:
        before, out = hashlib.blake2b(key=key), []
        for low in range(0, len(text), PART):
            part = text[low:low + PART]
            new = permute_text(part, key, tweak + b" after " + before.digest(), inverse, classes)
            before.update((new if inverse else part).encode())
            out.append(new)
        return "".join(out)
    kinds = [next((c for c in classes if x in c), "") for x in text]
    radices = [len(c) for c in kinds if c]
    index = 0
    for x, c in zip(text, kinds):
        if c:
            index = index * len(c) + c.index(x)
    shape = "".join(str(classes.index(c)) if c else x for x, c in zip(text, kinds))
    index = permute(index, prod(radices), key, tweak + shape.encode(), inverse)
    out = []
    for x, c in zip(reversed(text), reversed(kinds)):
        if c:
            index, digit = divmod(index, len(c))
            x = c[digit]
        out.append(x)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = 0
    for k, x in enumerate(reversed(digits)):
        value = int(x) * (2 - k % 2)
        total += value - 9 if value > 9 else value
    return -total % 10


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if x in "0123456789" else x for x in shape)


def only_digits(text: str) -> str:
    return "".join(x for x in text if x in "0123456789")


@dataclass(frozen=True)
class Pseudonyms:
    """Validators and permutations by kind; each gives None where the text is no valid value."""

    key: bytes
    inverse: bool = False

    def email(self, text: str) -> str | None:
        local, _, domain = text.rpartition("@")
        new = permute_text(local, self.key, b"email " + domain.lower().encode(), self.inverse)
        return f"{new}@{domain}"

    def secret(self, text: str) -> str | None:
        quote = max(text.find('"'), text.find("'")) if text[-1] in "\"'" else -1
        if quote < 0:
            return text[:4] + permute_text(text[4:], self.key, b"aws", self.inverse, (CLASSES[0] + CLASSES[2],))
        start = text.index(text[-1])
        value = text[start + 1:-1]
        classes = next((c for c in HEX if set(value) <= set(c[0])), CLASSES)
        return text[:start + 1] + permute_text(value, self.key, b"secret", self.inverse, classes) + text[-1]

    def ipv4(self, text: str) -> str | None:
        try:
            address = ipaddress.IPv4Address(text)
        except ValueError:
            return None

        def special(x: int) -> bool:  # the same for every host
            return ipaddress.IPv4Address(x).is_loopback or x in (0, (1 << 32) - 1)

        def alike(x: int) -> bool:  # public addresses stay public, others others
            return not special(x) and ipaddress.IPv4Address(x).is_global == address.is_global

        if special(int(address)):
            return None
        tweak = b"ipv4 public" if address.is_global else b"ipv4 other"
        return str(ipaddress.IPv4Address(walk(int(address), 1 << 32, alike, self.key, tweak, self.inverse)))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 != 1:
            return None
        country, body = plain[:2], permute_text(plain[4:], self.key, b"iban" + plain[:2].encode(), self.inverse)
        check = 98 - int("".join(str(int(x, 36)) for x in body + country + "00")) % 97
        new = iter(f"{country}{check:02d}{body}")
        return "".join(x if x == " " else next(new) for x in text)

    def card(self, text: str) -> str | None:
        digits = only_digits(text)
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        size = len(digits) - 2  # the first digit, which names the kind of card, and the check digit are kept apart
        tweak = f"card {len(digits)} {digits[0]}".encode()

        def varied(x: int) -> bool:
            body = digits[0] + f"{x:0{size}d}"
            # the check of a longer number around this one must come out as before
            return (len(set(body)) > 1 or luhn(body) != int(body[0])) and luhn(body + str(luhn(body))) == beyond

        beyond = luhn(digits)
        body = digits[0] + f"{walk(int(digits[1:-1]), 10 ** size, varied, self.key, tweak, self.inverse):0{size}d}"
        return refill(text, body + str(luhn(body)))

    def phone(self, text: str) -> str | None:
        digits = only_digits(text)
        kept = 0
        if text[0] == "+":  # the country code stays
            kept = len(COUNTRY.match(digits)[0])
        rest = digits[kept:]
        if len(digits) > 15 or len(rest) < 7:
            return None
        tweak = f"phone {digits[:kept]} {len(rest)}".encode()
        new = permute(int(rest), 10 ** len(rest), self.key, tweak, self.inverse)
        return refill(text, f"{digits[:kept]}{new:0{len(rest)}d}")

    def ssn(self, text: str) -> str | None:
        def valid(x: int) -> bool:
            area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0

        index = int(only_digits(text))
        if not valid(index):
            return None
        return refill(text, f"{walk(index, 10 ** 9, valid, self.key, b'ssn', self.inverse):09d}")

    def date(self, text: str) -> str | None:
        parts = re.split(r"[-/.]", text)
        year_first = len(parts[0]) == 4
        month_first = not year_first and int(parts[1]) > 12
        try:
            if year_first:
                day = datetime.date(*map(int, parts))
            elif month_first:
                day = datetime.date(int(parts[2]), int(parts[0]), int(parts[1]))
            else:
                day = datetime.date(int(parts[2]), int(parts[1]), int(parts[0]))
        except ValueError:
            return None
        new = self._day(day)
        if new is None:
            return None
        if year_first:
            return f"{new:%Y-%m-%d}"
        one, two = (new.month, new.day) if month_first else (new.day, new.month)
        mark = text[len(parts[0])]
        return f"{one:0{len(parts[0])}d}{mark}{two:0{len(parts[1])}d}{mark}{new.year}"

    def _day(self, day: datetime.date) -> datetime.date | None:
        """The same for a day in all notations; it has as many digits and can be read the same ways."""
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None

        def written(x: datetime.date) -> tuple[bool, bool, bool]:
            return x.day > 12, x.day > 9, x.month > 9

        def alike(x: int) -> bool:
            return written(datetime.date.fromordinal(FIRST_DAY + x)) == written(day)

        index = walk(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, alike, self.key, b"date", self.inverse)
        return datetime.date.fromordinal(FIRST_DAY + index)

    def _readings(self, text: str, match: re.Match, inside: bool) -> Iterator[tuple[int, str]]:
        """Where a value that starts with the match may end, and its kind; ``inside`` a run that failed before."""
        start, end, kind = match.start(), match.end(), match.lastgroup
        cuts = [start + x.start() for x in CUTS[kind].finditer(match[0])] if kind in CUTS else []
        ends = [end, *reversed(cuts)]
        if kind == "iban":
            length = IBAN_LENGTHS.get(match[0][:2])
            ends.sort(key=lambda x: len(text[start:x].replace(" ", "")) != length)
        for at in ends:
            if at == end:
                found = kind
            else:
                shorter = (REST if match.re is REST else SHAPES).match(text, start, at)
                found = shorter.lastgroup if shorter and shorter.end() == at else None
            if found and not (found == "card" and (inside or at < end) and not GROUPED.fullmatch(text, start, at)):
                yield at, found

    def _found(self, text: str, low: int, high: int) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int]]]:
        """Start, end, kind and pseudonym of the values that start in the range, and the matches that failed as wholes."""
        values, failed, within = [], [], low
        shape = SHAPES.search
        while low < high and (match := shape(text, low) or SHAPES.search(text, low)) and match.start() < high:
            start, end, shape = match.start(), match.end(), SHAPES.search
            cut = CUTS[match.lastgroup].search(text, start, end) if match.lastgroup in CUTS else None
            for at, kind in self._readings(text, match, start < within):
                if at < end and match.lastgroup == "phone" and self._card_at(text, cut.end()):
                    continue  # a card after a number with a plus
                new = getattr(self, kind)(text[start:at])
                if new is not None:
                    values.append((start, at, kind, new))
                    break
            else:
                at = cut.start() if cut else end
            if not values or values[-1][:2] != (start, end):
                failed.append((start, end))
                within = max(within, end)
            low = at
            if at < end and text[at] in " .-":
                low = at + 1
                if text[at] == "-" and match.lastgroup == "card":
                    shape = REST.match
        return values, failed

    def _card_at(self, text: str, start: int) -> bool:
        match = SHAPES.match(text, start)
        return bool(match) and any(kind == "card" and self.card(text[start:at]) for at, kind in self._readings(text, match, True))

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it held."""
        counts = dict.fromkeys(KINDS, 0)
        values, failed = self._found(text, 0, len(text))
        for value in values:
            counts[value[2]] += 1
        runs: list[list[int]] = []  # stretches of failed matches that overlap
        for start, end in failed:
            if runs and start < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([start, end])
        out, last, k = [], 0, 0
        while k < len(values):
            start, end = values[k][:2]
            while runs and runs[0][1] <= start:
                runs.pop(0)
            n = 1
            if runs and runs[0][0] < end:
                low, high = min(start, runs[0][0]), max(end, runs[0][1])
                while k + n < len(values) and values[k + n][0] < high:
                    high = max(high, values[k + n][1])
                    n += 1
                new = self._together(text, low, high)
            else:
                low, high, new = start, end, values[k][3]
            out += [text[last:low], new]
            last, k = high, k + n
        return "".join([*out, text[last:]]), counts

    def _together(self, text: str, low: int, high: int) -> str:
        """The range with pseudonyms, walked on until it is read as the text is."""
        values = self._found(text, low, high)[0]
        kinds, news = [v[2] for v in values], [v[3] for v in values]
        between = [text[a:b] for a, b in zip([low, *(v[1] for v in values)], [*(v[0] for v in values), high])]
        while True:
            new, places = between[0], []
            for kind, value, after in zip(kinds, news, between[1:]):
                places.append((low + len(new), low + len(new) + len(value), kind))
                new += value + after
            read = self._found(text[:low] + new + text[high:], low, low + len(new))[0]
            if [v[:3] for v in read] == places:
                return new
            news = [getattr(self, kind)(x) for kind, x in zip(kinds, news)]


def replacer(key: str, inverse: bool = False):
    """A function of a text column: the text with pseudonyms and the number of values by kind."""
    pseudonyms = Pseudonyms(hashlib.blake2b(key.encode(), digest_size=32).digest(), inverse)

    @F.arrow_udf("text string, " + ", ".join(f"n_{k} int" for k in KINDS))
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            # every kind holds a digit, an @, a quoted value or AKIA
            likely = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]|[=:]\s*[\"']|AKIA"), False).to_pylist()
            out, counts = texts.to_pylist(), [[0] * len(texts) for _ in KINDS]
            for k, look in enumerate(likely):
                if look:
                    out[k], found = pseudonyms.replace(out[k])
                    for column, kind in zip(counts, KINDS):
                        column[k] = found[kind]
            yield pa.StructArray.from_arrays(
                [pa.array(out, pa.string()), *(pa.array(c, pa.int32()) for c in counts)],
                ["text", *(f"n_{k}" for k in KINDS)])

    return replace


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_<kind>`` of every row of ``docs(doc_id, text)``, personal values replaced.

    A null text stays null and an empty one empty, with counts of 0; texts of any length are read whole
    and repeated rows come out alike. Text without valid values is returned as it is. Other columns are
    ignored.
    """
    return docs.select("doc_id", replacer(key)(F.col("text")).alias("new")).select("doc_id", "new.*")
