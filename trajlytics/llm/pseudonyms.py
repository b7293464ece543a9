"""PII: format-preserving Feistel pseudonyms. Validated numbers, dates, addresses and mail names are permuted with a key
inside their own format, so equal values get equal pseudonyms in every document and the holder of the key can go back."""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trajlytics.llm.common import id_and_text

ROUNDS = 10
FINDINGS = "doc_id long, kind string, start_pos long, end_pos long, pseudonym string"

# A stretch of digits and the separators of numbers; kinds are told apart inside it.
CHUNK = re.compile(r"\d[\d ().:/\-]{4,}\d")
KINDS = (
    ("date", re.compile(r"(?<![\d\-/.])(?:(\d{4})([-/.])(\d{2})\2(\d{2})|(\d{2})([-/.])(\d{2})\6(\d{4}))(?![\d\-/]|\.\d)")),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)")),
    ("phone", re.compile(r"\+\d{1,3} ?\(\d{2,4}\) ?\d{3,4}[ .\-]?\d{3,4}(?!\d)|\+\d{1,3}[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d+])(?:\(\d{3}\) ?|\d{3}[\-.])\d{3}[\-.]\d{4}(?!\d)")),
    ("national_id", re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")),
    ("number", re.compile(r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d)")),
)
MAIL_NAME = re.compile(r"[A-Za-z0-9._%+\-]+\Z")
MAIL_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """Keyed permutation of 0..size-1: an unbalanced Feistel network over a x b >= size, walked until inside."""
    if size < 2:
        return value
    a = int(size**0.5)
    while a * a < size:
        a += 1
    b = -(-size // a)

    def mix(k: int, half: int) -> int:
        digest = hashlib.blake2b(f"{tweak}|{size}|{k}|{half}".encode(), key=key[:64], digest_size=16).digest()
        return int.from_bytes(digest, "big")

    while True:
        left, right = divmod(value, b)
        for k in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            shift = mix(k, right if k % 2 == 0 else left) * (-1 if inverse else 1)
            if k % 2 == 0:
                left = (left + shift) % a
            else:
                right = (right + shift) % b
        value = left * b + right
        if value < size:
            return value


def permute_characters(text: str, key: bytes, tweak: str, inverse: bool = False) -> str:
    """Digits stay digits, small letters small and capitals capital; everything else stays in its place."""
    classes = [(10, "0") if c.isascii() and c.isdigit() else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else None for c in text]
    value, size = 0, 1
    for c, kind in zip(text, classes, strict=True):
        if kind:
            value, size = value * kind[0] + ord(c) - ord(kind[1]), size * kind[0]
    value = permute(value, size, key, tweak, inverse)
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if kind := classes[i]:
            value, digit = divmod(value, kind[0])
            out[i] = chr(ord(kind[1]) + digit)
    return "".join(out)


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def put_digits(pattern: str, digits: str) -> str:
    """pattern with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def pseudonym(kind: str, value: str, key: bytes, inverse: bool = False) -> str | None:
    """The pseudonym of a value (or the value of a pseudonym); None if the value is not valid for its kind."""
    if not value.isascii():
        return None
    if kind == "date":
        parts = re.split(r"[-/.]", value)
        year_first = len(parts[0]) == 4
        y, m, d = map(int, parts if year_first else parts[::-1])
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        if FIRST_DAY <= day <= LAST_DAY:  # every-day dates stay so
            day = FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, kind, inverse)
        else:
            before = FIRST_DAY - 1
            place = day - 1 if day < FIRST_DAY else before + day - LAST_DAY - 1
            place = permute(place, before + datetime.date.max.toordinal() - LAST_DAY, key, "far date", inverse)
            day = place + 1 if place < before else place - before + LAST_DAY + 1
        new = datetime.date.fromordinal(day)
        text = f"{new.year:04d}{new.month:02d}{new.day:02d}" if year_first else f"{new.day:02d}{new.month:02d}{new.year:04d}"
        return put_digits(value, text)
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        number = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, kind, inverse)
        return ".".join(map(str, number.to_bytes(4, "big")))
    if kind == "iban":
        plain = value.replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if len(account) < 11 or iban_check(country, account) != check:
            return None
        new = permute_characters(account, key, f"iban {country}", inverse)
        rest = iter(country + iban_check(country, new) + new)
        return "".join(c if c == " " else next(rest) for c in value)
    if kind == "mail":
        name, _, host = value.partition("@")
        return f"{permute_characters(name, key, 'mail', inverse)}@{host}"
    digits = "".join(c for c in value if c.isdigit())
    if kind == "phone":
        head = len(re.match(r"\+(\d{1,3})", value)[1]) if value[0] == "+" else 0
        if not 7 <= len(digits) <= 15:
            return None
        rest = permute_characters(digits[head:], key, f"phone {digits[:head]}", inverse)
        return put_digits(value, digits[:head] + rest)
    if kind == "number" and luhn_digit(digits[:-1]) == digits[-1]:  # card numbers stay valid card numbers
        payload = permute_characters(digits[:-1], key, "card", inverse)
        return put_digits(value, payload + luhn_digit(payload))
    if kind == "number":  # walk on past valid card numbers, so the two kinds stay apart
        while True:
            digits = permute_characters(digits, key, "number", inverse)
            if luhn_digit(digits[:-1]) != digits[-1]:
                return put_digits(value, digits)
    return put_digits(value, permute_characters(digits, key, kind, inverse))


class Spans:
    """Ordered spans without overlaps: what is next to a place is found by bisection."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def next_start(self, after: int, before: int) -> int | None:
        """First start after one place and before another."""
        k = bisect.bisect_right(self.starts, after)
        return self.starts[k] if k < len(self.starts) and self.starts[k] < before else None

    def add(self, start: int, end: int) -> bool:
        """Whether the span is apart from all others; then it is one of them."""
        k = bisect.bisect_left(self.starts, start)
        if k < len(self.starts) and self.starts[k] < end or k and self.ends[k - 1] > start:
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def find(text: str, key: bytes) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of each validated value of a whole text, without overlaps, in order."""
    found: list[tuple[str, int, int, str]] = []

    def add(kind: str, start: int, end: int, spans: Spans) -> None:
        if (new := pseudonym(kind, text[start:end], key)) is not None and spans.add(start, end):
            found.append((kind, start, end, new))

    words = Spans([])
    at = text.find("@")
    while at >= 0:
        name = MAIL_NAME.search(text, max(0, at - 64), at)
        host = MAIL_HOST.match(text, at + 1, at + 256)
        if name and host:
            add("mail", name.start(), host.end(), words)
        at = text.find("@", at + 1)
    for m in IBAN.finditer(text):
        add("iban", m.start(), m.end(), words)
    blocked = sorted((s, e) for _, s, e, _ in found)
    k = 0
    for chunk in CHUNK.finditer(text):
        begin, end = max(0, chunk.start() - 2), chunk.end()
        while k < len(blocked) and blocked[k][1] <= begin:
            k += 1
        spans = Spans([(s, e) for s, e in blocked[k : k + 8] if s < end])
        for kind, pattern in KINDS:
            for m in pattern.finditer(text, begin, min(len(text), end + 1)):
                cut = spans.next_start(m.start(), m.end())
                if cut is None:
                    add(kind, m.start(), m.end(), spans)
                elif shorter := pattern.fullmatch(text, m.start(), m.start() + len(text[m.start() : cut].rstrip(" .-"))):  # it ran into another value
                    add(kind, m.start(), shorter.end(), spans)
    return sorted(found, key=lambda x: x[1])


def find_private(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per value: kind, place in the text (characters) and pseudonym, never the value itself.

    One pass without a shuffle. Null and empty texts and texts without values give no rows; repeated rows repeat theirs;
    a null doc_id stays null. Kinds: mail, iban, date, ip, phone, national_id, number (13-19 digits).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for finding in find(text.as_py() or "", key):
                    for column, value in zip(out, (doc_id, *finding), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], [f.split()[0] for f in FINDINGS.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, FINDINGS)


def with_pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with every value in its texts replaced by its pseudonym; all other columns, whatever their names, as they were.

    Null texts stay null, empty ones empty; null ids and repeated rows are rows like any other; an empty table gives no rows."""
    place = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(place).to_pylist():
                parts, at = [], 0
                for _, start, end, new in find(text or "", key):
                    parts += [text[at:start], new]
                    at = end
                texts.append("".join([*parts, text[at:]]) if parts else text)
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(rows, docs.schema)
