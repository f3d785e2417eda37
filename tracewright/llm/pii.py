"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Base kinds (email, ip, card, phone) follow fixed patterns and always count when their own checks hold: octets of at most
255, Luhn for 16 to 19 digits, 8 to 15 digits. The method adds account numbers (``iban``, confirmed by mod 97) and
grouped identity numbers (``ssn``, which no checksum confirms, so only context words lift it over the threshold). An
added span that overlaps a base span is left out. Matching takes time in proportion to the text, also in long runs of
one character. Null counts as empty text; a text without spans gives empty strings and zero counts. Rows are handled one
by one, so repeated rows repeat their result, and further columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its first digit only: no shorter start can succeed where that one fails.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

#: Words that speak for a kind when they stand near a span.
CONTEXT = {
    "email": {"email", "mail", "contact", "courriel", "correo"},
    "ip": {"ip", "address", "host", "server", "adresse"},
    "card": {"card", "credit", "visa", "mastercard", "carte", "karte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "identity"},
}
#: Score of a proposed span, and what a passed checksum and a context word add.
PROPOSED, CONFIRMED, NEARBY = 0.4, 0.4, 0.2
CHECKED = {"ip", "card", "iban"}
CONTEXT_CHARS = 40


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Each address holds exactly one "@"; its local part is the run before it, as far as it is free.
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    spans = [("email", *span) for span in _emails(text)]
    if _DIGIT.search(text):
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
        spans += [("card", *span) for span in _cards(text)]
        if "+" in text:
            spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return spans


def _added(text: str) -> Iterator[tuple[str, int, int]]:
    for found in _IBAN.finditer(text):
        account = found.group().replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield "iban", *found.span()
    for found in _SSN.finditer(text):
        yield "ssn", *found.span()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = {w.lower() for w in _WORD.findall(near)}
    return round(PROPOSED + CONFIRMED * (kind in CHECKED) + NEARBY * bool(words & CONTEXT[kind]), 3)


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts, ends = [], []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def find_spans(text: str | None, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    """All spans of one text by kind as listed, then start. ``threshold`` decides about added kinds only."""
    text = text or ""
    base = base_spans(text)
    out = [(*span, _score(text, *span)) for span in base]
    if _DIGIT.search(text):
        starts, ends = _merged(base)
        for span in sorted(_added(text), key=lambda s: (KINDS.index(s[0]), s[1])):
            before = bisect_left(starts, span[2]) - 1  # the last base stretch that starts before the span ends
            free = before < 0 or ends[before] <= span[1]
            if free and (score := _score(text, *span)) >= threshold:
                out.append((*span, score))
    return out


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind; overlapping spans are merged under the first one's kind."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def scan(docs: DataFrame, text: str = "text", threshold: float = 0.6, redact: bool = False, into: str = "pii_spans") -> DataFrame:
    """``docs`` with ``into``: array of (kind, start, end, score) in code points, end exclusive; replaces such a column.

    With ``redact`` the text column holds the text with its spans replaced.
    """
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(SPANS))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(source):
        for batch in source:
            texts = batch.column(text).to_pylist()
            found = [find_spans(t, threshold) for t in texts]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if redact:
                columns[text] = pa.array([redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
            columns[into] = pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans] for spans in found], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)


def span_text(spans: str | Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by base kind and digests of the spans, one row per row."""
    is_base = lambda s: s["kind"].isin(*BASE_KINDS)
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        key,
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(span_text(F.filter("pii_spans", is_base)).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("pii_spans")).alias("spans"),
        *[count(kind).alias(f"n_{kind}") for kind in ADDED_KINDS],
    )


def text_digest(text: str | None) -> str:
    """The base digest of one text, for checks."""
    return hashlib.sha256(_joined(base_spans(text or "")).encode()).hexdigest()
