"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Each text is read once, whole, in one Python pass per Arrow batch; there is no shuffle. Patterns run in time linear in
the text: where a plain regular expression would rescan a run from each of its characters (e-mail, dotted numbers), an
anchor is searched first and the leftmost match is derived from it.

Base kinds (email, ip, card, phone) stay whatever their score. The method adds IBANs (mod 97), keys and passwords, social
security numbers and local telephone numbers, where checksum or context lifts the score to the threshold.

Defined results: null and empty text have no spans; offsets are code points, end exclusive; repeated rows are judged
each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import numbered, pick, pieces

#: Order of kinds that start at the same place.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret", "local_phone"]
BASE = frozenset(KINDS[:4])

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])|(?:password|passwd|secret|api_key|token)[ ]?[=:][ ]?[^\s]{8,}+")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")

_RUN, _RUNS = re.compile(r"[^\W_]*"), re.compile(r"[^\W_]+")

#: Score of a match by itself, and whole words nearby that raise it (by CONTEXT_GAIN).
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.8, "local_phone": 0.35}
CONTEXT = {
    "email": {"mail", "email", "contact", "write"}, "ip": {"ip", "address", "server", "host"}, "card": {"card", "visa", "credit", "payment"}, "phone": {"phone", "call", "tel", "fax"},
    "iban": {"iban", "bank", "account"}, "ssn": {"ssn", "social", "security"}, "secret": {"key", "secret", "token", "password"}, "local_phone": {"phone", "telephone", "call", "tel", "fax", "mobile"},
}
CONTEXT_GAIN, CONTEXT_CHARS, THRESHOLD = 0.3, 40, 0.6


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    flat = iban.replace(" ", "")
    return len(flat) >= 15 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = seen = 0  # end of the last match; behind the last @
    for m in _DOMAIN.finditer(text):
        at = m.start()
        low = max(done, text.rfind("@", seen, at) + 1, seen)
        seen = at + 1
        before = text[low:at]
        n = len(before) - len(before.rstrip(_LOCAL))
        if n:
            done = m.end()
            yield at - n, done


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        numbers = m.group().split(".")
        at = m.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def _words_near(text: str, start: int, end: int) -> set[str]:
    """Whole words (runs of letters and digits), in lower case, within CONTEXT_CHARS of a span; words that the limit cuts
    don't count."""
    low, high = max(0, start - CONTEXT_CHARS), min(len(text), end + CONTEXT_CHARS)
    before, behind = text[low:start], text[end:high]
    if low and text[low - 1].isalnum():
        before = before[len(_RUN.match(before).group()) :]
    if high < len(text) and text[high].isalnum():
        behind = behind[: len(behind) - len(_RUN.match(behind[::-1]).group())]
    return set(_RUNS.findall(before.lower())) | set(_RUNS.findall(behind.lower()))


def _near(text: str, start: int, end: int, kind: str) -> float:
    return min(1.0, SCORE[kind] + CONTEXT_GAIN * (not CONTEXT[kind].isdisjoint(_words_near(text, start, end))))


def find(text: str | None) -> list[Span]:
    """All spans by start, then kind."""
    text = text or ""
    out: list[Span] = []
    if "@" in text:
        out += [Span("email", *s, _near(text, *s, "email"), True) for s in _emails(text)]
    for kind, search in (("ip", _ips), ("card", _cards), ("phone", _phones)):
        out += [Span(kind, *s, _near(text, *s, kind), True) for s in search(text)]
    taken: bytearray | None = None  # which characters are in a span
    for kind, pattern in (("iban", _IBAN), ("ssn", _SSN), ("secret", _SECRET), ("local_phone", _LOCAL_PHONE)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if taken is None:
                taken = bytearray(len(text))
                for s in out:
                    taken[s.start : s.end] = b"\1" * (s.end - s.start)
            # a secret is one whole span, also with an address or number inside it
            if kind == "iban" and not mod97(m.group()) or kind != "secret" and taken.find(1, a, b) >= 0:
                continue
            if (score := _near(text, a, b, kind)) >= THRESHOLD:
                out.append(Span(kind, a, b, score, False))
                taken[a:b] = b"\1" * (b - a)
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, of the first kind."""
    if not text:
        return text
    out, at = [], 0
    spans = find(text)
    i = 0
    while i < len(spans):
        kind, start, end = spans[i][:3]
        while i + 1 < len(spans) and spans[i + 1].start < end:
            i += 1
            end = max(end, spans[i].end)
        out += [text[at:start], f"<{kind}>"]
        at = end
        i += 1
    return "".join(out) + text[at:]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, spans array<struct<kind, start, end, score, base>>)` of every text."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col})
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
        for b in pieces(batches):
            spans = [[s._asdict() for s in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, of)], names=["doc_id", "spans"])

    return src.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the spans in the text column (the first of that name) masked; the other columns as they were, whatever
    their names. Null and empty texts stay."""
    at = docs.columns.index(text_col)
    flat = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            columns = list(b.columns)
            columns[at] = pa.array([masked(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return flat.mapInArrow(run, flat.schema).toDF(*docs.columns)


def listed(spans, only_base: bool = False):
    """`kind:start:end`, comma-joined."""
    kept = F.filter(spans, lambda s: s["base"]) if only_base else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
