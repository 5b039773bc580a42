"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

Four base kinds (email, ip, card, phone) are taken wherever their pattern and its check hold. Further spans are added
where their score is high enough: account numbers that pass mod 97, cards within longer rows of digits or of fewer
digits, and identifiers without a checksum, which need a fitting word nearby. Each search takes time in proportion to the
text, whatever is in it.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import apart

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id", "local_phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
#: All of a chain of numbers joined by dots, or of digits joined by single blanks or hyphens; chains never overlap.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NATIONAL_ID = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")

# Lengths of account numbers by country (ISO 13616 registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}


@dataclass(frozen=True)
class Scores:
    """A span's score is its kind's prior, more with a checksum that holds and with a word of its kind nearby, less with a
    word before it that tells of other numbers; added spans need `least`."""

    least: float = 0.6
    checksum: float = 0.2
    context: float = 0.35
    reach: int = 40


PRIORS = {"email": 0.8, "ip": 0.5, "card": 0.45, "phone": 0.6, "iban": 0.6, "national_id": 0.3, "local_phone": 0.3}
CONTEXT = {
    "email": {"email", "mail", "contact", "courriel", "correo"},
    "ip": {"ip", "host", "server", "address", "client", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment", "carte", "karte", "kreditkarte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "téléphone", "telefon", "teléfono"},
    "iban": {"iban", "account", "bank", "transfer", "konto", "compte", "cuenta"},
    "national_id": {"ssn", "social", "security", "taxpayer"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "téléphone", "telefon", "teléfono"},
}
OTHER_NUMBERS = {"isbn", "issn", "doi", "version", "release", "build", "sku", "serial", "order", "invoice", "tracking", "part", "section"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """The check of an account number without blanks: its first four characters moved to the end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Fours of numbers of a dotted chain, one after another, with parts of 255 at most."""
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _bare(text: str) -> str:
    return text.replace(" ", "").replace("-", "")


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers by the length of their country, so that upper-case words that follow are not taken for more."""
    for m in _IBAN.finditer(text):
        need = IBAN_LENGTHS.get(m[0][:2])
        bare = m[0].replace(" ", "")
        if need is None or len(bare) < need:
            continue
        end, seen = m.start(), 0
        while seen < need:
            seen += text[end] != " "
            end += 1
        if (end == len(text) or not (text[end].isascii() and text[end].isalnum())) and mod_97(bare[:need]):
            yield m.start(), end


def _cards_inside(text: str, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    """Within a chain of digits that is no card itself: undivided cards, and whether they stand in a longer chain."""
    chain = text[start:end]
    for m in re.finditer("[0-9]+", chain):
        if 13 <= len(m[0]) <= 19 and m[0][0] in "3456" and luhn(m[0]):
            yield start + m.start(), start + m.end(), len(m[0]) >= 16
    bare = _bare(chain)
    if 13 <= len(bare) <= 15 and len(chain) > len(bare) and bare[0] in "3456" and luhn(bare):
        yield start, end, False


def _nearby(text: str, start: int, end: int, reach: int) -> tuple[set[str], set[str]]:
    """Whole words within reach before and after a span."""
    low, high = max(0, start - reach), end + reach
    before, after = [m.span() for m in _WORD.finditer(text, low, start)], [m.span() for m in _WORD.finditer(text, end, high)]
    if before and before[0][0] == low and low > 0 and text[low - 1].isalpha():
        before = before[1:]
    if after and after[-1][1] == high < len(text) and text[high].isalpha():
        after = after[:-1]
    return {text[a:b].lower() for a, b in before}, {text[a:b].lower() for a, b in after}


def found(text: str | None, scores: Scores = Scores()) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) in code points, by kind and start. Added spans overlap neither base spans nor one
    another; the kind that is listed first stays."""
    if not text:
        return []
    digits = _DIGIT.search(text) is not None
    if not digits and "@" not in text:
        return []
    base: list[tuple[str, int, int, bool]] = [("email", *s, False) for s in emails(text)]
    more: list[tuple[str, int, int, bool]] = []
    if digits:
        base += [("ip", *s, False) for s in addresses(text)]
        for m in _DIGITS.finditer(text):
            size = m.end() - m.start()
            if size < 13:
                continue
            bare = _bare(m[0])
            if 16 <= len(bare) <= 19 and luhn(bare):
                base.append(("card", m.start(), m.end(), True))
            elif len(bare) >= 13:
                more += [("card", s, e, sure) for s, e, sure in _cards_inside(text, m.start(), m.end())]
        base += [("phone", *s, False) for s in phones(text)]
        more += [("iban", *s, True) for s in ibans(text)]
        for m in _NATIONAL_ID.finditer(text):
            if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000":
                more.append(("national_id", *m.span(), False))
        more += [("local_phone", *m.span(), False) for m in _LOCAL_PHONE.finditer(text)]

    def score(kind: str, start: int, end: int, checked: bool) -> float:
        before, after = _nearby(text, start, end, scores.reach)
        value = PRIORS[kind] + scores.checksum * checked + scores.context * (bool((before | after) & CONTEXT[kind]) - bool(before & OTHER_NUMBERS))
        return min(1.0, max(0.0, round(value, 6)))

    out = [(kind, start, end, score(kind, start, end, sure), True) for kind, start, end, sure in base]
    if more:
        starts, ends = [], []  # of what is taken, apart from one another
        for _, start, end, *_ in sorted(base, key=lambda s: s[1:3]):
            if ends and start < ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        for kind, start, end, sure in more:
            at = bisect(starts, start)
            free = (at == 0 or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= end)
            if free and (worth := score(kind, start, end, sure)) >= scores.least:
                starts.insert(at, start)
                ends.insert(at, end)
                out.append((kind, start, end, worth, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def _scan(scores: Scores, at: int) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    names = ("kind", "start", "end", "score", "base")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(names, s, strict=True)) for s in found(text.as_py(), scores)] for text in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW_SPANS)], names=[*batch.schema.names, "spans"])

    return run


def find_personal_data(docs: DataFrame, *, text_col: str = "text", scores: Scores = Scores()) -> DataFrame:
    """docs with spans: kind, start and end in code points (end exclusive), score, and whether it is a base span.

    Null and empty texts have no spans. Repeated rows each get theirs. A column of docs named spans is replaced. An empty
    table gives an empty one. Texts are scanned whole, in time proportional to their length.
    """
    kept = docs.select([c for c in docs.columns if c != "spans"])
    return kept.mapInArrow(_scan(scores, kept.columns.index(text_col)), T.StructType([*kept.schema.fields, T.StructField("spans", SPANS)]))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str | None, spans: Iterable[tuple[str, int, int]]) -> str | None:
    """text with each span as [KIND]; of spans that overlap, what lies beyond the first is masked with it."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, *, text_col: str = "text", scores: Scores = Scores()) -> DataFrame:
    """The rows of docs with personal data masked in their texts, all other columns as they are, whatever their names.

    Null texts stay null; an empty table gives an empty one.
    """
    own, name, back = apart(docs)
    at = own.columns.index(name(text_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t := x.as_py(), (s[:3] for s in found(t, scores))) for x in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return back(own.mapInArrow(run, own.schema))
