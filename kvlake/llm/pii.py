"""Personal data: patterns propose, checksums confirm, context scores.

Regular expressions propose spans of each kind; validators (address ranges, Luhn
for cards, mod-97 for IBANs, digit counts) drop the false ones; words near a span
raise or lower its score.  The four base kinds (email, ip, card, phone) are
reported whatever their score; spans of the method's own kinds need a score of at
least ``MIN_SCORE``.

All searches are linear in the text, however long its words: an address is grown
to the left of its ``@`` instead of being tried at each letter, and a number is
only tried where its digits begin.

Defined results: a null text counts as empty and has no spans; repeated rows give
repeated results; an empty table gives an empty one.  Offsets are code points, ends
exclusive.  Spans of different kinds may overlap; each stands for itself.  Other columns
are kept by ``with_pii`` and not read; names beginning with ``_kv_`` are reserved.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
MIN_SCORE = 0.5
CONTEXT_CHARS = 60

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?:gh[pousr]|sk|xox[abp])[_-][A-Za-z0-9]{20,}+)(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?i:password|passwd|token|secret|api[_-]?key)(?: ?[=:] ?)[\"']?[A-Za-z0-9+/_-]{12,}+", re.ASCII)
_ANY_DIGIT = re.compile(r"[0-9]")

_PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "secret": 0.7}
_FOR = {
    "email": re.compile(r"\b(e-?mail|mail|contact|write|reach)\b", re.I),
    "ip": re.compile(r"\b(ip|address|host|server|login|client)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|credit|debit|payment|pay)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|call|mobile|fax|cell)\b", re.I),
    "iban": re.compile(r"\b(iban|bank|account|transfer)\b", re.I),
    "ssn": re.compile(r"\b(ssn|social|security|taxpayer)\b", re.I),
    "secret": re.compile(r"\b(key|token|password|secret|aws|credential)\b", re.I),
}
_AGAINST = re.compile(r"\b(example|sample|version|isbn|order|invoice|dummy|placeholder)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses.  The characters before an ``@`` that may
    stand in an address are one run, so its start needs no search."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1  # no address begins before a failed @ and goes past it
        at = text.find("@", at + 1)
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def score(kind: str, text: str, start: int, end: int) -> float:
    """Prior of the kind, moved by the words around the span."""
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS // 2]
    s = _PRIOR[kind] + 0.2 * bool(_FOR[kind].search(near)) - 0.3 * bool(_AGAINST.search(near))
    return min(1.0, max(0.0, s))


def find_pii(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score), ordered by kind as in KINDS, then start."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    digit = _ANY_DIGIT.search(text) is not None
    if digit:
        found += [("ip", *s) for s in ips(text)]
        found += [("card", *s) for s in cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in phones(text)]
    out = [(k, s, e, score(k, text, s, e)) for k, s, e in found]
    own: list[tuple[str, int, int]] = []
    if digit:
        own += [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m.group())]
        own += [("ssn", *m.span()) for m in _SSN.finditer(text) if _plausible_ssn(m.group())]
    own += [("secret", *m.span()) for m in _SECRET.finditer(text)]  # needs no digit
    out += [(k, s, e, v) for k, s, e in own if (v := score(k, text, s, e)) >= MIN_SCORE]
    return out


def _plausible_ssn(s: str) -> bool:
    a, b, c = s.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _finder(text_col: str, names: list[str]):
    keys = ("kind", "start", "end", "score")

    def run(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            spans = [[dict(zip(keys, s)) for s in find_pii(t.as_py())] for t in col(text_col)]
            yield pa.RecordBatch.from_arrays([*(col(c) for c in names), pa.array(spans, _ARROW)], names=[*names, "_kv_pii"])

    return run


def with_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and the array ``_kv_pii`` of (kind, start, end, score)."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    need = docs.select(*dict.fromkeys([*keep, text_col]))
    return need.mapInArrow(_finder(text_col, list(keep)), T.StructType([*(docs.schema[c] for c in keep), T.StructField("_kv_pii", SPANS)]))


def _listed(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of their spans, all spans."""
    p = F.col("_kv_pii")
    of = lambda k: F.size(F.filter(p, lambda s: s["kind"] == k)).cast("long")
    return with_pii(docs, text_col, [id_col]).select(
        id_col,
        *(of(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(F.filter(p, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _listed(p).alias("spans"),
        F.array_max(F.transform(p, lambda s: s["score"])).alias("max_score"),
    )


def redact(docs: DataFrame, text_col: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """Spans of at least this score give way to ``[KIND]``; overlapping spans give
    way together, to the kind that begins first."""

    def run(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            texts = []
            for t, spans in zip(col(text_col).to_pylist(), col("_kv_pii").to_pylist()):
                out, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["score"] >= least:
                        if s["start"] >= at:
                            out += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                        at = max(at, s["end"])
                texts.append(None if t is None else "".join([*out, t[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(text_col).type) if c == text_col else col(c) for c in names], names=names)

    names = list(docs.columns)
    return with_pii(docs, text_col).mapInArrow(run, docs.schema)
