"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

``find`` takes (doc_id, text) from any table and returns one row per input row.  Null and empty texts have
no spans; repeated rows and ids each keep their own row; other columns are ignored.  Positions are code
points, end exclusive.  Every pattern runs in time linear in the text, so very long texts need no cap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docfields.llm.base import slices, through_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})")
_GROUPS = re.compile(r"(?: ?[A-Z0-9]){11,30}")

#: Words near a span that make its kind likelier, in any of the corpus languages.
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("address", "server", "host", " ip", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", " tel", "mobil", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
}
#: Score of a span of each kind before its context is read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
NEAR, BONUS = 40, 0.1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(number: str) -> bool:
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Starting from each '@' and going left is the leftmost match, without rescanning long runs.
    done = 0
    for m in _AT.finditer(text):
        i = m.start()
        while i > done and text[i - 1] in _LOCAL:
            i -= 1
        if i < m.start():
            done = m.end()
            yield i, done


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers that mod-97 confirms; of several ends after which no letter or digit follows, the farthest."""
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        end = _GROUPS.match(text, m.end()).end()
        while True:
            number = text[m.start() : end].replace(" ", "")
            if len(number) < 15:
                break
            if not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()) and mod97(number):
                done = end
                yield m.start(), end
                break
            end -= 1
            while text[end - 1] == " ":
                end -= 1


def _octets(found: str) -> bool:
    return all(len(x) <= 3 and (not x or int(x) <= 255) for x in (p.lstrip("0") for p in found.split(".")))


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans, by kind as listed in KINDS and then by start."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    out += [("iban", *x) for x in _ibans(text)]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - NEAR):start]} {text[end:end + NEAR]}".lower()
    return round(min(1.0, PRIOR[kind] + BONUS * sum(w in around for w in CONTEXT[kind])), 4)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the earliest, then longest, stays."""
    out, at = [], 0
    for kind, start, end in sorted(spans(text), key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def digest(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raws in slices(batches, "text"):
        rows = {k: [] for k in ("email", "ip", "card", "phone", "sha", "spans", "scores")}
        for raw in raws:
            text = raw.decode("utf-8", "replace")
            found = spans(text)
            base = [x for x in found if x[0] in BASE]
            for kind in BASE:
                rows[kind].append(sum(x[0] == kind for x in base))
            rows["sha"].append(hashlib.sha256(digest(base).encode()).hexdigest())
            rows["spans"].append(digest(found))
            rows["scores"].append([score(text, *x) for x in found])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array(rows[k], pa.int64()) for k in BASE),
                pa.array(rows["sha"], pa.string()),
                pa.array(rows["spans"], pa.string()),
                pa.array(rows["scores"], pa.list_(pa.float64())),
            ],
            ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"],
        )


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores: one row for each row of ``docs``."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        _scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"
    )


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` masked; ``n_chars`` follows the new text; types stay as they are."""
    place = {c: i for i, c in enumerate(docs.columns)}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in slices(batches, f"c{place['text']}"):
            columns = batch.columns
            old = columns[place["text"]]
            texts = [masked(t.decode("utf-8", "replace")) if ok else None for t, ok in zip(raws, old.is_valid().to_pylist(), strict=True)]
            columns[place["text"]] = pa.array(texts, old.type)
            if "n_chars" in place:
                kind = columns[place["n_chars"]].type
                columns[place["n_chars"]] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kind)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return through_arrow(docs, go)
