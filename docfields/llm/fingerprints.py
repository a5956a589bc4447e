"""Document fingerprints by locally consistent parsing.

Names of symbols are compared with their left neighbours' (deterministic coin tossing) until labels are small;
local maxima of the labels cut the sequence into phrases, whose names are the symbols of the next level.  What
a phrase is depends only on a bounded neighbourhood, so equal substrings have equal interior phrases wherever
they stand.  A fingerprint is the set of names of levels ``LEVELS`` and of the whole text, kept as its
``SKETCH`` smallest hashes; a text with fewer than ``FEW`` phrases of a level also has those of the level below, whose
hashes are odd, all others even.  Likeness is the share that two sets have in common, estimated from the hashes; where
only one of two texts has odd ones, they are left out.

Null texts count as empty; an empty text's fingerprint is that of the empty string, so two empty texts are
alike (1); repeated ids stand next to each other, ordered by a hash of their texts; null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.base import groups, partitions, ragged, slices

LEVELS = (3, 4)
SKETCH = 128
#: Phrases of a level that are too few to tell how like two texts are.
FEW = 16
#: Rounds of coin tossing after which labels of 64-bit names are below 8.
ROUNDS = 4
#: Characters of text in one batch of results, to which a row adds some of its own, and ranges of documents for each shuffle partition.
TOGETHER, ROW, RANGES = 1 << 20, 256, 4
#: Bytes of text that are parsed together, so few that the arrays stay in a processor's cache.
PARSED = 1 << 18

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def _told(names: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Place of the lowest bit in which names differ from those before them, doubled, plus the names' own value of that bit."""
    low = names ^ before
    low &= ~low + low.dtype.type(1)
    labels = np.bitwise_count(low - low.dtype.type(1))
    labels <<= np.uint8(1)
    labels |= (names & low) != 0
    return labels


def _labels(names: np.ndarray, head: np.ndarray, at: np.ndarray | None = None, long: np.ndarray | None = None) -> np.ndarray:
    """Small labels, different for neighbours, of 64-bit names, or of bytes with the 64-bit names ``long`` at the places ``at``.

    First symbols are told by ``head``, a mask or places; they are compared with an imagined one that differs in bit 0.
    """
    labels = np.empty(len(names), np.uint8)
    labels[1:] = _told(names[1:], names[:-1])
    first = (names[head] & names.dtype.type(1)).astype(np.uint8)
    if at is not None and len(at):
        after = at[:-1] + 1 if at[-1] == len(names) - 1 else at + 1
        labels[after] = _told(names[after].astype(np.uint64), long[: len(after)])
        before = names[at - 1].astype(np.uint64)
        side = np.flatnonzero(np.diff(at) == 1)
        before[side + 1] = long[side]
        labels[at] = _told(long, before)
        found = np.minimum(np.searchsorted(at, head), len(at) - 1)
        first = np.where(at[found] == head, long[found] & _U(1), first).astype(np.uint8)
    labels[head] = first
    for _ in range(ROUNDS - 1):
        labels[1:] = _told(labels[1:], labels[:-1])
        labels[head] = first
    return labels


def _phrases(names: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the next level, and where each text's begin.  ``names`` are bytes or 64-bit names."""
    new = np.empty(len(names), bool)
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[head] = True
    again = np.flatnonzero(~new)
    at = again - np.arange(1, len(again) + 1)  # the symbol that is repeated, once for each repeat
    if len(again):
        names, head = names[new], head - np.searchsorted(again, head)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        at, runs = at[starts], np.diff(starts, append=len(at)) + 1
        long = _mix(names[at] + runs.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    else:
        long = np.empty(0, np.uint64)
    short = names.dtype == np.uint8
    if not short and len(at):
        names[at] = long
    labels = _labels(names, head, at, long) if short else _labels(names, head)
    peak = np.zeros(len(names), bool)
    rise = labels[1:] > labels[:-1]
    fall = labels[1:] < labels[:-1]
    np.logical_and(rise[:-1], fall[1:], out=peak[1:-1])
    peak[head[1:] - 1] = False
    peak[head] = True
    cuts = np.flatnonzero(peak)
    sizes = np.diff(cuts, append=len(names))
    place = np.arange(len(names)) - np.repeat(cuts, sizes)
    steps = np.arange(1, sizes.max() + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F)
    if short:
        every = _mix(np.arange(256, dtype=np.uint64) + steps[:, None]).ravel()
        parts = every[(place << 8) | names]
        parts[at] = _mix(long + steps[place[at]])
    else:
        parts = _mix(names + steps[place])
    total = np.cumsum(parts, out=parts)[np.append(cuts[1:], len(names)) - 1]
    total[1:] -= total[:-1].copy()
    return _mix(total), np.searchsorted(cuts, head)


def _sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending 32-bit hashes, ``SKETCH`` at most, of each text after the other, and how many each has."""
    even = ~_U(1)
    every = np.arange(len(texts), dtype=np.uint64) << _U(32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    kept = [every | (np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)) >> _U(32) & even)]
    names = np.frombuffer(b"".join(texts), np.uint8)
    own = every[sizes > 0]
    sizes = sizes[sizes > 0]
    head = np.cumsum(sizes) - sizes
    for level in range(1, max(LEVELS) + 1):
        if not len(own):
            break
        below, before = names, sizes
        names, head = _phrases(names, head)
        sizes = np.diff(head, append=len(names))
        if level in LEVELS:
            kept.append(np.repeat(own, sizes) | (_mix(names + _U(level)) >> _U(32) & even))
        few = sizes < FEW
        if 1 < level <= min(LEVELS) and few.any():
            odd = _mix(below[np.repeat(few, before)] + _U(level - 1)) >> _U(32) | _U(1)
            kept.append(np.repeat(own[few], before[few]) | odd)
    found = np.sort(np.concatenate(kept))
    found = found[np.append(True, found[1:] != found[:-1])]
    starts = np.searchsorted(found, every)
    sizes = np.minimum(np.diff(starts, append=len(found)), SKETCH)
    return found[ragged(starts, sizes)].astype(np.uint32), sizes


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """Ascending 32-bit hashes, ``SKETCH`` at most, for each text."""
    if not texts:
        return []
    flat, sizes = _sketches(texts)
    return np.split(flat, np.cumsum(sizes)[:-1])


def _likenesses(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints ``a`` and ``b``, of which fingerprint i is ``sizes[i]`` hashes of ``flat`` from ``starts[i]`` on."""
    odd = np.logical_or.reduceat((flat & 1).astype(bool), starts)
    one = odd[a] != odd[b]
    keys, longest = [], np.zeros(len(a), np.int64)
    for side in (a, b):
        pair = np.repeat(np.arange(len(side)), sizes[side])
        names = flat[ragged(starts[side], sizes[side])].astype(np.uint64)
        left = ~one[pair] | (names & _U(1) == 0)
        pair, names = pair[left], names[left]
        longest = np.maximum(longest, np.bincount(pair, minlength=len(side)))
        keys.append((pair.astype(np.uint64) << _U(32)) | names)
    keys = np.sort(np.concatenate(keys))
    again = keys[1:] == keys[:-1]
    union = np.flatnonzero(np.append(True, ~again))
    pair = (keys[union] >> _U(32)).astype(np.int64)
    rank = np.arange(len(union)) - np.searchsorted(pair, np.arange(len(a)))[pair]
    inside = (longest[pair] < SKETCH) | (rank < SKETCH)  # beyond its sketch a set is unknown
    common = np.append(again, False)[union]
    return np.bincount(pair[inside & common], minlength=len(a)) / np.bincount(pair[inside], minlength=len(a))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the sets behind two fingerprints."""
    sizes = np.array([len(a), len(b)])
    return float(_likenesses(np.concatenate([a, b]), np.array([0, len(a)]), sizes, np.array([0]), np.array([1]))[0])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(1)
    for batch, texts in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("bucket"), pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts], pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary())],
            ["doc_id", "bucket", "tie", "blob"],
        )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
    """(doc_id, text, next text) of the sorted rows of a partition; the last row of each range is borrowed from the next."""
    press, last = zstandard.ZstdDecompressor(), None
    for batch in batches:
        for bucket, doc, blob, lent in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "blob", "lent")), strict=True):
            text = press.decompress(blob).decode()
            if last is not None and last[0] == bucket:
                yield last[1], last[2], text
            last = None if lent else (bucket, doc, text)


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the first characters of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        texts = [t.encode() for _, t, _ in rows]
        changed = [edited(t, a).encode() for _, t, a in rows]
        after = [a.encode() for _, _, a in rows]
        # A row's next text is mostly the text of the row after it, so equal texts are parsed once.
        place: dict[bytes, int] = {}
        own, new, following = (np.array([place.setdefault(t, len(place)) for t in ts]) for ts in (texts, changed, after))
        parts = [_sketches(part) for part in groups(place, PARSED)]
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.cumsum(sizes) - sizes
        digits = flat.astype(">u4").tobytes().hex()
        text = lambda ps: pa.array([digits[8 * i : 8 * (i + n)] for i, n in zip(starts[ps].tolist(), sizes[ps].tolist(), strict=True)], pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _, _ in rows], pa.int64()),
                pa.array([len(t) for _, t, _ in rows], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                text(own),
                text(new),
                pa.array(_likenesses(flat, starts, sizes, own, new)),
                pa.array(_likenesses(flat, starts, sizes, own, following)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    rows, size = [], 0
    for row in _pairs(batches):
        rows.append(row)
        size += len(row[1]) + ROW
        if size >= TOGETHER:
            yield done(rows)
            rows, size = [], 0
    if rows:
        yield done(rows)


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses: one row for each row of ``docs``.

    Documents are dealt to ranges of ``doc_id`` in descending order; each range borrows the first document of
    the next range (the last one borrows from the first), so the texts move once and compressed.
    """
    spark = docs.sparkSession
    n = partitions(spark) * RANGES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most n numbers come to the driver: where the ranges begin, and later which document is first in each.
    at = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = sorted(set(at), reverse=True)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1))
    edge = F.array(*map(F.lit, bounds)) if bounds else F.expr("cast(array() as array<bigint>)")
    # Bound k is the first of range k + 1; ids above all bounds are range 0.
    bucket = bucket.otherwise(F.aggregate(edge, F.lit(0), lambda acc, b: acc + (b >= F.col("doc_id")).cast("int")))
    rows, form = rows.withColumn("bucket", bucket), "doc_id long, bucket int, tie long, blob binary"
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    if not tops:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    firsts = spark.createDataFrame(
        [(t["bucket"], t["top"], tops[i - 1]["bucket"]) for i, t in enumerate(tops)], "of int, top long, to int"
    )
    # The first row of a range: its greatest id, of equal ids the least tie.  Only rows of that id are packed for it.
    lent = rows.join(F.broadcast(firsts), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    lent = lent.select("doc_id", "text", F.col("to").alias("bucket")).mapInArrow(_pack, form)
    lent = lent.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "tie", "blob"), F.col("tie")).alias("x")).select("x.*", "bucket")
    both = rows.mapInArrow(_pack, form).withColumn("lent", F.lit(False)).unionByName(lent.withColumn("lent", F.lit(True)))
    dealt = both.repartition(n, "bucket").sortWithinPartitions("bucket", "lent", F.col("doc_id").desc_nulls_last(), "tie")
    return dealt.mapInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
