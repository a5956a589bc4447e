"""Repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``LENGTH`` bytes.  Each window of that length is represented by its least
``SEED``-byte piece (by hash, then leftmost), which depends on the window's bytes alone; so equal windows meet
at equal pieces, at equal distances, and only pieces are sorted at first.  A pass takes ranges of window starts
around a piece and groups them by the bytes that all their windows share (the most significant digits so far).
Ranges alone in their group hold no repeat and drop out.  Ranges of a group that also agree on every byte that any
of their windows touches repeat as a whole, and one of them stands for the rest; ranges that differ there are cut
into narrower ones, whose windows share more bytes, for the next pass.  In the last pass a range is one window, and
equal groups are exactly the repeated windows.

Counts come from partial aggregates, and ranges find their counts by a join that Spark can split, so no group of
equal ranges is gathered in one task.  Windows are compared by two 64-bit hashes, of what they share and of all they
touch; texts are told apart by 128 bits and numbered.

Texts are bytes (UTF-8; null counts as empty); equal texts are handled once, and one of at least ``LENGTH`` bytes
that more than one row holds is removed whole; shorter texts stay whole; repeated ids each keep their own row.
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

from docfields.llm.base import cut, release, slices

LENGTH, SEED = 200, 32
#: Window starts in a range, by pass.  The first is all windows that can hold a piece.
WIDTHS = (LENGTH - SEED + 1, 12, 1)
REACH = LENGTH - SEED

_U = np.uint64
_BYTES = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEPS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def anchors(text: bytes) -> np.ndarray:
    """Places of the pieces that represent the windows of ``text``, with the first and last window start of each.

    Starts count from ``REACH`` before the piece.
    """
    if len(text) < LENGTH:
        return np.zeros((0, 3), np.int64)
    h, m = _BYTES[np.frombuffer(text, np.uint8)], 1
    for step in _STEPS:  # 2, 4, 8, 16, 32 bytes
        h = h[:-m] * _U(step) + h[m:]
        h ^= h >> _U(29)
        m *= 2
    h = (h * _U(0x2545F4914F6CDD1D)) & _U(0xFFFFFFFF00000000)
    h |= np.arange(len(h), dtype=np.uint64)
    least, m = h, 1
    while 2 * m <= WIDTHS[0]:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    rest = WIDTHS[0] - m
    least = np.minimum(least[: len(least) - rest], least[rest:])
    at = (least & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    at = at[first]
    return np.stack([at, first - at + REACH, last - at + REACH], 1)


def ranges(text: bytes, at: int, low: int, high: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """(key, ext, first, last) of the ranges of pass ``step`` within the window starts from ``low`` to ``high``.

    Starts count from ``REACH`` before piece ``at``.  A range is a cell of a grid of the pass's width, so that it lies
    alike around equal pieces; ``key`` stands for the bytes that all windows of the cell share, ``ext`` for those that
    any of its windows from first to last touches.
    """
    width, zero = WIDTHS[step], at - REACH
    for cell in range(low // width, high // width + 1):
        lo, hi = cell * width, min(cell * width + width - 1, REACH)
        a, b = max(low, lo), min(high, hi)
        key = xxhash.xxh3_64_intdigest(text[zero + hi : zero + lo + LENGTH], step << 16 | cell)
        ext = xxhash.xxh3_64_intdigest(text[zero + a : zero + b + LENGTH], (a - lo) << 16 | hi - b)
        yield key - (1 << 63), ext - (1 << 63), a, b


def _texts(full: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, sent = zstandard.ZstdCompressor(3), set()
        for batch, texts in slices(batches, "text"):
            names = [xxhash.xxh3_128_digest(t) for t in texts]
            halves = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            columns = {"doc_id": batch.column("doc_id"), "t1": pa.array(halves[:, 0]), "t2": pa.array(halves[:, 1]), "n_bytes": pa.array([len(t) for t in texts], pa.int64())}
            if full:
                blobs = []
                for name, text in zip(names, texts, strict=True):
                    blobs.append(None if name in sent else press.compress(text))
                    if len(sent) < 1 << 19:
                        sent.add(name)
                columns["blob"] = pa.array(blobs, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return go


def _items(step: int):
    """key, ext, tid, held: the ranges of pass ``step``; ``held`` is a range's piece, first and last in one number."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple[int, ...]] = []
            held = batch.column("held").to_pylist() if step else [None] * batch.num_rows
            for tid, blob, own in zip(batch.column("tid").to_pylist(), batch.column("blob").to_pylist(), held, strict=True):
                text = press.decompress(blob)
                for at, low, high in anchors(text).tolist() if not step else map(_place, own):
                    for key, ext, first, last in ranges(text, at, low, high, step):
                        out.append((key, ext, tid, at << 16 | first << 8 | last))
                if len(out) >= 1 << 16:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return go


def _place(held: int) -> tuple[int, int, int]:
    return held >> 16, held >> 8 & 255, held & 255


def _batch(rows: list[tuple[int, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["key", "ext", "tid", "held"])


_ITEMS = "key long, ext long, tid long, held long"


def repeats(texts: DataFrame) -> DataFrame:
    """tid, held: ranges of the texts (tid, blob) in which every window starts anywhere else too."""
    found, held = None, texts
    for step in range(len(WIDTHS)):
        items = held.mapInArrow(_items(step), _ITEMS)
        if step:
            items = cut(items)
        by = ["key"] if step + 1 < len(WIDTHS) else ["key", "ext"]
        groups = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("ext").alias("least"), F.max("ext").alias("most")).where("n > 1")
        # Under other names the keys are dealt anew, so that the joins can split a common one.
        other = F.col("key").bitwiseXOR(F.lit(1))
        groups = cut(groups.select(other.alias("other"), "least", (F.col("least") == F.col("most")).alias("alike")))
        same = other == F.col("other")
        if len(by) > 1:
            same &= F.col("ext") == F.col("least")
        kept = cut(items.join(groups, same).select("key", "ext", "tid", "held", "alike"))
        release(texts.sparkSession)
        part = kept.where("alike").select("tid", "held")
        found = part if found is None else found.unionByName(part)
        if step + 1 == len(WIDTHS):
            break
        # In a group that is not alike, ranges that touch the same bytes repeat; one of them stands for them from here on.
        mixed, name = kept.where("not alike"), F.xxhash64("tid", "held")
        classes = mixed.groupBy("key", "ext").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first"))
        classes = classes.select(other.alias("other"), F.col("ext").alias("touched"), "n", "first")
        decided = mixed.join(classes, (other == F.col("other")) & (F.col("ext") == F.col("touched")))
        decided = cut(decided.select("tid", "held", (F.col("n") > 1).alias("done"), (name == F.col("first")).alias("stays")))
        found = found.unionByName(decided.where("done").select("tid", "held"))
        held = texts.join(decided.where("stays").groupBy("tid").agg(F.collect_list("held").alias("held")), "tid").select("tid", "blob", "held")
    return found


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for t1, t2, blob, rows_, spans in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "blob", "copies", "spans")), strict=True):
            text = press.decompress(blob)
            if rows_ > 1 and len(text) >= LENGTH:
                cuts = [(0, len(text))]
            else:
                cuts = []
                for a, b in sorted((at - REACH + first, at - REACH + last + LENGTH) for at, first, last in map(_place, spans or ())):
                    if cuts and a <= cuts[-1][1]:
                        cuts[-1] = (cuts[-1][0], max(b, cuts[-1][1]))
                    else:
                        cuts.append((a, b))
            sha, at = hashlib.sha256(), 0
            for a, b in cuts:
                sha.update(text[at:a])
                at = b
            sha.update(text[at:])
            rows.append((t1, t2, sum(b - a for a, b in cuts), len(cuts), sha.hexdigest(), [a for a, _ in cuts], [b for _, b in cuts]))
        if rows:
            kinds = (*(pa.int64(),) * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["t1", "t2", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (bounds of the removed runs): one row for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    full = rows.mapInArrow(_texts(True), "doc_id long, t1 long, t2 long, n_bytes long, blob binary")
    texts = full.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.first("blob", ignorenulls=True).alias("blob"))
    texts = cut(texts.withColumn("tid", F.monotonically_increasing_id()))  # a number of its own for each text, as written
    spans = repeats(texts.select("tid", "blob")).groupBy("tid").agg(F.collect_list("held").alias("spans"))
    done = texts.join(spans, "tid", "left").select("t1", "t2", "blob", "copies", "spans")
    done = done.mapInArrow(_removed, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
    light = rows.mapInArrow(_texts(False), "doc_id long, t1 long, t2 long, n_bytes long")
    return light.join(done, ["t1", "t2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends")


SQL = f"""
with d as (select doc_id, coalesce(hex(encode(text)), '') as h, coalesce(octet_length(encode(text)), 0) as n from documents),
w as materialized (select doc_id, pos, md5_number(substr(h, 2 * pos + 1, {2 * LENGTH})) as k
    from (select doc_id, h, unnest(range(0, greatest(0, n - {LENGTH - 1}))) as pos from d)),
r as (select doc_id, pos, pos - {LENGTH} > coalesce(lag(pos) over (partition by doc_id order by pos), -1000000) as fresh
    from w where k in (select k from w group by k having count(*) > 1)),
g as (select doc_id, pos, sum(fresh::int) over (partition by doc_id order by pos) as run from r),
s as (select doc_id, min(pos) as a, max(pos) + {LENGTH} as b from g group by doc_id, run),
o as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from s),
k as (select o.doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last,
    string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' order by a) as head from o join d on d.doc_id = o.doc_id group by o.doc_id)
select d.doc_id, d.n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
    sha256(unhex(coalesce(head, '') || substr(d.h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join k on k.doc_id = d.doc_id
"""
