"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, normalised and rotated by a random orthogonal matrix; the signs of the components, packed
into 64-bit words, and two correction scalars stand for a vector.  A query is rotated alike and cut to ``PLANES``
bits a component; its inner product with a code is a sum of bit counts of words, one for each bit plane.  From
that and the scalars come estimates of the inner products with the vectors, each with an error bound; only vectors
whose upper bound reaches the k-th best so far are scored, in double precision, on the vectors as they are.

All vectors are coded once, into chunks that are written to the checkpoint folder.  Queries are taken in blocks of
``BLOCK`` bytes at most, each sent to all tasks, which go over the codes.  A row's place in the chunks is its
identity: vectors that are null, zero or hold null or non-finite components take no part, neither as queries nor
as candidates; only vectors of the query's length are its candidates; of a repeated id each row is a candidate and
each a query, with a list of its own, and only the query's own row is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.base import cut

K, EVERY = 20, 20
#: Bytes of queries that are sent out together, bytes of vectors in a chunk, and queries that meet a chunk at once.
BLOCK, CHUNK, TOGETHER = 16 << 20, 2 << 20, 32
#: Bits of a component of a query.
PLANES = 5
#: Standard deviations of the error bound, and how many times k of the likeliest vectors of the first chunk are scored at once.
SURE, FIRST = 2.0, 3
#: Below every estimate.
LOW = np.finfo(np.float32).min


def rotation(dim: int) -> np.ndarray:
    """Random orthogonal matrix, the same for a dimension on every call."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    wide = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), np.uint8)
    wide[..., : packed.shape[-1]] = packed
    return wide.view(np.uint64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distance to the centre, and inner product of the unit vector with its own code."""
    d = x - centre
    norm = np.sqrt((d**2).sum(1))
    unit = (d / np.where(norm > 0, norm, 1)[:, None]) @ turn
    return _words(unit > 0), norm.astype(np.float32), (np.abs(unit).sum(1) / np.sqrt(x.shape[1])).astype(np.float32)


class Queries:
    """Queries of one length: what estimates need, and the k best rows found so far of each."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, k: int = K):
        self.rows, self.ids, self.q, self.k, dim = rows, ids, vectors, k, vectors.shape[1]
        turned = vectors @ rotation(dim)
        low = turned.min(1, keepdims=True)
        self.step = np.maximum((turned.max(1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
        whole = np.rint((turned - low) / self.step).astype(np.int64)
        self.planes = np.stack([_words((whole >> b) & 1) for b in range(PLANES)])
        self.low, self.whole = low[:, 0], whole.sum(1)
        self.lost = np.sqrt(((turned - low - self.step * whole) ** 2).sum(1) / dim)
        self.step, self.centred, self.length = self.step[:, 0], vectors @ centre, np.sqrt((vectors**2).sum(1))
        self.least = np.full(len(ids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def estimate(self, part: slice, codes: np.ndarray, norm: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries of ``part`` x vectors) and their error bounds."""
        dim = self.q.shape[1]
        both = np.zeros((len(self.ids[part]), len(codes)), np.int32)
        for w in range(codes.shape[1]):
            for b in range(PLANES):
                both += np.left_shift(np.bitwise_count(codes[None, :, w] & self.planes[b, part, w, None]), b, dtype=np.int32)
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        # The code is +-1 in each place: what the query has at its ones counts twice, less what the query has in all.
        column = lambda x: np.asarray(x, np.float32)[:, None]
        signed = both.astype(np.float32) * column(2 * self.step[part]) + column(self.low[part]) * (2 * ones - dim).astype(np.float32) - column(self.step[part] * self.whole[part])
        scale = np.where(own > 0, norm / np.where(own > 0, own, 1), 0).astype(np.float32)
        mid = signed * (scale / np.float32(np.sqrt(dim))) + column(self.centred[part])
        spread = scale * np.sqrt(np.maximum(0, 1 - own**2) / max(1, dim - 1)).astype(np.float32)
        length = self.length[part]
        error = column(SURE * length) * spread + column(SURE * self.lost[part] + 1e-5 * length) * scale + column(1e-5 * (np.abs(self.centred[part]) + length * 1e-3))
        return mid, error

    def add(self, rows: np.ndarray, ids: np.ndarray, codes: np.ndarray, norm: np.ndarray, own: np.ndarray, x: np.ndarray) -> None:
        """Meet a chunk of vectors."""
        for at in range(0, len(self.ids), TOGETHER):
            part = slice(at, at + TOGETHER)
            mid, error = self.estimate(part, codes, norm, own)
            if not np.isfinite(self.least[part]).all():
                # The likeliest set the bar for the rest.
                most = min(FIRST * self.k, len(ids))
                for j, which in enumerate(np.argpartition(-mid, most - 1, axis=1)[:, :most]):
                    self._open(at + j, rows[which], ids[which], x[which])
                    mid[j, which] = -np.inf
            mid += error
            hits = mid >= np.maximum(self.least[part], LOW)[:, None]
            for j in np.flatnonzero(hits.any(1)).tolist():
                which = np.flatnonzero(hits[j])
                self._open(at + j, rows[which], ids[which], x[which])

    def _open(self, k: int, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        q = self.q[k]
        rough = x @ q
        keep = (rough >= self.least[k] - 1e-9 * (1 + self.length[k] * np.abs(rough))) & (rows != self.rows[k])
        if not keep.any():
            return
        # Sums of equal vectors are equal here, whatever stands beside them.
        scores, names, places = (np.concatenate(c) for c in zip(self.found[k], (np.einsum("ij,j->i", x[keep], q), ids[keep], rows[keep]), strict=True))
        order = np.lexsort((places, names, -scores))[: self.k]
        self.found[k] = scores[order], names[order], places[order]
        if len(order) == self.k:
            self.least[k] = self.found[k][0][-1]


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the batch by length."""
    column = batch.column("embedding")
    ids, lengths = batch.column("vec_id").to_numpy(), pa.compute.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        yield ids[own], flat[starts[own][:, None] + np.arange(n)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part; components are doubles unless they are floats."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(
        "vec_id is not null and embedding is not null"
    ).where(F.coalesce(sound, F.lit(False)))


_CHUNK = "first long, dim int, ids binary, codes binary, norm binary, own binary, vectors binary, size int"


def chunks(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """The coded vectors, in rows of vectors of one length; ``first`` numbers the rows of ``usable`` vectors."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, first = {}, TaskContext.get().partitionId() << 40
        for batch in batches:
            for ids, x in _vectors(batch):
                dim = x.shape[1]
                if dim not in turns:
                    turns[dim] = rotation(dim)
                most = max(1, CHUNK // (8 * dim))
                for at in range(0, len(ids), most):
                    part = x[at : at + most]
                    columns = [ids[at : at + most], *encode(part.astype(np.float64), centres[dim], turns[dim]), part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([first], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([x.itemsize], pa.int32())],
                        ["first", "dim", "ids", "codes", "norm", "own", "vectors", "size"],
                    )
                    first += len(part)

    return cut(rows.mapInArrow(go, _CHUNK))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(length, (rows, ids, codes, norm, own, vectors)) of each chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            first, dim, ids, codes, norm, own, vectors, size = (batch.column(c)[i] for c in range(8))
            raw = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
            ids, dim = raw(ids, np.int64), dim.as_py()
            x = raw(vectors, np.float32 if size.as_py() == 4 else np.float64).reshape(-1, dim).astype(np.float64)
            yield dim, (first.as_py() + np.arange(len(ids)), ids, raw(codes, np.uint64).reshape(len(ids), -1), raw(norm, np.float32), raw(own, np.float32), x)


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each vector whose id is divisible by ``every``."""
    spark, rows = vectors.sparkSession, usable(vectors)
    means = rows.select(F.size("embedding").alias("dim"), F.posexplode("embedding")).groupBy("dim", "pos").agg(F.avg("col").alias("mean"))
    centres: dict[int, np.ndarray] = {}
    for dim, part in means.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m")).collect():  # one vector a length
        centres[dim] = np.array([m["mean"] for m in part])
    coded = chunks(rows, centres)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, (places, ids, _, _, _, x) in _read(batches):
            own = np.flatnonzero(ids % every == 0)
            columns = [pa.array(places[own]), pa.array(ids[own]), pa.array(np.full(len(own), dim, np.int32)), pa.array([v.tobytes() for v in x[own]], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["place", "vec_id", "dim", "vector"])

    queries = coded.mapInArrow(asking, "place long, vec_id long, dim int, vector binary")
    blocks = max(1, -(-8 * (queries.agg(F.sum("dim")).first()[0] or 0) // BLOCK))
    found = None
    for b in range(blocks):
        sent: dict[int, tuple[np.ndarray, ...]] = {}
        own = queries.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b).toPandas()  # about BLOCK bytes
        for dim, part in own.sort_values("place").groupby("dim"):
            sent[dim] = part["place"].to_numpy(), part["vec_id"].to_numpy(), np.frombuffer(b"".join(part["vector"]), np.float64).reshape(-1, dim)
        out = spark.sparkContext.broadcast((sent, centres))  # a block of queries, and one mean a length

        def go(batches: Iterator[pa.RecordBatch], out=out) -> Iterator[pa.RecordBatch]:
            sent, centres = out.value
            best: dict[int, Queries] = {}
            for dim, chunk in _read(batches):
                if dim in sent:
                    if dim not in best:
                        best[dim] = Queries(*sent[dim], centres[dim], k)
                    best[dim].add(*chunk)
            for own in best.values():
                n = [len(f[0]) for f in own.found]
                scores, ids, places = (np.concatenate(c) for c in zip(*own.found, strict=True))
                columns = [np.repeat(own.rows, n), np.repeat(own.ids, n), ids, scores, places]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "query_id", "vec_id", "score", "at"])

        part = coded.mapInArrow(go, "place long, query_id long, vec_id long, score double, at long")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("place").orderBy(F.col("score").desc(), "vec_id", "at")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
