"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages that together hold its whole text.  Each passage is encoded from hashed byte
pairs; gated attention, learnt from document labels alone, weighs the passages; the weighted representation is
scored.  Training uses a bounded sample of labelled documents: by hash, ``SAMPLE`` of each label at most, and of these
whole documents while they hold ``BYTES`` bytes at most together; every passage of a sampled document is in its bag.
Scoring reads every passage of every document.

Null and empty texts are one empty passage and get a score; repeated rows each keep their own row, and teach once, by
the text of least hash; documents with contradicting or null labels teach nothing; with labels of one kind only (or
none) every score is that label (or 0.5).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.base import cut, frugal, slices, through_arrow

SAMPLE, BYTES = 2000, 8 << 20
PASSAGE, WIDTH = 400, 512
#: Passages that are encoded at once.
AT_ONCE = 256
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE = 12, 64, 3e-3
ACCEPT = 0.7

_rng = np.random.default_rng(11)
_FIRST, _SECOND = (_rng.integers(0, WIDTH, 256) for _ in range(2))


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encodings (passages x WIDTH + 2) and the number of passages of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    bags = np.maximum(1, (sizes + PASSAGE // 2) // PASSAGE)
    first = np.cumsum(bags) - bags
    nth = np.arange(bags.sum()) - np.repeat(first, bags)
    n, k = np.repeat(sizes, bags), np.repeat(bags, bags)
    lengths = (nth + 1) * n // k - nth * n // k
    joined, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths)
    out = np.empty((len(lengths), WIDTH + 2), np.float32)
    for at in range(0, len(lengths), AT_ONCE):  # the steps between hold many times the bytes of the passages
        own = lengths[at : at + AT_ONCE]
        out[at : at + AT_ONCE] = _encoded(joined[ends[at] - own[0] : ends[at] + own[1:].sum()], own)
    return out, bags


def _encoded(joined: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Encodings of passages of these lengths that stand one after the other."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    pair = _FIRST[joined[:-1]] + _SECOND[joined[1:]] if len(joined) > 1 else np.zeros(0, np.int64)
    same = owner[1:] == owner[:-1]
    counts = np.bincount(owner[:-1][same] * WIDTH + pair[same] % WIDTH, minlength=len(lengths) * WIDTH).reshape(-1, WIDTH)
    share = counts / np.maximum(1, lengths)[:, None]
    dense = np.sqrt((share**2).sum(1))
    extra = np.stack([4 * dense, np.log1p(lengths) / 6], 1)
    return np.concatenate([4 * np.sqrt(share), extra], 1)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text", 2 << 20):
        x, bags = passages(texts)
        ends = np.cumsum(bags)
        blobs = [x[e - n : e].astype(np.float16).tobytes() for n, e in zip(bags, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("doc_id"), pa.array(blobs, pa.binary())], ["label", "doc_id", "bag"])


@dataclass
class Model:
    """Weights; ``constant`` replaces them where the labels teach nothing."""

    w: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, dict]:
        w, starts, owner = self.w, np.cumsum(bags) - bags, np.repeat(np.arange(len(bags)), bags)
        h = np.tanh(x @ w["e"] + w["eb"])
        v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        s = (v * u) @ w["a"]
        s = np.exp(s - np.maximum.reduceat(s, starts)[owner])
        a = s / np.add.reduceat(s, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["ob"], -30, 30)))
        return p, {"h": h, "v": v, "u": u, "a": a, "z": z, "owner": owner, "starts": starts}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x, bags = passages(texts)
        return self.forward(x, bags)[0].astype(np.float64)


def fit(bags: list[tuple[int, np.ndarray]]) -> Model:
    """Model from (label, encodings) bags, by Adam on the class-balanced log loss."""
    labels = {y for y, _ in bags}
    if len(labels) < 2:
        return Model({}, float(labels.pop()) if labels else 0.5)
    rng = np.random.default_rng(5)
    d = bags[0][1].shape[1]
    normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"e": normal(d, HIDDEN), "eb": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN, GATE), "u": normal(HIDDEN, GATE)}
    w |= {"a": normal(GATE), "o": normal(HIDDEN), "ob": np.zeros((), np.float32)}
    model, m, v2 = Model(w), {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    share = sum(y for y, _ in bags) / len(bags)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            part = [bags[i] for i in order[at : at + BATCH]]
            x, n = np.concatenate([b for _, b in part]).astype(np.float32), np.array([len(b) for _, b in part])
            y = np.array([y for y, _ in part], np.float32)
            p, c = model.forward(x, n)
            weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
            dp = (weight * (p - y) / len(y)).astype(np.float32)
            g = {"o": c["z"].T @ dp, "ob": dp.sum()}
            dz = (dp[:, None] * w["o"])[c["owner"]]
            da = (dz * c["h"]).sum(1)
            ds = c["a"] * (da - np.add.reduceat(c["a"] * da, c["starts"])[c["owner"]])
            g["a"] = (c["v"] * c["u"]).T @ ds
            gate = ds[:, None] * w["a"]
            dv, du = gate * c["u"] * (1 - c["v"] ** 2), gate * c["v"] * c["u"] * (1 - c["u"])
            g |= {"v": c["h"].T @ dv, "u": c["h"].T @ du}
            dh = (c["a"][:, None] * dz + dv @ w["v"].T + du @ w["u"].T) * (1 - c["h"] ** 2)
            g |= {"e": x.T @ dh, "eb": dh.sum(0)}
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, usable: str = "true") -> Model:
    """Model from the labelled documents for which ``usable`` (SQL over doc_id) holds.

    At most ``SAMPLE`` documents and ``BYTES`` bytes of text of each label teach; their encodings reach the driver.
    """
    clear = labels.where("doc_id is not null and quality in (0, 1)").where(usable).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    clear = clear.where("label = most").selectExpr("cast(doc_id as bigint) doc_id", "cast(label as int) label")
    one = lambda y: clear.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    few = one(0).unionByName(one(1))  # 2 x SAMPLE ids at most
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(cast(text as string), '') text").join(F.broadcast(few), "doc_id")
    # One row an id, however many there are; partial aggregates keep one each.
    found = cut(texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    chosen, sizes = [], [0, 0]
    for r in found.select("doc_id", "label", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # 2 x SAMPLE rows at most
        if sizes[r["label"]] + r["size"] <= BYTES:
            sizes[r["label"]] += r["size"]
            chosen.append((r["doc_id"],))
    if not chosen:
        return fit([])
    own = found.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long")), "doc_id")
    rows = own.select("label", "doc_id", "text").mapInArrow(frugal(_encode), "label int, doc_id long, bag binary").collect()
    rows.sort(key=lambda r: (r["label"], r["doc_id"]))
    return fit([(r["label"], np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH + 2)) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of ``docs``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(texts), pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(frugal(go), "doc_id long, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``ACCEPT``, columns as they are."""

    text = f"c{docs.columns.index('text')}"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text, 2 << 20):
            yield batch.filter(pa.array(model.score(texts) >= ACCEPT))

    return through_arrow(docs, go)
