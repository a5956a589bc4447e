"""Images from files or bytes.

Spark's image reader decodes PNG, JPEG, BMP and others in the JVM; undecodable files keep a row with an error
code.  Every image becomes three channels of blue, green and red.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "struct<height:int,width:int,n_channels:int,data:binary>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (path), error_code (0, 2001 or 2003), image; a missing path gives one row with 2001."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        return spark.createDataFrame([(path, 2001, None)], f"doc_id string, error_code int, image {IMAGE}")
    rows = spark.read.format("image").load(path)
    bad = F.col("image.width") <= 0
    image = F.struct(*(F.col(f"image.{a}").alias(b) for a, b in (("height", "height"), ("width", "width"), ("nChannels", "n_channels"), ("data", "data"))))
    return rows.select(F.col("image.origin").alias("doc_id"), F.when(bad, 2003).otherwise(0).alias("error_code"), F.when(~bad, image).alias("image"))


def _png(content: bytes) -> np.ndarray | None:
    """Gray, colour and palette PNG of 8 or 16 bits a sample, or fewer for gray and palettes; not interlaced."""
    at, packed, palette = 8, [], None
    width = height = depth = kind = 0
    while at + 8 <= len(content):
        size, name = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != int.from_bytes(content[at + 8 + size : at + 12 + size], "big"):
            return None
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if interlaced:
                return None
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + size
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    step, line = max(1, samples * depth // 8), -(-width * samples * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, line + 1)
    rows, above = np.empty((height, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(height):
        rows[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, :width]
        values = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2).astype(np.uint8)
        px = (values if kind == 3 else values * (255 // ((1 << depth) - 1)))[..., None]
    else:
        px = rows.reshape(height, width, samples, depth // 8)[..., 0]
    if kind == 3:
        return palette[px[..., 0]][..., ::-1]
    return np.repeat(px[..., :1], 3, axis=2) if samples < 3 else px[..., 2::-1]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG as it was before filter ``kind``; ``step`` bytes make a pixel."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        whole = np.zeros(-(-len(line) // step) * step, np.uint8)
        whole[: len(line)] = line
        return np.cumsum(whole.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i in range(len(out)):
        a, b, c = out[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
        if kind == 3:
            near = (a + b) // 2
        else:
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            near = a if da <= db and da <= dc else b if db <= dc else c
        out[i] = (out[i] + near) & 255
    return np.frombuffer(bytes(out), np.uint8)


def _bmp(content: bytes) -> np.ndarray | None:
    """Uncompressed BMP of 8, 24 or 32 bits a pixel."""
    start, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", content, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        return None
    line = -(-width * bits // 32) * 4
    rows = np.frombuffer(content, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = np.frombuffer(content, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)
        return colours[rows[..., 0]][..., :3]
    return rows[..., :3]


def _pnm(content: bytes) -> np.ndarray | None:
    """Binary gray (P5) and colour (P6) maps of up to 255 levels."""
    head = re.match(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", content)
    if not head or not 0 < int(head[4]) < 256:
        return None
    n, width, height = 1 if head[1] == b"5" else 3, int(head[2]), int(head[3])
    px = np.frombuffer(content, np.uint8, width * height * n, head.end()).reshape(height, width, n)
    if int(head[4]) < 255:
        px = (px.astype(np.uint16) * 255 // int(head[4])).astype(np.uint8)
    return np.repeat(px, 3, axis=2) if n == 1 else px[..., ::-1]


def decode(content: bytes | None) -> np.ndarray | None:
    """Rows x columns x 3 (blue, green, red) of an encoded image; None where it cannot be decoded.

    PNG, BMP and PNM are decoded here; other formats (JPEG, TIFF) by OpenCV where that is installed.
    """
    if not content:
        return None
    content = bytes(content)
    for mark, own in ((b"\x89PNG\r\n\x1a\n", _png), (b"BM", _bmp), (b"P5", _pnm), (b"P6", _pnm)):
        if content.startswith(mark):
            try:
                px = own(content)
            except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error):
                return None
            return None if px is None or not px.size else np.ascontiguousarray(px)
    try:
        import cv2
    except ImportError:
        return None
    return cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_COLOR)


#: Bytes of decoded images that leave together, or one larger image alone.
TOGETHER = 8 << 20


def decoded(docs: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, error_code, image of rows (doc_id, encoded bytes): 9001 where there are none, 2003 where they cannot be decoded.

    Small images leave together, so a task holds ``TOGETHER`` bytes of them and one more image at a time.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(_decoded, f"doc_id string, error_code int, image {IMAGE}")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, contents = batch.columns
        start, codes, found, size = 0, [], [], 0
        for i, raw in enumerate(contents):
            raw = raw.as_py()
            px = decode(raw)
            if size and px is not None and size + px.size > TOGETHER:
                yield _batch(names[start:i], codes, found)
                start, codes, found, size = i, [], [], 0
            codes.append(9001 if not raw else 2003 if px is None else 0)
            found.append(px)
            size += 0 if px is None else px.size
        if codes:
            yield _batch(names[start:], codes, found)


def _batch(names: pa.Array, codes: list[int], found: list[np.ndarray | None]) -> pa.RecordBatch:
    none = pa.array([px is None for px in found], pa.bool_())
    sizes = (pa.array([None if px is None else px.shape[k] for px in found], pa.int32()) for k in range(3))
    data = pa.array([None if px is None else px.tobytes() for px in found], pa.binary())
    image = pa.StructArray.from_arrays([*sizes, data], ["height", "width", "n_channels", "data"], mask=none)
    return pa.RecordBatch.from_arrays([names, pa.array(codes, pa.int32()), image], ["doc_id", "error_code", "image"])


def matrix(image: dict | None) -> np.ndarray | None:
    """Rows x columns x 3 of an image struct; None where there is none or its size does not fit."""
    if image is None or not image["data"]:
        return None
    h, w, n = image["height"], image["width"], image["n_channels"]
    flat = np.frombuffer(image["data"], np.uint8)
    if n not in (1, 3, 4) or h <= 0 or w <= 0 or flat.size != h * w * n:
        return None
    px = flat.reshape(h, w, n)
    return np.repeat(px, 3, axis=2) if n == 1 else px[..., :3]


def packed(image: np.ndarray) -> dict:
    px = image if image.ndim == 3 else image[..., None]
    return {"height": px.shape[0], "width": px.shape[1], "n_channels": px.shape[2], "data": np.ascontiguousarray(px).tobytes()}
