"""Encoded images: every PNG filter and colour type, bitmaps, broken bytes, and the ways to an engine from bytes and files."""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docfields.config import Engine as Settings
from docfields.config import ServiceError
from docfields.plans import service
from docfields.sources import engines, images, recorded
from docfields.streaming import files


def png(px, kind, depth=8, palette=None):
    """Rows x columns x samples as a PNG whose lines take the five filters in turn."""
    height, width, samples = px.shape
    if depth == 16:
        lines = px.astype(">u2").view(np.uint8).reshape(height, -1)
    elif depth < 8:
        bits = ((px[..., 0][..., None] >> np.arange(depth - 1, -1, -1)) & 1).astype(np.uint8)
        lines = np.packbits(bits.reshape(height, -1), axis=1)
    else:
        lines = px.astype(np.uint8).reshape(height, -1)
    step, out, above = max(1, samples * depth // 8), b"", [0] * lines.shape[1]
    for y, line in enumerate(lines.astype(int).tolist()):
        coded = []
        for i, v in enumerate(line):
            a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda x: abs(p - x))
            coded.append((v - (0, a, b, (a + b) // 2, paeth)[y % 5]) % 256)
        out += bytes([y % 5, *coded])
        above = line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


rng = np.random.default_rng(3)


@pytest.mark.parametrize("kind,samples,depth", [(0, 1, 8), (2, 3, 8), (4, 2, 8), (6, 4, 8), (2, 3, 16), (0, 1, 16), (0, 1, 1), (0, 1, 4), (3, 1, 8), (3, 1, 2)])
def test_png(kind, samples, depth):
    px = rng.integers(0, 1 << min(depth, 16), (13, 11, samples))
    palette = rng.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8) if kind == 3 else None
    got = images.decode(png(px, kind, depth, palette))
    if kind == 3:
        want = palette[px[..., 0]][..., ::-1]
    else:
        eight = px >> 8 if depth == 16 else px * (255 // ((1 << depth) - 1)) if depth < 8 else px
        want = np.repeat(eight[..., :1], 3, axis=2) if samples < 3 else eight[..., 2::-1]
    assert got.shape == (13, 11, 3) and (got == want).all()


def bmp(px):
    height, width, _ = px.shape
    lines = b"".join(px[y].astype(np.uint8).tobytes().ljust(-(-width * 3 // 4) * 4, b"\0") for y in reversed(range(height)))
    return b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines


def test_other_formats_and_broken_bytes():
    px = rng.integers(0, 256, (5, 7, 3))
    assert (images.decode(bmp(px)) == px).all()
    assert (images.decode(b"P6\n# made\n7 5\n255\n" + px[..., ::-1].astype(np.uint8).tobytes()) == px).all()
    whole = png(px, 2)
    for broken in (None, b"", b"x", whole[:20], whole[:60], whole.replace(b"IDAT", b"IDAX"), b"BM", bmp(px)[:70], b"P5 9 9 255\nshort"):
        assert images.decode(broken) is None, broken


def test_bytes_to_results(spark, tmp_path):
    page = np.full((1200, 900, 3), 255)
    page[100:1100:40, 100:800] = 0
    made = service.Service(spark)
    made.init()
    rows = [("good", b"P5 900 1200 255\n" + page[..., 0].astype(np.uint8).tobytes()), ("small", png(page[:40, :40], 2)), ("broken", b"\x89PNG\r\n\x1a\nxx"), ("none", None), ("empty", b"")]
    got = {r["doc_id"]: r for r in made.recognize_bytes(spark.createDataFrame(rows, "doc_id string, content binary")).collect()}
    assert {k: r["error_code"] for k, r in got.items()} == {"good": 0, "small": 2004, "broken": 2003, "none": 9001, "empty": 9001}
    assert json.loads(got["good"]["json"])["document"]["image_width"] == recorded.SAMPLE_SIZE[0]
    # The same page as a file, through the JVM's reader.
    (tmp_path / "page.png").write_bytes(png(page, 2))
    assert (images.matrix(images.read(spark, str(tmp_path)).first()["image"].asDict()) == page).all()
    assert [r["error_code"] for r in made.recognize_files(str(tmp_path)).collect()] == [0]


def test_small_images_leave_together():
    def sent(contents):
        batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(contents))]), pa.array(contents, pa.binary())], ["doc_id", "content"])
        return list(images._decoded(iter([batch.slice(0, 0), batch])))

    small = [b"P5 3 2 255\n" + bytes([i % 256] * 6) for i in range(2000)]
    one = sent([None, b"", b"P5 3 2 255\nxx", *small])
    assert [len(b) for b in one] == [2003]  # a batch each once
    rows = one[0].to_pylist()
    assert [r["error_code"] for r in rows[:4]] == [9001, 9001, 2003, 0] and [r["doc_id"] for r in rows] == [str(i) for i in range(2003)]
    assert [r["image"] for r in rows[:3]] == [None] * 3
    assert [r["image"] for r in rows[3:]] == [{"height": 2, "width": 3, "n_channels": 3, "data": bytes([i % 256] * 18)} for i in range(2000)]
    large = b"P5 2000 1000 255\n" + bytes(2_000_000)  # 6 MB decoded
    whole = sent([small[0], large, small[1], None, large, b"P5 4000 1000 255\n" + bytes(4_000_000), small[2]])
    assert [[r["doc_id"] for r in b.to_pylist()] for b in whole] == [["0", "1", "2", "3"], ["4"], ["5"], ["6"]]


def test_engines_from_bytes_and_files(tmp_path):
    class Sized:
        name = "sized"

        def recognise(self, image):
            return image.shape[1], image.shape[0], []

    px = rng.integers(0, 256, (5, 7, 3))
    (tmp_path / "a.bmp").write_bytes(bmp(px))
    (tmp_path / "empty").write_bytes(b"")
    assert engines.recognise_bytes(Sized(), png(px, 2)) == engines.recognise_file(Sized(), str(tmp_path / "a.bmp")) == (7, 5, [])
    for code, call in ((9001, lambda: engines.recognise_bytes(Sized(), None)), (2003, lambda: engines.recognise_bytes(Sized(), b"x")), (2001, lambda: engines.recognise_file(Sized(), str(tmp_path / "no"))), (2003, lambda: engines.recognise_file(Sized(), str(tmp_path / "empty")))):
        with pytest.raises(ServiceError) as raised:
            call()
        assert raised.value.code == code


def test_reading_order():
    boxes = [(str(i), 1.0, 0.0, [(float(x), float(y))] * 4) for i, (x, y) in enumerate(rng.integers(0, 60, (40, 2)))]
    want = sorted(boxes, key=lambda b: (b[3][0][1], b[3][0][0]))
    for i in range(len(want) - 1):  # neighbours change places, from each box back to the first
        for j in range(i, -1, -1):
            (x1, y1), (x2, y2) = want[j][3][0], want[j + 1][3][0]
            if abs(y2 - y1) >= engines.LINE or x2 >= x1:
                break
            want[j], want[j + 1] = want[j + 1], want[j]
    assert engines.in_reading_order(boxes) == want and engines.in_reading_order([]) == []


def test_mock_ignores_images_and_keeps_errors(spark):
    docs = spark.createDataFrame([("a", 0, 5), ("b", 2004, 6)], "doc_id string, error_code int, extra int").selectExpr("*", f"cast(null as {images.IMAGE}) as image")
    rows = {r["doc_id"]: r for r in engines.recognised(docs, Settings()).collect()}
    assert (rows["a"]["extra"], len(rows["a"]["boxes"]), rows["a"]["image_height"]) == (5, len(recorded.SAMPLE), recorded.SAMPLE_SIZE[1])
    assert (rows["b"]["error_code"], rows["b"]["boxes"], rows["b"]["image_width"]) == (2004, None, None)


def test_streams_leave_out_what_batches_leave_out(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.json").write_text('{"boxes": [{"text": "x"}]}')
    (folder / "bad.json").write_text('{"boxes": [')
    query = files.write(files.recorded(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    streamed, batch = spark.read.parquet(str(tmp_path / "out")).collect(), recorded.read(spark, str(folder)).collect()
    assert len(batch) == 1 and [tuple(r) for r in streamed] == [tuple(r) for r in batch]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "page.bmp").write_bytes(bmp(np.full((900, 900, 3), 200)))
    assert service.main([]) == 9001 and "usage" in capsys.readouterr().err
    assert service.main([str(tmp_path / "nothing.png")]) == 2001
    capsys.readouterr()
    assert service.main([str(tmp_path / "page.bmp")]) == 0 and json.loads(capsys.readouterr().out)["document"]["image_width"] == recorded.SAMPLE_SIZE[0]
    assert service.main([str(tmp_path / "page.bmp"), str(tmp_path / "none.json")]) == 1003
