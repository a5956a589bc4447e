"""Text recognition engines: the one thing that users plug in.

An engine is made once in each Python worker, from settings that travel with the task.  It turns an image matrix
into (width, height, boxes); a box is (text, confidence, direction, four (x, y) points).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields import schema
from docfields.config import Engine as Settings
from docfields.config import ServiceError
from docfields.sources import images, recorded

Box = tuple[str, float, float, list[tuple[float, float]]]


class Engine(Protocol):
    name: str

    def recognise(self, image: np.ndarray) -> tuple[int, int, list[Box]]: ...


class Mock:
    """Returns recorded boxes whatever the image shows: those of ``mock_data_path``, or the built-in sample."""

    name = "mock"

    def __init__(self, settings: Settings):
        self.size, self.boxes = recorded.SAMPLE_SIZE, [recorded.box(*b) for b in recorded.SAMPLE]
        if settings.mock_data_path:
            import json

            try:
                with open(settings.mock_data_path, encoding="utf-8") as f:
                    tree = json.load(f)
            except (OSError, ValueError) as bad:
                raise ServiceError(1004, f"Recorded data cannot be read: {bad}") from bad
            self.size = (tree.get("image_width", 2480), tree.get("image_height", 3508))
            self.boxes = [
                (b.get("text", ""), b.get("confidence", 0.95), b.get("direction", 0.0), [(p["x"], p["y"]) for p in b["points"]] if len(b.get("points", ())) == 4 else [(0.0, 0.0)] * 4)
                for b in tree.get("boxes", [])
            ]

    def recognise(self, image: np.ndarray) -> tuple[int, int, list[Box]]:
        return *self.size, self.boxes


def recognise_bytes(engine: Engine, content: bytes | None) -> tuple[int, int, list[Box]]:
    """What an engine reads in one encoded image; error 9001 without bytes, 2003 where they cannot be decoded."""
    if not content:
        raise ServiceError(9001, "No image data given")
    image = images.decode(content)
    if image is None:
        raise ServiceError(2003, "The image data cannot be decoded")
    return engine.recognise(image)


def recognise_file(engine: Engine, path: str) -> tuple[int, int, list[Box]]:
    """What an engine reads in one image file; error 2001 where there is none."""
    try:
        with open(path, "rb") as f:
            content = f.read()
    except OSError as missing:
        raise ServiceError(2001, f"Image file not found: {path}") from missing
    if not content:
        raise ServiceError(2003, f"The image cannot be decoded: {path}")
    return recognise_bytes(engine, content)


#: Corners this much apart in height, or less, are of one line.
LINE = 10


def in_reading_order(boxes: list[Box]) -> list[Box]:
    """Boxes by the height and then the left of their first corner; within a line by the left alone.

    A box is moved before those that stand just before it, in its line and further right.
    """
    out: list[Box] = []
    for box in sorted(boxes, key=lambda b: (b[3][0][1], b[3][0][0])):
        (x, y), at = box[3][0], len(out)
        while at and abs(y - out[at - 1][3][0][1]) < LINE and x < out[at - 1][3][0][0]:
            at -= 1
        out.insert(at, box)
    return out


#: Files that a detection or recognition model's folder must hold.
MODEL_FILES = ("inference.json", "inference.pdiparams", "inference.yml")


def model_present(folder: str) -> bool:
    return all(os.path.isfile(os.path.join(folder, f)) for f in MODEL_FILES)


class Paddle:
    """Detection and recognition models, where the library and both model folders are there."""

    name = "paddle"

    def __init__(self, settings: Settings):
        for part in ("det", "rec"):
            if not model_present(os.path.join(settings.model_directory, part)):
                raise ServiceError(1004, f"Model files are missing in {settings.model_directory}/{part}")
        try:
            from paddleocr import PaddleOCR
        except ImportError as missing:
            raise ServiceError(1004, "The recognition library is not installed") from missing
        self.least = settings.minimum_confidence
        self.model = PaddleOCR(
            text_detection_model_dir=os.path.join(settings.model_directory, "det"),
            text_recognition_model_dir=os.path.join(settings.model_directory, "rec"),
            device="cpu",
            cpu_threads=settings.cpu_threads,
        )

    def recognise(self, image: np.ndarray) -> tuple[int, int, list[Box]]:
        boxes = []
        for page in self.model.predict(image):
            for text, score, quad in zip(page["rec_texts"], page["rec_scores"], page["rec_polys"], strict=True):
                if score >= self.least:
                    boxes.append((text, float(score), 0.0, [(float(x), float(y)) for x, y in quad]))
        return image.shape[1], image.shape[0], in_reading_order(boxes)


ENGINES: dict[str, Callable[[Settings], Any]] = {"mock": Mock, "paddle": Paddle}


def register(name: str, make: Callable[[Settings], Any]) -> None:
    """Let settings name another engine; ``make`` travels to the executors."""
    ENGINES[name] = make


def checked(settings: Settings) -> Callable[[Settings], Any]:
    """The maker of the engine that the settings name, after one has been made; unknown names are error 1002."""
    if settings.engine not in ENGINES:
        raise ServiceError(1002, f"Unknown engine: {settings.engine}")
    ENGINES[settings.engine](settings)
    return ENGINES[settings.engine]


def recognised(docs: DataFrame, settings: Settings, make: Callable[[Settings], Any] | None = None) -> DataFrame:
    """``docs`` (doc_id, error_code, image, ...) with the image replaced by image_width, image_height and boxes.

    Rows that already have an error pass by; an engine that fails leaves error 3001 on the row.
    """
    maker = make or checked(settings)
    if maker is Mock:
        return _recorded(docs, Mock(settings))
    rest = [c for c in docs.schema if c.name not in ("image", "error_code")]
    out = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rest) + f", error_code int, image_width int, image_height int, boxes {schema.BOXES}"

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = maker(settings)
        for frame in frames:
            found = []
            for code, image in zip(frame["error_code"], frame["image"], strict=True):
                row = (code, None, None, None)
                if code == 0:
                    try:
                        width, height, boxes = engine.recognise(images.matrix(image))
                        row = (0, width, height, [{"text": t, "confidence": c, "direction": d, "points": [{"x": x, "y": y} for x, y in p]} for t, c, d, p in boxes])
                    except Exception:  # an engine may raise anything; the row tells
                        row = (3001, None, None, None)
                found.append(row)
            new = pd.DataFrame(found, columns=["error_code", "image_width", "image_height", "boxes"], index=frame.index)
            yield pd.concat([frame[[c.name for c in rest]], new.astype({"image_width": "Int32", "image_height": "Int32", "error_code": "int32"})], axis=1)

    return docs.select(*(c.name for c in rest), F.col("error_code").cast("int").alias("error_code"), "image").mapInPandas(go, out)


def _recorded(docs: DataFrame, engine: Mock) -> DataFrame:
    """The same for boxes that do not depend on the image: one row with them meets all, without Python."""
    boxes = [(t, c, d, [tuple(map(float, p)) for p in points]) for t, c, d, points in engine.boxes]
    one = docs.sparkSession.createDataFrame([(*engine.size, boxes)], f"image_width int, image_height int, boxes {schema.BOXES}").withColumnsRenamed(
        {"image_width": "_width", "image_height": "_height", "boxes": "_boxes"}
    )
    well = F.col("error_code") == 0
    rest = [c for c in docs.columns if c not in ("image", "error_code")]
    return docs.crossJoin(F.broadcast(one)).select(
        *rest, F.col("error_code").cast("int").alias("error_code"), *(F.when(well, F.col(f"_{n}")).alias(name) for n, name in (("width", "image_width"), ("height", "image_height"), ("boxes", "boxes")))
    )
