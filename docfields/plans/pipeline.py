"""The whole way from images, or from recorded boxes, to result documents.

Pixels are touched in one Arrow stage (quality and preprocessing) and one engine stage; everything else is
columns.  Rows that fail keep their error code and go on to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields import schema
from docfields.config import Config
from docfields.operators import imaging
from docfields.plans import extraction, result
from docfields.sources import engines, images

NO_DOCUMENT = "No document detected — image may be empty or too small"
NO_OUTLINE = "Document contour not detected — using original image"


def prepared(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, error_code, image, quality, page_type, early: images judged and made ready for recognition.

    Images that are too small are judged by their size alone, without their pixels.
    """
    out = f"doc_id string, error_code int, image {images.IMAGE}, quality {schema.QUALITY}, page_type string, early array<string>"
    least = config.quality

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, code, image in zip(frame["doc_id"], frame["error_code"], frame["image"], strict=True):
                if code:
                    rows.append((doc, code, None, None, "unknown", []))
                    continue
                px = images.matrix(image)
                q = imaging.quality(px, config.quality)
                usable = q.pop("usable")
                if not usable:
                    rows.append((doc, 2003 if px is None else 2004, None, q, "unknown", [NO_DOCUMENT]))
                    continue
                done, found = imaging.process(px, config.preprocess)
                early = [NO_OUTLINE] if config.preprocess.enable_document_detection and not found["found"] else []
                rows.append((doc, 0, images.packed(done), q, found["page_type"], early))
            yield pd.DataFrame(rows, columns=["doc_id", "error_code", "image", "quality", "page_type", "early"])

    small = (F.col("error_code") == 0) & ((F.col("image.width") < least.minimum_width) | (F.col("image.height") < least.minimum_height))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("error_code").cast("int").alias("error_code"), "image")
    small = F.coalesce(small, F.lit(False))
    quality = F.expr(f"cast(named_struct('blur_score', 0D, 'is_blurry', false, 'is_overexposed', false, 'document_detected', false) as {schema.QUALITY})")
    refused = rows.where(small).select(
        "doc_id", F.lit(2004).alias("error_code"), F.lit(None).cast(images.IMAGE).alias("image"), quality.alias("quality"), F.lit("unknown").alias("page_type"),
        F.array(F.lit(NO_DOCUMENT)).alias("early"),
    )
    return rows.where(~small).mapInPandas(go, out).unionByName(refused)


def from_boxes(rows: DataFrame, templates: DataFrame, config: Config = Config(), as_of: Column | None = None) -> DataFrame:
    """Extraction of recognised rows; columns of earlier stages get their defaults where they are missing."""
    defaults = {
        "error_code": F.lit(0),
        "page_type": F.lit("unknown"),
        "early": F.array().cast("array<string>"),
        "quality": F.expr(f"cast(named_struct('blur_score', 0D, 'is_blurry', false, 'is_overexposed', false, 'document_detected', true) as {schema.QUALITY})"),
    }
    rows = rows.withColumns({k: c for k, c in defaults.items() if k not in rows.columns})
    found = extraction.extraction(rows, templates, as_of, config.mask_id_number)
    bad = F.col("error_code") != 0
    blurry = F.coalesce(F.col("quality.is_blurry"), F.lit(False))
    late = F.when(
        blurry, F.array(F.concat(F.lit("Image may be slightly blurry (score: "), F.floor("quality.blur_score").cast("string"), F.lit(")")))
    ).otherwise(F.array().cast("array<string>"))
    return found.withColumn("warnings", F.when(bad, F.col("early")).otherwise(F.concat("early", "warnings", late))).withColumns(
        {"type": F.when(bad, "unknown").otherwise(F.col("type")), "template_id": F.when(bad, "").otherwise(F.col("template_id"))}
    )


def run(docs: DataFrame, templates: DataFrame, config: Config = Config(), as_of: Column | None = None) -> DataFrame:
    """doc_id, error_code, json of images (doc_id, error_code, image)."""
    rows = engines.recognised(prepared(docs, config), config.engine)
    return result.as_json(from_boxes(rows, templates, config, as_of), config.mask_id_number)
