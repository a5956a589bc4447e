"""The same stages over files as they arrive: all are stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docfields.config import Config
from docfields.plans import pipeline, result
from docfields.sources import recorded as source


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded results of the JSON files of a folder, as a stream; files that hold no JSON object are left out, as in a batch."""
    return source.parsed(spark.readStream.schema(source.KIND).options(**source.OPTIONS).json(folder))


def results(rows: DataFrame, templates: DataFrame, config: Config = Config(), as_of: Column | None = None) -> DataFrame:
    """doc_id, error_code, json of a stream of recognised rows."""
    return result.as_json(pipeline.from_boxes(rows, templates, config, as_of), config.mask_id_number)


def write(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, then stop; JSON texts go to Parquet files."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
