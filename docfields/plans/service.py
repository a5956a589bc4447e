"""The service: settings, engine and templates once, then batches of files or bytes."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import docfields
from docfields import config as settings
from docfields.config import Config, ServiceError
from docfields.plans import pipeline
from docfields.sources import engines, images, templates


class Service:
    """Made ready with ``init`` and closed with ``shutdown``; errors carry the codes of ``schema.ERRORS``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.config: Config | None = None
        self.templates: DataFrame | None = None
        self.last_error = ""

    def _fail(self, code: int, message: str) -> ServiceError:
        self.last_error = message
        return ServiceError(code, message)

    def init(self, model_directory: str = "", config_path: str | None = None) -> None:
        if self.config is not None:
            raise self._fail(1005, "Already initialized; shut down first")
        try:
            config = settings.load(config_path)
            if model_directory:
                config = Config(settings.Engine(**{**vars(config.engine), "model_directory": model_directory}), config.preprocess, config.quality, config.mask_id_number, config.templates_directory)
            engines.checked(config.engine)
        except ServiceError as bad:
            self.last_error = str(bad)
            raise
        self.templates = templates.read(self.spark, config.templates_directory) if config.templates_directory else templates.from_json(self.spark, [])
        self.config, self.last_error = config, ""

    def shutdown(self) -> None:
        self.config = self.templates = None

    def _ready(self) -> Config:
        if self.config is None:
            raise self._fail(1001, "Not initialized")
        return self.config

    def recognize_files(self, path: str | None, as_of: str | None = None) -> DataFrame:
        """doc_id, error_code, json for each image of a path (a file, a folder or a pattern)."""
        config = self._ready()
        if not path:
            raise self._fail(9001, "No path given")
        return pipeline.run(images.read(self.spark, path), self.templates, config, None if as_of is None else F.lit(as_of))

    def recognize_images(self, docs: DataFrame, as_of: str | None = None) -> DataFrame:
        """The same for rows (doc_id, image); null images are error 9001."""
        config = self._ready()
        rows = docs.withColumn("error_code", F.when(F.col("image").isNull() | (F.octet_length("image.data") == 0), 9001).otherwise(0))
        return pipeline.run(rows, self.templates, config, None if as_of is None else F.lit(as_of))

    def recognize_bytes(self, docs: DataFrame, as_of: str | None = None) -> DataFrame:
        """The same for rows (doc_id, content) of encoded images; null or empty bytes are error 9001, undecodable ones 2003."""
        config = self._ready()
        return pipeline.run(images.decoded(docs), self.templates, config, None if as_of is None else F.lit(as_of))

    @staticmethod
    def version() -> str:
        return docfields.__version__


def main(args: list[str]) -> int:
    """``image [config]``: prints the results and returns the first error code."""
    if not args:
        print("usage: image [config]", file=sys.stderr)
        return 9001
    service = Service(SparkSession.builder.getOrCreate())
    try:
        service.init(config_path=args[1] if len(args) > 1 else None)
        code = 0
        for row in service.recognize_files(args[0]).toLocalIterator():
            print(row["json"])
            code = code or row["error_code"]
        return code
    except ServiceError as bad:
        print(f"Error {bad.code}: {bad}", file=sys.stderr)
        return bad.code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) and 1)
