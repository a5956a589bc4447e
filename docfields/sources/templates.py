"""Extraction templates: JSON files, read into one row a template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields import schema

_LISTS = ("hospital_keywords", "title_keywords", "required_keywords", "optional_keywords")
_NONE = "cast(array() as array<string>)"


def _rules(fields: Column) -> Column:
    """array<struct<name, rule>> by ascending name, with defaults filled in."""
    fields = F.coalesce(fields, F.expr(f"cast(map() as map<string,{schema.RULE}>)"))

    def one(e: Column) -> Column:
        r = e["value"]
        direction = F.coalesce(r["search_direction"], F.lit("right"))
        words = lambda k: F.coalesce(r[k], F.expr(_NONE)).alias(k)
        kind = F.coalesce(r["extraction_type"], F.when(direction == "below", "anchor_below").otherwise("anchor_right"))
        return F.struct(
            e["key"].alias("name"),
            F.struct(
                words("anchors"),
                direction.alias("search_direction"),
                F.coalesce(r["same_line_tolerance"], F.lit(20)).alias("same_line_tolerance"),
                F.coalesce(r["max_distance"], F.lit(250)).alias("max_distance"),
                F.when(F.size(r["region"]) == 4, r["region"]).alias("region"),
                F.coalesce(r["data_type"], F.lit("string")).alias("data_type"),
                kind.alias("extraction_type"),
                words("start_anchors"),
                words("end_anchors"),
            ).alias("rule"),
        )

    keys = F.array_sort(F.map_keys(fields))
    return F.transform(keys, lambda k: one(F.struct(k.alias("key"), F.try_element_at(fields, k).alias("value"))))


def parsed(rows: DataFrame) -> DataFrame:
    """Templates from rows of ``schema.TEMPLATE`` plus load_order: defaults filled in, those without an id left out."""
    return rows.where("coalesce(template_id, '') <> ''").select(
        "load_order",
        "template_id",
        F.coalesce("document_type", F.lit("unknown")).alias("document_type"),
        F.coalesce("description", F.lit("")).alias("description"),
        *(F.coalesce(k, F.expr(_NONE)).alias(k) for k in _LISTS),
        _rules(F.col("fields")).alias("rules"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Templates of a file, or of the ``*.json`` files right in a folder, in the order of their paths.

    A file that is no JSON object, has a value of a wrong kind or names no template is left out.
    """
    rows = spark.read.schema(schema.TEMPLATE + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad")
    rows = rows.option("pathGlobFilter", "*.json").json(path).withColumn("_path", F.input_file_name()).where("_bad is null")
    return parsed(rows.withColumn("load_order", F.col("_path")))


def from_json(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Templates of JSON texts, in their order."""
    rows = spark.createDataFrame([(f"{i:06d}", t) for i, t in enumerate(texts)], "load_order string, json string")
    kind = "struct<" + ",".join(":".join(c.split(" ", 1)) for c in schema.TEMPLATE.split(", ")) + ",_bad:string>"
    read_ = F.from_json("json", kind, {"columnNameOfCorruptRecord": "_bad"})
    return parsed(rows.select("load_order", read_.alias("t")).where("t._bad is null").select("load_order", "t.*"))
