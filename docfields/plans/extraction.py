"""From recognised boxes to typed fields: normalise, classify, match, extract, validate, cross-check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields import schema
from docfields.functions import geometry
from docfields.operators import extract, keywords, validate


def _rule_result(boxes: Column, r: Column, masked: bool) -> Column:
    """struct<name, field, warning> of one rule."""
    return F.struct(r["name"].alias("name"), extract.extracted(boxes, r["rule"]).alias("found"), r["rule"]["data_type"].alias("data_type"))


def fields_of(docs: DataFrame, rules: Column, as_of: Column, masked: bool = False) -> DataFrame:
    """``docs`` (with ``boxes`` normalised) with ``fields``, a map by name of the fifteen known fields that were found, and ``warnings``.

    Rules are taken in the order of their names; ``rules`` is array<struct<name, rule>> and may be null.
    """
    placed = docs.withColumn("_placed", extract.placed(F.col("boxes")))
    found = placed.withColumn("_found", F.transform(F.coalesce(rules, F.array().cast(f"array<struct<name:string,rule:{schema.RULE}>>")), lambda r: _rule_result(F.col("_placed"), r, masked)))

    def judged(x: Column) -> Column:
        # A value of its own in the next step, so that it is worked out once however many parts are read.
        return F.struct(x["name"].alias("name"), x["data_type"].alias("data_type"), F.when(x["found"].isNotNull(), validate.validated(x["found"], x["data_type"], masked)).alias("v"))

    def checked(x: Column) -> Column:
        missing = F.when(x["data_type"] != "text", F.concat(F.lit("Field '"), x["name"], F.lit("' could not be extracted")))
        return F.struct(
            x["name"].alias("name"), x["v"]["field"].alias("field"), F.when(x["v"].isNull(), missing).otherwise(x["v"]["warning"]).alias("warning")
        )

    done = found.withColumn("_checked", F.transform(F.transform("_found", judged), checked))
    known = F.filter("_checked", lambda x: x["field"].isNotNull() & x["name"].isin(*schema.PATIENT, *schema.EXAMINATION))
    out = done.withColumn("fields", F.map_from_entries(F.transform(known, lambda x: F.struct(x["name"], x["field"]))))
    own = F.filter(F.transform("_checked", lambda x: x["warning"]), lambda w: w.isNotNull())
    return out.withColumn("warnings", F.concat(own, validate.conflicts(F.col("fields"), as_of))).drop("_placed", "_found", "_checked")


def extraction(docs: DataFrame, templates: DataFrame, as_of: Column | None = None, masked: bool = False) -> DataFrame:
    """``docs`` (doc_id, image_width, image_height, boxes) with type, template_id, score, fields and warnings.

    ``as_of`` is the day, as ``YYYY-MM-DD``, for which ages are reckoned; today where it is not given.
    """
    today = F.date_format(F.current_date(), "yyyy-MM-dd") if as_of is None else as_of
    boxes = geometry.normalised(F.col("boxes"), F.col("image_width"), F.col("image_height"))
    rows = docs.withColumn("boxes", F.coalesce(boxes, F.expr(f"cast(array() as {schema.BOXES})")))
    rows = rows.withColumn("text", geometry.text_of(F.col("boxes")))
    rows = keywords.matched(rows, templates, F.col("text"))
    rows = fields_of(rows, F.col("match.template.rules"), today, masked)
    own = keywords.classified(F.col("text"))
    hit = F.col("match").isNotNull()
    rows = rows.withColumn("type", F.when(hit, schema.document_type(F.col("match.template.document_type"))).otherwise(own))
    told = F.array(F.concat(F.lit("Matched template: "), F.col("match.template.template_id"), F.lit(" (score: "), F.col("match.score").cast("string"), F.lit(")")))
    untold = F.array(
        F.concat(F.lit("No template matched. Document type: "), F.col("type")),
        F.concat(F.lit("Templates loaded: "), F.col("templates_loaded").cast("string"), F.lit(", none matched the report")),
    )
    rows = rows.withColumn("warnings", F.concat("warnings", F.when(hit, told).otherwise(untold)))
    return rows.withColumn("template_id", F.coalesce("match.template.template_id", F.lit(""))).withColumn("score", F.coalesce("match.score", F.lit(0))).drop("match", "templates_loaded", "text")
