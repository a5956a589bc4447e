"""Result documents: one JSON text a row, keys in alphabetical order, identity numbers masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields import schema
from docfields.functions.scalars import masked_id


def serialised(field: Column, number: Column, masked: bool = False) -> Column:
    """Struct with the keys of a field; ``number`` tells whether it is an identity number.

    The confidence is a float shown as a double.  A masked identity number always shows its raw value, masked too,
    and whether it is valid.
    """
    value, raw = F.coalesce(field["value"], F.lit("")), F.coalesce(field["raw_value"], F.lit(""))
    shown = F.when((raw != "") & (raw != value), raw)
    hidden = number & (value != "") if masked else F.lit(False)
    return F.struct(
        F.when(hidden, field["validation_status"] == "valid").alias("checksum_valid"),
        field["confidence"].cast("double").alias("confidence"),
        F.when(field["extraction_method"] != "default", field["extraction_method"]).alias("extraction_method"),
        (F.when(hidden & (raw != ""), masked_id(raw)).otherwise(shown) if masked else shown).alias("raw_value"),
        field["validation_status"].alias("validation_status"),
        (F.when(hidden, masked_id(value)).otherwise(value) if masked else value).alias("value"),
    )


def _section(fields: Column, names: tuple[str, ...], masked: bool) -> Column:
    """Map of the fields of these names that have a value or a raw value, in the order of their names; null where there are none."""
    told = lambda f: F.concat(F.coalesce(f["value"], F.lit("")), F.coalesce(f["raw_value"], F.lit(""))) != ""
    shown = F.filter(F.map_entries(fields), lambda e: e["key"].isin(*names) & told(e["value"]))
    entry = lambda e: F.struct(e["key"].alias("key"), serialised(e["value"], e["key"] == "id_number", masked).alias("value"))
    return F.map_from_entries(F.nullif(F.array_sort(F.transform(shown, entry)), F.array()))


def document(masked: bool = True) -> Column:
    """The result struct of a row with type, template_id, page_type, image_width, image_height, fields, quality, warnings, error_code."""
    code = F.coalesce(F.col("error_code"), F.lit(0))
    return F.struct(
        F.struct(
            F.coalesce("image_height", F.lit(0)).alias("image_height"),
            F.coalesce("image_width", F.lit(0)).alias("image_width"),
            F.coalesce("page_type", F.lit("unknown")).alias("page_type"),
            F.coalesce("template_id", F.lit("")).alias("template_id"),
            F.coalesce("type", F.lit("unknown")).alias("type"),
        ).alias("document"),
        code.alias("error_code"),
        _section(F.col("fields"), schema.EXAMINATION, masked).alias("examination"),
        schema.error_text(code).alias("message"),
        _section(F.col("fields"), schema.PATIENT, masked).alias("patient"),
        F.struct(*(F.col(f"quality.{k}").alias(k) for k in ("blur_score", "document_detected", "is_blurry", "is_overexposed"))).alias("quality"),
        (code == 0).alias("success"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )


def as_json(rows: DataFrame, masked: bool = True, pretty: bool = True) -> DataFrame:
    """doc_id, error_code, json."""
    options = {"ignoreNullFields": "true", "pretty": str(pretty).lower()}
    return rows.select("doc_id", F.coalesce("error_code", F.lit(0)).alias("error_code"), F.to_json(document(masked), options).alias("json"))
