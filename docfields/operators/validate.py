"""Typed validation of extracted fields and checks between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import scalars as s
from docfields.functions.binding import let


def validated(field: Column, data_type: Column, masked: bool = False) -> Column:
    """struct<field, warning>: the field stripped and normalised by its type.  An empty value is left as it is.

    ``masked`` keeps identity numbers out of warnings.
    """

    def typed(raw: Column, value: Column, n: Column) -> Column:
        def out(new: Column, old: Column, status: Column | str, warning: Column | None = None) -> Column:
            changed = F.struct(
                new.alias("value"), old.alias("raw_value"), field["confidence"].alias("confidence"), field["source_bbox"].alias("source_bbox"),
                field["extraction_method"].alias("extraction_method"), (F.lit(status) if isinstance(status, str) else status).alias("validation_status"),
            )
            return F.struct(changed.alias("field"), (F.lit(None).cast("string") if warning is None else warning).alias("warning"))

        quoted = lambda what, c: F.concat(F.lit(f"{what}: '"), c, F.lit("'"))
        return (
            F.when(raw.isNull() | (n["text"] == ""), out(n["text"], raw, n["status"]))
            .when(n["gender"] != "", out(n["gender"], value, "valid"))
            .when(n["gender"] == "", out(value, raw, "uncertain", quoted("Gender value could not be normalized", raw)))
            .when(n["date"] != "", out(n["date"], value, "valid"))
            .when(n["date"] == "", out(value, raw, "uncertain", quoted("Date could not be normalized", value)))
            .when(n["age"] >= 0, out(n["age"].cast("string"), value, "valid"))
            .when(n["age"] < 0, out(value, raw, "uncertain", quoted("Age could not be parsed", value)))
            .when(n["number"]["checksum_valid"], out(n["number"]["cleaned_number"], value, "valid"))
            .when(n["number"]["format_valid"], out(n["number"]["cleaned_number"], value, "uncertain", F.lit("ID number checksum failed")))
            .when(n["number"].isNotNull(), out(value, value, "invalid", quoted("ID number format invalid", s.masked_id(value) if masked else value)))
            .otherwise(out(value, raw, F.when(value == "", "invalid").otherwise("valid")))
        )

    def judged(value: Column) -> Column:
        # Only the value's own type is worked out; the others are null.
        only = lambda kind, c: F.when(data_type == kind, c).alias(kind.removeprefix("id_"))
        own = F.struct(
            F.coalesce(field["value"], F.lit("")).alias("text"), field["validation_status"].alias("status"), only("gender", s.gender(value)),
            only("date", F.coalesce(s.date(value), F.lit(""))), only("age", s.age(value)), only("id_number", s.id_result(value)),
        )
        return let(own, lambda n: typed(F.coalesce(field["raw_value"], F.lit("")), value, n))

    return let(s.strip(F.coalesce(field["value"], F.lit(""))), judged)


def conflicts(fields: Column, as_of: Column) -> Column:
    """Warnings where an identity number, a birth date, a gender and an age, all valid, disagree.  ``fields`` is a map by name."""
    at = lambda k: F.try_element_at(fields, F.lit(k))
    sound = lambda k: F.coalesce(at(k)["validation_status"] == "valid", F.lit(False))
    value = lambda k: at(k)["value"]
    birth, gender = s.id_birth_date(value("id_number")), s.id_gender(value("id_number"))
    implied = s.age_at(value("birth_date"), as_of)
    stated = value("age").try_cast("int")
    return F.array_compact(
        F.array(
            F.when(
                sound("id_number") & sound("birth_date") & (birth != "") & (birth != value("birth_date")),
                F.concat(F.lit("Birth date conflict: ID number implies '"), birth, F.lit("' but extracted value is '"), value("birth_date"), F.lit("'")),
            ),
            F.when(
                sound("id_number") & sound("gender") & (gender != "") & (gender != value("gender")),
                F.concat(F.lit("Gender conflict: ID number implies '"), gender, F.lit("' but extracted value is '"), value("gender"), F.lit("'")),
            ),
            F.when(
                sound("birth_date") & sound("age") & (implied >= 0) & (F.abs(implied - stated) > 1),
                F.concat(F.lit("Age conflict: birth date implies age "), implied.cast("string"), F.lit(" but extracted age is "), stated.cast("string")),
            ),
        )
    )
