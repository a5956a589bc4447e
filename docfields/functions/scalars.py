"""Normalising and validating text values.  All casts are tolerant: a value that does not fit gives null or empty."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions.binding import let

_BLANK = r"[ \t\n\x0B\f\r]"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def strip(c: Column) -> Column:
    """Without ASCII white space at both ends, then without trailing colons and dashes; what that exposes stays."""
    trimmed = F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+\z", "")
    return F.regexp_replace(trimmed, r"[:\-：—]+\z", "")


def gender(c: Column) -> Column:
    """男, 女 or empty."""
    v = strip(c)
    return F.when(v.rlike(r"男|\A(?:1|(?i:male|m))\z"), "男").when(v.rlike(r"女|\A(?:[02]|(?i:female|f))\z"), "女").otherwise("")


def age(c: Column) -> Column:
    """The first one to three digits after the start or anything but a digit or a minus; -1 where there are none or more than 150."""
    found = F.regexp_extract(strip(c), r"(?:^|[^-\d])(\d{1,3})", 1)
    return F.coalesce(F.regexp_extract(found, r"\A(?:0?\d{1,2}|1[0-4]\d|150)\z", 0).try_cast("int"), F.lit(-1))


def reasonable_age(years: Column) -> Column:
    return F.coalesce(years.between(0, 150), F.lit(False))


def valid_date(year: Column, month: Column, day: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce(year.between(1900, 2100) & month.between(1, 12) & (day >= 1) & (day <= last), F.lit(False))


#: Year, month and day of each form, in the order in which they are tried.
DATE_FORMS = (r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"(?<![0-9A-Za-z_])(\d{4})(\d{2})(\d{2})(?![0-9A-Za-z_])")


def date(c: Column) -> Column:
    """``YYYY-MM-DD`` of the first form whose first match is a calendar date; null where there is none."""
    v = F.translate(c, " \t\n\x0b\f\r", "")

    def of(form: str) -> Column:
        # The match with dashes, empty outside 1900 to 2100; the cast takes calendar dates only.  One chain, so nothing is worked out twice.
        dashed = F.regexp_replace(F.translate(F.regexp_extract(v, form, 0), "年月/.日", "----"), r"\A(\d{4})(\d\d)(\d\d)\z", "$1-$2-$3")
        return F.regexp_extract(dashed, r"\A(?:19\d\d|20\d\d|2100)-\d{1,2}-\d{1,2}", 0).try_cast("date")

    return F.coalesce(*map(of, DATE_FORMS)).cast("string")


def date_result(c: Column) -> Column:
    """struct<normalized, valid, raw>."""
    found = date(c)
    return F.struct(F.coalesce(found, F.lit("")).alias("normalized"), found.isNotNull().alias("valid"), c.alias("raw"))


def age_at(birth: Column, as_of: Column) -> Column:
    """Whole years from one ``YYYY-MM-DD`` to another; -1 where either is too short or no date."""
    part = lambda c, a, n: F.substring(c, a, n).try_cast("int")
    years = part(as_of, 1, 4) - part(birth, 1, 4)
    early = (part(as_of, 6, 2) * 100 + part(as_of, 9, 2)) < (part(birth, 6, 2) * 100 + part(birth, 9, 2))
    whole = years - F.when(early, 1).otherwise(0)
    return F.coalesce(F.when((F.octet_length(birth) >= 10) & (F.octet_length(as_of) >= 10), whole), F.lit(-1))


def id_corrected(c: Column) -> Column:
    """Usual misreadings of digits put right; a small x counts as X at the last or eighteenth place."""

    def of(v: Column) -> Column:
        upper = F.regexp_replace(v, r"(?s)\A(.{17})x", "$1X")
        return F.regexp_replace(upper, r"x\z", "X")

    # Letters that stand for misread digits.
    return of(F.translate(c, "OoIilLZzB×", "001111228X"))


#: Weights and check characters of national identity numbers.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"


def id_checksum(first17: Column) -> Column:
    """Check character of seventeen digits, null for anything else."""
    weights = F.array(*map(F.lit, ID_WEIGHTS))
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(17)), F.lit(0), lambda acc, i: acc + F.substr(first17, i, F.lit(1)).try_cast("int") * F.element_at(weights, i)
    )
    return F.when(first17.rlike(r"\A[0-9]{17}\z"), F.substr(F.lit(ID_CHECKS), total % 11 + 1, F.lit(1)))


def id_birth_date(c: Column) -> Column:
    """Empty unless places 7 to 14 are a year from 1900 to 2100, a month and a day up to 31."""
    y, m, d = (F.substring(c, a, n).try_cast("int") for a, n in ((7, 4), (11, 2), (13, 2)))
    digits = F.substring(c, 7, 8).rlike(r"\A[0-9]{8}\z")
    return F.when(digits & y.between(1900, 2100) & m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d)).otherwise("")


def id_gender(c: Column) -> Column:
    digit = F.substring(c, 17, 1)
    return F.when(digit.rlike(r"\A[0-9]\z"), F.when(digit.try_cast("int") % 2 == 1, "男").otherwise("女")).otherwise("")


def id_result(c: Column) -> Column:
    """struct<cleaned_number, format_valid, checksum_valid, birth_date, gender>; null counts as empty."""

    def of(cleaned: Column) -> Column:
        formed = cleaned.rlike(r"\A[0-9]{17}[0-9X]\z")
        right = F.coalesce(id_checksum(F.substring(cleaned, 1, 17)) == F.substring(cleaned, 18, 1), F.lit(False))
        return F.struct(
            cleaned.alias("cleaned_number"),
            formed.alias("format_valid"),
            (formed & right).alias("checksum_valid"),
            F.when(formed, id_birth_date(cleaned)).otherwise("").alias("birth_date"),
            F.when(formed, id_gender(cleaned)).otherwise("").alias("gender"),
        )

    return let(id_corrected(F.coalesce(c, F.lit(""))), of)


def masked_id(c: Column) -> Column:
    """First and last four characters with stars between; only stars where there are fewer than eight bytes."""
    n = F.octet_length(c)
    inner = F.repeat(F.lit("*"), F.greatest(n - 8, F.lit(0)))
    return F.when(n < 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, 4), inner, F.right(c, F.lit(4))))


def valid_utf8(c: Column) -> Column:
    return F.is_valid_utf8(c.cast("string"))
