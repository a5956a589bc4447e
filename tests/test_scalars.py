import pytest
from pyspark.sql import functions as F

from docfields.functions import scalars as s


def values(spark, rows, *columns):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in frame.orderBy("i").select(*columns).collect()]


def table(spark, column, cases):
    assert values(spark, [c for c, _ in cases], column) == [e for _, e in cases]


def test_strip(spark):
    table(spark, s.strip(F.col("c")), [("  hello  ", "hello"), ("姓名：", "姓名"), ("Name:", "Name"), ("a :", "a "), ("x：—-:", "x"), ("", ""), ("　a", "　a")])


def test_gender(spark):
    cases = [("男", "男"), ("Male", "男"), ("male", "男"), ("M", "男"), ("1", "男"), ("女", "女"), ("Female", "女"), ("female", "女"), ("F", "女")]
    table(spark, s.gender(F.col("c")), [*cases, ("0", "女"), ("2", "女"), ("", ""), ("未知", ""), ("男女", "男"), (None, "")])


def test_age(spark):
    cases = [("37岁", 37), ("37Y", 37), ("37y", 37), ("37", 37), ("  37 岁  ", 37), ("0", 0), ("150", 150), ("151", -1), ("999", -1), ("abc", -1), ("", -1)]
    table(spark, s.age(F.col("c")), [*cases, ("-1", -1), ("12345", 123), ("Age: 37", 37), (None, -1)])


def test_date(spark):
    same = ["2026-07-20", "2026年7月20日", "2026/07/20", "2026.07.20", "20260720", "日期20260720", "2026-07/20", " 2026 - 07 - 20 "]
    cases = [(x, "2026-07-20") for x in same] + [("2026年1月5日", "2026-01-05")]
    bad = ["2026-13-01", "2026-02-30", "", "not a date", "a20260720", "1899-01-01", None]
    table(spark, s.date(F.col("c")), cases + [(x, None) for x in bad])


@pytest.mark.parametrize(
    ("y", "m", "d", "ok"),
    [(2024, 2, 29, True), (2000, 2, 29, True), (2026, 1, 1, True), (2026, 12, 31, True), (2023, 2, 29, False), (1900, 2, 29, False), (2026, 0, 1, False), (2026, 13, 1, False), (2026, 1, 0, False), (2026, 1, 32, False)],
)
def test_calendar(spark, y, m, d, ok):
    assert spark.range(1).select(s.valid_date(F.lit(y), F.lit(m), F.lit(d))).first()[0] is ok


def test_age_at(spark):
    at = s.age_at(F.col("c"), F.lit("2026-07-20"))
    table(spark, at, [("1990-03-07", 36), ("1990-09-01", 35), ("1990", -1), (None, -1)])


def test_identity_numbers(spark):
    r = s.id_result(F.col("c"))
    rows = ["110101199003076632", "110101199003076843", "110101199003076631", "12345", "1101011990030766321", "", "1101011990A307663X", None]
    got = values(spark, rows, r["format_valid"], r["checksum_valid"])
    assert got == [(True, True), (True, True), (True, False)] + [(False, False)] * 5
    assert values(spark, rows[:2], r["birth_date"], r["gender"]) == [("1990-03-07", "男"), ("1990-03-07", "女")]
    table(spark, s.id_checksum(F.col("c")), [("11010119900307663", "2"), ("11010119900307684", "3"), ("123", None), (None, None)])
    fixed = [("44O3O5l988O92lZ234", "440305198809212234"), ("44O3O5l988O92lB234", "440305198809218234"), ("44030519880921123x", "44030519880921123X"), ("x1", "x1"), ("1×2", "1X2")]
    table(spark, s.id_corrected(F.col("c")), fixed)
    table(spark, s.id_birth_date(F.col("c")), [("440305198809211234", "1988-09-21"), ("123", "")])
    table(spark, s.id_gender(F.col("c")), [("440305198809211234", "男"), ("440305198809212345", "女"), ("123", "")])
    table(spark, s.masked_id(F.col("c")), [("440305198809211234", "4403**********1234"), ("1234567", "*******"), ("12345678", "12345678"), ("", "")])


def test_utf8_and_lower(spark):
    rows = spark.sql("select x'E4BDA0' as a, x'C0AF' as b").select(s.valid_utf8(F.col("a").cast("string")), s.valid_utf8(F.col("b").cast("string")))
    assert tuple(rows.first()) == (True, False)
    table(spark, s.ascii_lower(F.col("c")), [("ABCÀ", "abcÀ")])
