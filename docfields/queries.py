"""One query for each operator, over values made from the driver's tables, and the same in SQL for another engine.

The tables hold no medical reports, so each query makes its values from them with SQL that both engines read
(``MADE``); the query then applies the library's columns, the other SQL says the same in its own words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields import schema
from docfields.config import Config, Engine
from docfields.functions import geometry as g
from docfields.functions import scalars as s
from docfields.operators import extract, imaging, keywords, relational, validate
from docfields.plans import extraction, pipeline, result
from docfields.sources import engines, images, recorded, templates

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", sql)]
    text = re.sub(rf"\b(from|join) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


RAW = """select o_orderkey as k, case o_orderkey % 8 when 0 then '  hello  ' when 1 then '姓名：' when 2 then 'Name:' when 3 then 'a :' when 4 then 'x：—-:'
    when 5 then '' when 6 then '  A-' || cast(o_custkey as string) || ' - ' else o_orderpriority end as raw from orders"""
GENDERS = """select o_orderkey as k, case o_orderkey % 9 when 0 then '男' when 1 then ' Female ' when 2 then 'M' when 3 then '1' when 4 then '0' when 5 then '2'
    when 6 then '未知' when 7 then '女性：' else 'MALE-' end as raw from orders"""
AGES = """select o_orderkey as k, case o_orderkey % 7 when 0 then cast(o_custkey % 200 as string) || '岁' when 1 then 'Age: ' || cast(o_custkey % 120 as string)
    when 2 then '-' || cast(o_custkey % 90 as string) when 3 then cast(o_custkey as string) || 'Y' when 4 then 'abc' when 5 then '' else '  ' || cast(o_custkey % 160 as string) || ' 岁 ' end as raw from orders"""
DATES = """select o_orderkey as k, case o_orderkey % 8 when 0 then y || '-' || m || '-' || d when 1 then y || '/' || cast(cast(m as int) as string) || '/' || cast(cast(d as int) as string)
    when 2 then y || '年' || cast(cast(m as int) as string) || '月' || d || '日' when 3 then '日期' || y || m || d when 4 then y || '-02-30' when 5 then 'a' || y || m || d
    when 6 then ' ' || y || '. ' || m || '/' || d else '18' || substr(y, 3, 2) || '-01-01' end as raw
    from (select *, cast(year(o_orderdate) as string) as y, lpad(cast(month(o_orderdate) as string), 2, '0') as m, lpad(cast(day(o_orderdate) as string), 2, '0') as d from orders) as t"""
PARTS = "select o_orderkey as k, cast(1895 + o_orderkey % 210 as int) as y, cast(o_orderkey % 14 as int) as m, cast(o_custkey % 33 as int) as d from orders"
BIRTHS = """select o_orderkey as k, case when o_orderkey % 11 = 0 then '1990' else cast(year(o_orderdate) as string) || '-' || lpad(cast(month(o_orderdate) as string), 2, '0')
    || '-' || lpad(cast(day(o_orderdate) as string), 2, '0') end as birth from orders"""
FIRST17 = """select o_orderkey as k, lpad(cast(o_custkey % 1000000 as string), 6, '0') || cast(1880 + o_orderkey % 240 as string) || lpad(cast(o_orderkey % 14 as string), 2, '0')
    || lpad(cast(o_orderkey % 34 as string), 2, '0') || lpad(cast(o_custkey % 1000 as string), case when o_orderkey % 17 = 0 then 2 else 3 end, '0') as f from orders"""
#: A right check character, a wrong one, misread digits, or a number of a wrong length.
NUMBERS = f"""select k, case k % 4 when 0 then f || '0' when 1 then replace(replace(f, '0', 'O'), '1', 'l') || 'x' when 2 then replace(replace(f, '2', 'Z'), '8', 'B') || '7'
    else f || '1' end as raw from ({FIRST17}) as t"""
BOXES = """select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) as int) as box_idx,
    l_returnflag || l_linestatus || cast(l_linenumber as string) as text,
    cast((l_partkey * 37) % 1900 as float) as x1, cast((l_suppkey * 61 + l_linenumber * 13) % 400 as float) as y1,
    cast((l_partkey * 37) % 1900 + 40 + l_partkey % 90 as float) as x2, cast((l_suppkey * 61 + l_linenumber * 13) % 400 + 20 + l_suppkey % 30 as float) as y2,
    cast((50 + l_partkey % 50) / 100.0 as float) as confidence from lineitem"""
#: Centres, and the width and height of the page that holds the boxes.
WIDE, TALL = 2480, 3508


def _points() -> Column:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, box_idx, text, confidence, x, y."""
    rows = made(spark, sf_dir, BOXES)
    c = g.centre(_points())
    return rows.select("doc_id", "box_idx", "text", "confidence", c["x"].alias("x"), c["y"].alias("y"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, boxes (placed) of each order."""
    box = F.struct("box_idx", "text", "confidence", _points().alias("points"))
    rows = made(spark, sf_dir, BOXES).groupBy("doc_id").agg(F.array_sort(F.collect_list(box)).alias("b"))
    plain = lambda b: F.struct(b["text"].alias("text"), b["confidence"].alias("confidence"), F.lit(0.0).cast("float").alias("direction"), b["points"].alias("points"))
    return rows.select("doc_id", F.transform("b", plain).alias("boxes"), F.transform("b", lambda b: b["box_idx"]).alias("numbers"))


B = f"""b as (select doc_id, box_idx, text, confidence, cast((x1 + x2 + x2 + x1) / 4 as float) as x, cast((y1 + y1 + y2 + y2) / 4 as float) as y, x1, y1, x2, y2 from ({BOXES}) as t)"""
FAR = "cast(sqrt(cast(cast(cast((a.x - b.x) * (a.x - b.x) as float) + cast((a.y - b.y) * (a.y - b.y) as float) as float) as double)) as float)"
ANCHORS = ["RF", "AF"]
A = f"""{B}, a as (select * from (select *, row_number() over (partition by doc_id order by box_idx) as r from b where contains(text, 'RF') or contains(text, 'AF')) where r = 1)"""


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g'), '[:\-：—]+\z', '')"


def _gender(x: str) -> str:
    v = _strip(x)
    low = f"lower({v})"
    return f"""case when contains({v}, '男') then '男' when contains({v}, '女') then '女' when {low} in ('male', 'm') then '男' when {low} in ('female', 'f') then '女'
        when {v} = '1' then '男' when {v} in ('0', '2') then '女' else '' end"""


def _age(x: str) -> str:
    n = rf"try_cast(regexp_extract({_strip(x)}, '(?:^|[^-\d])(\d{{1,3}})', 1) as int)"
    return f"coalesce(case when {n} between 0 and 150 then {n} end, -1)"


def _valid(y: str, m: str, d: str) -> str:
    return f"""coalesce({y} between 1900 and 2100 and {m} between 1 and 12 and {d} >= 1 and {d} <= case when {m} in (4, 6, 9, 11) then 30 when {m} = 2 then
        case when {y} % 4 = 0 and {y} % 100 <> 0 or {y} % 400 = 0 then 29 else 28 end else 31 end, false)"""


def _date(x: str) -> str:
    v = rf"regexp_replace({x}, '[ \t\n\x0B\f\r]', '', 'g')"
    tries = []
    for form in (r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"\b(\d{4})(\d{2})(\d{2})\b"):
        y, m, d = (f"try_cast(regexp_extract({v}, '{form}', {i}) as int)" for i in (1, 2, 3))
        tries.append(f"case when {_valid(y, m, d)} then printf('%d-%02d-%02d', {y}, {m}, {d}) end")
    return f"coalesce({', '.join(tries)})"


def _corrected(x: str) -> str:
    v = f"translate({x}, 'OoIilLZzB×', '001111228X')"
    v = f"case when substr({v}, 18, 1) = 'x' then substr({v}, 1, 17) || 'X' || substr({v}, 19) else {v} end"
    return f"(case when ({v}) like '%x' then substr(({v}), 1, length(({v})) - 1) || 'X' else ({v}) end)"


def _checksum(x: str) -> str:
    total = f"list_sum(list_transform(range(1, 18), lambda i: try_cast(substr({x}, i, 1) as int) * {list(s.ID_WEIGHTS)}[i])) % 11"
    return rf"case when regexp_full_match({x}, '[0-9]{{17}}') then substr('{s.ID_CHECKS}', cast({total} as int) + 1, 1) end"


def _birth(x: str) -> str:
    y, m, d = (f"try_cast(substr({x}, {a}, {n}) as int)" for a, n in ((7, 4), (11, 2), (13, 2)))
    return f"case when {y} between 1900 and 2100 and {m} between 1 and 12 and {d} between 1 and 31 then printf('%04d-%02d-%02d', {y}, {m}, {d}) else '' end"


def _mask(x: str) -> str:
    return f"case when strlen({x}) < 8 then repeat('*', strlen({x})) else substr({x}, 1, 4) || repeat('*', strlen({x}) - 8) || right({x}, 4) end"


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _scalar(name: str, source: str, columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A query of one expression a column, with its SQL.  Expressions are made when the query runs: they need a session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return made(spark, sf_dir, source).select("k", *(c().alias(n) for n, (c, _) in columns.items()))

    run.__name__ = name
    _query(f"select k, {', '.join(f'{q} as {n}' for n, (_, q) in columns.items())} from ({source}) as t")(run)


def _register_scalars() -> None:
    _scalar("strip_values", RAW, {"value": (lambda: s.strip(F.col("raw")), _strip("raw"))})
    _scalar("ascii_lower", RAW, {"value": (lambda: s.ascii_lower(F.col("raw")), "lower(raw)")})
    _scalar("normalize_gender", GENDERS, {"value": (lambda: s.gender(F.col("raw")), _gender("raw"))})
    _scalar("extract_age", AGES, {"value": (lambda: s.age(F.col("raw")), _age("raw")), "reasonable": (lambda: s.reasonable_age(s.age(F.col("raw"))), f"{_age('raw')} between 0 and 150")})
    _scalar("normalize_date", DATES, {"normalized": (lambda: s.date_result(F.col("raw"))["normalized"], f"coalesce({_date('raw')}, '')"), "valid": (lambda: s.date_result(F.col("raw"))["valid"], f"{_date('raw')} is not null")})
    _scalar("valid_date", PARTS, {"valid": (lambda: s.valid_date(F.col("y"), F.col("m"), F.col("d")), _valid("y", "m", "d"))})
    day = "2026-07-20"
    part = lambda a, n: f"try_cast(substr(birth, {a}, {n}) as int)"
    early = f"(720 < {part(6, 2)} * 100 + {part(9, 2)})"
    _scalar("calc_age", BIRTHS, {"age": (lambda: s.age_at(F.col("birth"), F.lit(day)), f"coalesce(case when strlen(birth) >= 10 then 2026 - {part(1, 4)} - case when {early} then 1 else 0 end end, -1)")})
    _scalar("id_correct", NUMBERS, {"value": (lambda: s.id_corrected(F.col("raw")), _corrected("raw"))})
    _scalar("id_checksum", FIRST17, {"value": (lambda: s.id_checksum(F.col("f")), _checksum("f"))})
    odd = "case when regexp_full_match(substr(f, 17, 1), '[0-9]') then case when cast(substr(f, 17, 1) as int) % 2 = 1 then '男' else '女' end else '' end"
    _scalar("id_birth_gender", FIRST17, {"birth": (lambda: s.id_birth_date(F.col("f")), _birth("f")), "gender": (lambda: s.id_gender(F.col("f")), odd)})
    c = _corrected("raw")
    formed = f"regexp_full_match({c}, '[0-9]{{17}}[0-9X]')"
    right = f"({formed} and coalesce({_checksum(f'substr({c}, 1, 17)')} = substr({c}, 18, 1), false))"
    _scalar("id_validate", NUMBERS, {"cleaned": (lambda: s.id_result(F.col("raw"))["cleaned_number"], c), "format_valid": (lambda: s.id_result(F.col("raw"))["format_valid"], formed), "checksum_valid": (lambda: s.id_result(F.col("raw"))["checksum_valid"], right), "birth": (lambda: s.id_result(F.col("raw"))["birth_date"], f"case when {formed} then {_birth(c)} else '' end")})
    _scalar("mask_id", NUMBERS.replace("else f ||", "when 3 then substr(f, 1, cast(k % 12 as int)) else f ||"), {"value": (lambda: s.masked_id(F.col("raw")), _mask("raw"))})
    _scalar("page_type", "select p_partkey as k, cast(p_size as double) / 50 as ratio from part", {"page": (lambda: g.page_type(F.col("ratio")), "case when ratio > 0 and abs((case when ratio > 1 then 1 / ratio else ratio end) - 1 / sqrt(2.0)) / (1 / sqrt(2.0)) <= 0.15 then 'A4' else 'unknown' end")})
    known = "case p_partkey % 7 when 0 then 'ct_report' when 1 then 'mri_report' when 2 then 'other' else p_type end"
    kinds = ", ".join(f"'{t}'" for t in schema.DOCUMENT_TYPES)
    _scalar("document_type", f"select p_partkey as k, {known} as raw from part", {"type": (lambda: schema.document_type(F.col("raw")), f"case when raw in ({kinds}) then raw else 'unknown' end")})
    codes = " ".join(f"when {k} then '{v}'" for k, v in schema.ERRORS.items())
    code = f"select p_partkey as k, cast(case p_partkey % {len(schema.ERRORS) + 1} {' '.join(f'when {i} then {c}' for i, c in enumerate(schema.ERRORS))} else 7 end as int) as code from part"
    _scalar("error_text", code, {"text": (lambda: schema.error_text(F.col("code")), f"case code {codes} else 'Unrecognized error code' end")})
    # A lone lead byte, a lone continuation byte or an overlong form follows every text but each fourth.
    broken = lambda: F.concat(F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.unhex(F.element_at(F.array(*map(F.lit, ("", "C3", "80", "C0AF"))), (F.col("k") % 4 + 1).cast("int"))))
    _scalar("utf8_valid", "select doc_id as k, text from documents", {"valid": (lambda: s.valid_utf8(broken()), "k % 4 = 0")})


_register_scalars()


@_query(f"with {B} select doc_id, box_idx, cast(x as double) as x, cast(y as double) as y from b")
def box_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark, sf_dir).select("doc_id", "box_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@_query(f"with {B} select doc_id, box_idx, cast(least(x1, x2) as double) as x_min, cast(least(y1, y2) as double) as y_min, cast(greatest(x1, x2) as double) as x_max, cast(greatest(y1, y2) as double) as y_max from b")
def box_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = g.bounds(_points())
    return made(spark, sf_dir, BOXES).select("doc_id", "box_idx", *(b[n].cast("double").alias(n) for n in ("x_min", "y_min", "x_max", "y_max")))


_SCALED = ", ".join(f"cast(cast({c} * cast(cast(1000 as double) / {side} as float) as float) as double) as {c}" for c, side in (("x1", WIDE), ("y1", TALL), ("x2", WIDE), ("y2", TALL)))


@_query(f"select doc_id, box_idx, {_SCALED} from ({BOXES}) as t")
def normalize_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, BOXES).withColumn("boxes", F.array(F.struct("text", "confidence", F.lit(0.0).cast("float").alias("direction"), _points().alias("points"))))
    p = F.get(g.normalised(F.col("boxes"), F.lit(WIDE), F.lit(TALL)), F.lit(0))["points"]
    at = lambda i, a: F.get(p, F.lit(i))[a].cast("double")
    return rows.select("doc_id", "box_idx", at(0, "x").alias("x1"), at(0, "y").alias("y1"), at(2, "x").alias("x2"), at(2, "y").alias("y2"))


def _pairs(spark: SparkSession, sf_dir: str, rule: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """Pairs of boxes of one document that hold a rule over (bounds a, bounds b, y a, y b)."""
    c = g.centre(_points())
    rows = made(spark, sf_dir, BOXES).select("doc_id", "box_idx", g.bounds(_points()).alias("o"), c["y"].alias("y"))
    a, b = (rows.toDF("doc_id", f"{n}_idx", f"{n}o", f"{n}y") for n in "ab")
    return a.join(b, "doc_id").where("a_idx <> b_idx").where(rule(F.col("ao"), F.col("bo"), F.col("ay"), F.col("by"))).select("doc_id", "a_idx", "b_idx")


_PAIR = f"with {B} select a.doc_id, a.box_idx as a_idx, b.box_idx as b_idx from b as a join b on a.doc_id = b.doc_id and a.box_idx <> b.box_idx where "


@_query(_PAIR + "abs(a.y - b.y) <= 20")
def same_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, lambda a, b, ay, by: g.same_line(ay, by, F.lit(20)))


@_query(_PAIR + "b.x1 >= a.x2 - 5")
def right_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, lambda a, b, ay, by: g.right_of(a, b, F.lit(5)))


@_query(_PAIR + "b.y1 >= a.y2 - 5")
def below_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, lambda a, b, ay, by: g.below(a, b, F.lit(5)))


@_query(f"with {B} select doc_id, box_idx from b where x between 100 and 900 and y between 50 and 300")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.array(*map(F.lit, (100, 50, 900, 300)))
    return _boxed(spark, sf_dir).where(g.in_region(F.col("x"), F.col("y"), region)).select("doc_id", "box_idx")


@_query(f"with {B} select doc_id, count(*) filter (where confidence >= cast(0.65 as float)) as n from b group by doc_id")
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(g.confident(F.col("boxes"), 0.65)).cast("long").alias("n"))


@_query(f"with {B} select doc_id, string_agg(text, chr(10) order by box_idx) as text from b group by doc_id")
def concat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", g.text_of(F.col("boxes")).alias("text"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("placed", extract.placed(F.col("boxes"))).withColumn("a", extract.anchor(F.col("placed"), F.array(*map(F.lit, ANCHORS))))


@_query(f"with {A} select doc_id, box_idx from a")
def anchor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).where("a is not null").select("doc_id", F.get("numbers", F.col("a.idx")).alias("box_idx"))


@_query(f"with {A} select doc_id, box_idx from a")
def anchor_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.anchors(_boxed(spark, sf_dir), ANCHORS).select("doc_id", F.col("a_idx").alias("box_idx"))


def _near(ahead: str) -> str:
    return f"""with {A}, p as (select b.doc_id, b.box_idx, b.text, {FAR} as d from b join a on a.doc_id = b.doc_id and a.box_idx <> b.box_idx where {ahead})
        select doc_id, box_idx, text from (select *, row_number() over (partition by doc_id order by d, box_idx) as r from p where d <= 800) where r = 1"""


_RIGHT, _BELOW = _near("abs(a.y - b.y) <= 60 and b.x > a.x"), _near("b.y > a.y")


def _value(rows: DataFrame, found: Column) -> DataFrame:
    return rows.withColumn("v", found).where("v is not null").select("doc_id", F.get("numbers", F.col("v.idx")).alias("box_idx"), "v.text")


@_query(_RIGHT)
def nearest_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(_placed(spark, sf_dir), extract.right(F.col("placed"), F.col("a"), F.lit(60), F.lit(800)))


@_query(_BELOW)
def nearest_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(_placed(spark, sf_dir), extract.beneath(F.col("placed"), F.col("a"), F.lit(800)))


@_query(_RIGHT)
def nearest_right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxed(spark, sf_dir)
    return relational.nearest_right(boxes, relational.anchors(boxes, ANCHORS), 60, 800).select("doc_id", "box_idx", "text")


@_query(_BELOW)
def nearest_below_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxed(spark, sf_dir)
    return relational.nearest_below(boxes, relational.anchors(boxes, ANCHORS), 800).select("doc_id", "box_idx", "text")


END = ["NO", "RF"]
_PARAGRAPH = f"""with {A}, e as (select b.doc_id, b.box_idx, b.y, a.y as ay, a.box_idx as a_idx, case when contains(b.text, 'NO') then 0 else 1 end as o
        from b join a on a.doc_id = b.doc_id where b.y > a.y and (contains(b.text, 'NO') or contains(b.text, 'RF'))),
    f as (select * from (select *, row_number() over (partition by doc_id order by y, o, box_idx) as r from e) where r = 1),
    i as (select b.doc_id, b.box_idx, b.y, b.text, b.confidence from b join f on b.doc_id = f.doc_id and b.box_idx <> f.box_idx and b.box_idx <> f.a_idx and b.y > f.ay and b.y < f.y)
    select doc_id, string_agg(text, chr(10) order by y, box_idx) as value, round(avg(cast(confidence as double)), 4) as confidence from i group by doc_id"""


@_query(_PARAGRAPH)
def paragraph_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.struct(F.array(*map(F.lit, ANCHORS)).alias("start_anchors"), F.array(*map(F.lit, END)).alias("end_anchors"))
    rows = _placed(spark, sf_dir).withColumn("rule", rule).withColumn("f", extract.paragraph(F.col("placed"), F.col("rule")))
    return rows.where("f is not null").select("doc_id", "f.value", F.round(F.col("f.confidence").cast("double"), 4).alias("confidence"))


@_query(_PARAGRAPH)
def paragraph_between_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.between(_boxed(spark, sf_dir), ANCHORS, END).select("doc_id", "value", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


HITS = ("the", "The", "and", "the", "tion", "zz")
_HITS = " + ".join(f"contains(text, '{w}')::int" for w in HITS)


@_query(f"select doc_id, {_HITS} as hits, contains(text, 'the') and contains(text, 'and') as complete from documents")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.array(*map(F.lit, HITS))
    return docs.select("doc_id", keywords.keyword_hits(F.col("text"), words).alias("hits"), keywords.all_present(F.col("text"), F.array(F.lit("the"), F.lit("and"))).alias("complete"))


def _votes() -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    lower = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    counts = ", ".join(f"{' + '.join(f'''contains(low, '{lower(w)}')::int''' for w in words)} as {kind}" for kind, words in keywords.KEYWORDS.items())
    return f"(select doc_id, {counts} from (select doc_id, {low} as low from documents) as t)"


_BEST = "case when greatest({0}) = 0 then 'unknown' {1} end".format(
    ", ".join(keywords.KEYWORDS), " ".join(f"when {k} = greatest({', '.join(keywords.KEYWORDS)}) then '{k}'" for k in keywords.KEYWORDS)
)


@_query(f"select doc_id, {_BEST} as type from {_votes()} as v")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", keywords.classified(F.col("text")).alias("type"))


#: hospital, title, required and optional keywords that occur in the corpus.
_TEMPLATES = {
    "t_a": (["tion"], ["The"], ["the", "and"], ["of", "zz"]),
    "t_b": (["ment"], ["Le"], ["de"], ["que", "les"]),
    "t_c": ([], ["ion"], [], ["ein", "der"]),
    "t_d": (["tion"], ["The"], ["the", "and"], ["of", "zz"]),
}


def _template_rows(spark: SparkSession) -> DataFrame:
    import json

    keys = ("hospital_keywords", "title_keywords", "required_keywords", "optional_keywords")
    return templates.from_json(spark, [json.dumps({"template_id": t, "document_type": "ct_report", **dict(zip(keys, k, strict=True))}) for t, k in _TEMPLATES.items()])


def _scores() -> str:
    parts = []
    for i, (t, lists) in enumerate(_TEMPLATES.items()):
        hits = [" + ".join(f"contains(text, '{w}')::int" for w in ws) or "0" for ws in lists]
        total = " + ".join(f"{p} * ({h})" for p, h in zip(keywords.POINTS, hits, strict=True))
        complete = " and ".join(f"contains(text, '{w}')" for w in lists[2]) or "true"
        parts.append(f"select doc_id, {i} as o, '{t}' as template_id, {total} as score, {complete} as complete from documents")
    return " union all ".join(parts)


@_query(f"select doc_id, template_id, score, complete from ({_scores()}) as t")
def template_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    few = _template_rows(spark).drop("load_order")
    pairs = docs.crossJoin(F.broadcast(few.select(F.struct("*").alias("t")))).withColumn("s", keywords.score(F.col("text"), F.col("t")))
    return pairs.select("doc_id", "t.template_id", "s.score", "s.complete")


@_query(f"select doc_id, template_id, score from (select *, row_number() over (partition by doc_id order by score desc, o) as r from ({_scores()}) as t where complete and score > 0) where r = 1")
def best_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = keywords.matched(docs, _template_rows(spark), F.col("text"))
    return rows.where("match is not null").select("doc_id", F.col("match.template.template_id").alias("template_id"), F.col("match.score").alias("score"))


#: A field of each type, by order, and what validation makes of it.
_TYPED = f"""select k, 'gender' as data_type, raw from ({GENDERS}) as t union all select k, 'date', raw from ({DATES}) as t
    union all select k, 'age', raw from ({AGES}) as t union all select k, 'id_number', raw from ({NUMBERS}) as t union all select k, 'string', raw from ({RAW}) as t"""


def _typed_sql() -> str:
    v, c = _strip("raw"), _corrected(_strip("raw"))
    gender, age, date = _gender(v), _age(v), _date(v)
    formed = f"regexp_full_match({c}, '[0-9]{{17}}[0-9X]')"
    sound = f"({formed} and coalesce({_checksum(f'substr({c}, 1, 17)')} = substr({c}, 18, 1), false))"
    value = f"""case when raw = '' then raw when data_type = 'gender' then coalesce(nullif({gender}, ''), {v}) when data_type = 'date' then coalesce({date}, {v})
        when data_type = 'age' and {age} >= 0 then cast({age} as varchar) when data_type = 'id_number' and {formed} then {c} else {v} end"""
    status = f"""case when raw = '' then 'not_validated' when data_type = 'gender' then case when {gender} <> '' then 'valid' else 'uncertain' end
        when data_type = 'date' then case when {date} is not null then 'valid' else 'uncertain' end when data_type = 'age' then case when {age} >= 0 then 'valid' else 'uncertain' end
        when data_type = 'id_number' then case when {sound} then 'valid' when {formed} then 'uncertain' else 'invalid' end else case when {v} = '' then 'invalid' else 'valid' end end"""
    warning = f"""case when raw = '' then null when data_type = 'gender' and {gender} = '' then 'Gender value could not be normalized: ''' || raw || ''''
        when data_type = 'date' and {date} is null then 'Date could not be normalized: ''' || {v} || '''' when data_type = 'age' and {age} < 0 then 'Age could not be parsed: ''' || {v} || ''''
        when data_type = 'id_number' and not {formed} then 'ID number format invalid: ''' || {v} || '''' when data_type = 'id_number' and not {sound} then 'ID number checksum failed' end"""
    return f"select k, data_type, {value} as value, {status} as status, {warning} as warning from ({_TYPED}) as t"


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, _TYPED)
    f = F.struct(
        F.col("raw").alias("value"), F.col("raw").alias("raw_value"), F.lit(0.9).cast("float").alias("confidence"), F.expr("cast(array() as array<struct<x:float,y:float>>)").alias("source_bbox"),
        F.lit("anchor_right").alias("extraction_method"), F.lit("not_validated").alias("validation_status"),
    )
    return rows.withColumn("v", validate.validated(f, F.col("data_type")))


@_query(_typed_sql())
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("k", "data_type", "v.field.value", F.col("v.field.validation_status").alias("status"), "v.warning")


@_query(f"select data_type, regexp_replace(warning, ':.*', '') as kind, count(*) as n from ({_typed_sql()}) as t where warning is not null group by all")
def warnings_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _validated(spark, sf_dir).where("v.warning is not null")
    return rows.groupBy("data_type", F.regexp_replace("v.warning", "(?s):.*", "").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


#: Valid fields that agree or not.
_PEOPLE = """select o_orderkey as k, '110101' || cast(1950 + o_orderkey % 60 as string) || lpad(cast(1 + o_orderkey % 12 as string), 2, '0') || '07' || lpad(cast(o_custkey % 1000 as string), 3, '0') || '1' as id_number,
    cast(1950 + (o_orderkey + case when o_orderkey % 3 = 0 then 1 else 0 end) % 60 as string) || '-' || lpad(cast(1 + o_orderkey % 12 as string), 2, '0') || '-07' as birth_date,
    case when o_custkey % 5 < 3 then '男' else '女' end as gender, cast(20 + o_orderkey % 57 as string) as age, case when o_orderkey % 7 = 0 then 'uncertain' else 'valid' end as status from orders"""
_IMPLIED = "(2026 - cast(substr(birth_date, 1, 4) as int) - case when substr(birth_date, 6) > '07-20' then 1 else 0 end)"
_SEX = "(case when cast(substr(id_number, 17, 1) as int) % 2 = 1 then '男' else '女' end)"
_BORN = "(substr(id_number, 7, 4) || '-' || substr(id_number, 11, 2) || '-' || substr(id_number, 13, 2))"
_CONFLICTS = f"""select k, concat_ws('|', case when status = 'valid' and {_BORN} <> birth_date then 'Birth date conflict: ID number implies ''' || {_BORN} || ''' but extracted value is ''' || birth_date || '''' end,
    case when status = 'valid' and {_SEX} <> gender then 'Gender conflict: ID number implies ''' || {_SEX} || ''' but extracted value is ''' || gender || '''' end,
    case when abs({_IMPLIED} - cast(age as int)) > 1 then 'Age conflict: birth date implies age ' || {_IMPLIED} || ' but extracted age is ' || age end) as warnings from ({_PEOPLE}) as t"""


@_query(_CONFLICTS)
def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda name, status: F.struct(F.col(name).alias("value"), status.alias("validation_status"))
    fields = F.create_map(*(x for n in ("id_number", "birth_date", "gender", "age") for x in (F.lit(n), f(n, F.col("status") if n == "id_number" else F.lit("valid")))))
    rows = made(spark, sf_dir, _PEOPLE).withColumn("fields", fields)
    return rows.select("k", F.array_join(validate.conflicts(F.col("fields"), F.lit("2026-07-20")), "|").alias("warnings"))


@_query(
    f"""with {A}, r as (select b.doc_id, b.text, {FAR} as d, b.box_idx from b join a on a.doc_id = b.doc_id and a.box_idx <> b.box_idx where abs(a.y - b.y) <= 60 and b.x > a.x),
    w as (select b.doc_id, b.text, {FAR} as d, b.box_idx from b join a on a.doc_id = b.doc_id and a.box_idx <> b.box_idx where b.y > a.y),
    r1 as (select * from (select *, row_number() over (partition by doc_id order by d, box_idx) as n from r where d <= 500) where n = 1),
    w1 as (select * from (select *, row_number() over (partition by doc_id order by d, box_idx) as n from w where d <= 500) where n = 1)
    select a.doc_id, coalesce(r1.text, w1.text) as value, case when r1.text is not null then 'anchor_right' when w1.text is not null then 'anchor_below' end as method
    from a left join r1 on r1.doc_id = a.doc_id left join w1 on w1.doc_id = a.doc_id where coalesce(r1.text, w1.text) is not null"""
)
def fallback_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.struct(
        F.array(*map(F.lit, ANCHORS)).alias("anchors"), F.lit("right").alias("search_direction"), F.lit(60).alias("same_line_tolerance"), F.lit(500).alias("max_distance"),
        F.lit(None).cast("array<int>").alias("region"), F.lit("anchor_right").alias("extraction_type"), F.array(F.lit("-")).alias("start_anchors"), F.array(F.lit("-")).alias("end_anchors"),
    )
    rows = _placed(spark, sf_dir).withColumn("rule", rule).withColumn("f", extract.extracted(F.col("placed"), F.col("rule")))
    return rows.where("f is not null").select("doc_id", "f.value", F.col("f.extraction_method").alias("method"))


_CORNERS = """select p_partkey as k, cast(p_partkey * 7 % 500 as float) as ax, cast(p_partkey * 11 % 490 as float) as ay, cast(600 + p_partkey * 3 % 400 as float) as bx, cast(p_partkey * 13 % 480 as float) as "by",
    cast(600 + p_partkey * 5 % 400 as float) as cx, cast(600 + p_partkey * 17 % 300 as float) as cy, cast(p_partkey * 19 % 500 as float) as dx, cast(600 + p_partkey * 23 % 300 as float) as dy from part"""
_CORNERS_SPARK = _CORNERS.replace('"by"', "`by`")


def _quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda n: F.struct(F.col(f"{n}x").alias("x"), F.col(f"{n}y").alias("y"))
    mixed = F.when(F.col("k") % 2 == 0, F.array(p("c"), p("a"), p("d"), p("b"))).otherwise(F.array(p("b"), p("d"), p("a"), p("c")))
    return made(spark, sf_dir, _CORNERS_SPARK).withColumn("corners", g.ordered_corners(mixed))


@_query(f"""select k, cast(ax as double) as x0, cast(ay as double) as y0, cast(bx as double) as x1, cast("by" as double) as y1, cast(cx as double) as x2, cast(cy as double) as y2, cast(dx as double) as x3, cast(dy as double) as y3 from ({_CORNERS}) as t""")
def order_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quad(spark, sf_dir)
    return rows.select("k", *(F.get("corners", F.lit(i))[a].cast("double").alias(f"{a}{i}") for i in range(4) for a in "xy"))


@_query(
    f"""select k, abs(ax * "by" - bx * ay + bx * cy - cx * "by" + cx * dy - dx * cy + dx * ay - ax * dy) / 2 as area,
    round((sqrt((ax - bx) ** 2 + (ay - "by") ** 2) + sqrt((dx - cx) ** 2 + (dy - cy) ** 2)) / (sqrt((ax - dx) ** 2 + (ay - dy) ** 2) + sqrt((bx - cx) ** 2 + ("by" - cy) ** 2)), 6) as aspect_ratio
    from (select k, cast(ax as double) as ax, cast(ay as double) as ay, cast(bx as double) as bx, cast("by" as double) as "by", cast(cx as double) as cx, cast(cy as double) as cy, cast(dx as double) as dx, cast(dy as double) as dy from ({_CORNERS}) as t) as u"""
)
def quad_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quad(spark, sf_dir).withColumn("m", g.quad_measures(F.col("corners"), F.lit(1e6)))
    return rows.select("k", F.col("m.area").alias("area"), F.round("m.aspect_ratio", 6).alias("aspect_ratio"))


#: Every embedding as an image of 8 x 8 gray levels.
_PIXELS = "select vec_id, i - 1 as place, cast(floor(abs(embedding[i]) * 1000) % 256 as int) as v from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings) as t"


def _images(spark: SparkSession, sf_dir: str, kind: str, measure: Callable[[np.ndarray], tuple]) -> DataFrame:
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in kind.split(", ")]
        for frame in frames:
            rows = [(k, *measure(np.asarray(v, np.uint8).reshape(8, 8))) for k, v in zip(frame["vec_id"], frame["px"], strict=True)]
            yield pd.DataFrame(rows, columns=["vec_id", *names])

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    px = F.transform("embedding", lambda v: (F.floor(F.abs(v).cast("float") * F.lit(1000).cast("float")) % 256).cast("int"))
    return rows.select("vec_id", px.alias("px")).mapInPandas(go, f"vec_id long, {kind}")


@_query(f"select vec_id, avg((v >= 246)::int) as bright, avg((v < 10)::int) as dark, avg((v > 0)::int) as not_black, avg((v < 255)::int) as not_white from ({_PIXELS}) as p group by vec_id")
def image_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    measure = lambda m: (*map(float, imaging.exposure(m)), np.count_nonzero(m) / m.size, np.count_nonzero(m != 255) / m.size)
    return _images(spark, sf_dir, "bright double, dark double, not_black double, not_white double", measure)


_NEXT = "case when {0} {1} between 0 and 7 then {0} {1} when {0} {1} < 0 then 1 else 6 end"
_UP, _DOWN, _LEFT, _RIGHTWARD = (_NEXT.format(c, d) for c, d in (("r", "- 1"), ("r", "+ 1"), ("c", "- 1"), ("c", "+ 1")))


@_query(
    f"""with p as (select vec_id, place // 8 as r, place % 8 as c, v from ({_PIXELS}) as q),
    l as (select p.vec_id, u.v + d.v + e.v + w.v - 4 * p.v as x from (select *, {_UP} as up, {_DOWN} as dn, {_LEFT} as lf, {_RIGHTWARD} as rt from p) as p
        join p as u on u.vec_id = p.vec_id and u.r = p.up and u.c = p.c join p as d on d.vec_id = p.vec_id and d.r = p.dn and d.c = p.c
        join p as e on e.vec_id = p.vec_id and e.r = p.r and e.c = p.lf join p as w on w.vec_id = p.vec_id and w.r = p.r and w.c = p.rt)
    select vec_id, round(var_pop(x) + 1e-7, 4) as blur_score, var_pop(x) < 20000 as is_blurry from l group by vec_id"""
)
def image_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _images(spark, sf_dir, "score double", lambda m: (imaging.laplacian_variance(m),))
    return rows.select("vec_id", F.round(F.col("score") + 1e-7, 4).alias("blur_score"), (F.col("score") < 20000).alias("is_blurry"))


@_query()
def image_glare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest bright area of each image; a component is no SQL, so the tests compare it with a search by hand."""
    return _images(spark, sf_dir, "largest int, has_glare boolean", lambda m: (imaging.largest_component(m > 128), imaging.glare(m)))


@_query()
def image_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean gray level after denoising, equalisation and thresholding."""
    return _images(spark, sf_dir, "denoised double, equalised double, white double", lambda m: (float(imaging.denoised(m).mean()), float(imaging.clahe(m).mean()), float((imaging.adaptive_threshold(m) > 0).mean())))


#: Reports made from orders and customers: a label and a value beside it on each line.
_REPORTS = f"""select g.k as doc_id, c_name as name, g.raw as gender, a.raw as age from ({GENDERS}) as g join ({AGES}) as a on a.k = g.k
    join orders on o_orderkey = g.k join customer on c_custkey = o_custkey"""


def _report_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def box(text: Column, x: int, y: Column) -> Column:
        corner = lambda dx, dy: F.struct((F.lit(x) + dx).cast("float").alias("x"), (y + dy).cast("float").alias("y"))
        return F.struct(text.alias("text"), F.lit(0.9).cast("float").alias("confidence"), F.lit(0.0).cast("float").alias("direction"), F.array(corner(0, 0), corner(150, 0), corner(150, 60), corner(0, 60)).alias("points"))

    shift = F.col("doc_id") % 40
    lines = [box(F.lit("检查所见"), 200, F.lit(60))]
    for i, (label, value) in enumerate((("姓名：", "name"), ("性别：", "gender"), ("年龄：", "age"))):
        y = F.lit(300 + 400 * i)
        lines += [box(F.lit(label), 200, y), box(F.col(value), 450, y + shift)]
    return made(spark, sf_dir, _REPORTS).select(F.col("doc_id"), F.lit(WIDE).alias("image_width"), F.lit(TALL).alias("image_height"), F.array(*lines).alias("boxes"))


_REPORT_TEMPLATE = """{"template_id": "report", "document_type": "ultrasound_report", "required_keywords": ["姓名", "性别"], "optional_keywords": ["年龄"], "fields": {
    "name": {"anchors": ["姓名"]}, "gender": {"anchors": ["性别"], "data_type": "gender"}, "age": {"anchors": ["年龄"], "data_type": "age"}}}"""


def _shown(raw: str, new: str) -> str:
    return f"case when {raw} = '' then '' else {new} end"


@_query(
    f"""select doc_id, 'ultrasound_report' as type, 12 as score, {_strip('name')} as name, {_shown('gender', f"coalesce(nullif({_gender('gender')}, ''), {_strip('gender')})")} as gender,
    {_shown('age', f"case when {_age('age')} >= 0 then cast({_age('age')} as varchar) else {_strip('age')} end")} as age from ({_REPORTS}) as t"""
)
def extract_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: boxes to typed fields, for a report of each order."""
    rows = extraction.extraction(_report_docs(spark, sf_dir), templates.from_json(spark, [_REPORT_TEMPLATE]), F.lit("2026-07-20"))
    value = lambda n: F.try_element_at("fields", F.lit(n))["value"].alias(n)
    return rows.select("doc_id", "type", "score", value("name"), value("gender"), value("age"))


def _field_text(name: str, value: str, raw: str, status: str) -> str:
    """SQL of a field's lines in a result document; null where value and raw value are empty."""
    other = f"""case when {raw} <> '' and {raw} <> {value} then '      "raw_value" : "' || {raw} || '",\n' else '' end"""
    return f"""case when {raw} <> '' then '    "{name}" : {{\n      "confidence" : 0.8999999761581421,\n      "extraction_method" : "anchor_right",\n' || {other}
        || '      "validation_status" : "' || {status} || '",\n      "value" : "' || {value} || '"\n    }}' end"""


def _result_sql() -> str:
    names, genders, ages = _strip("name"), _strip("gender"), _strip("age")
    sex, years = _gender("gender"), _age("age")
    parsed, known = f"({years} >= 0)", f"({sex} <> '')"
    fields = (
        _field_text("age", "age_value", "age_raw", f"case when {parsed} then 'valid' else 'uncertain' end"),
        _field_text("gender", "gender_value", "gender_raw", f"case when {known} then 'valid' else 'uncertain' end"),
        _field_text("name", "name_value", "name", "case when name_value = '' then 'invalid' else 'valid' end"),
    )
    head = """'{\n  "document" : {\n    "image_height" : 3508,\n    "image_width" : 2480,\n    "page_type" : "unknown",\n    "template_id" : "report",\n    "type" : "ultrasound_report"\n  },
  "error_code" : 0,\n  "message" : "Success",\n  "patient" : {\n'"""
    tail = """'\n  },\n  "quality" : {\n    "blur_score" : 0.0,\n    "document_detected" : true,\n    "is_blurry" : false,\n    "is_overexposed" : false\n  },\n  "success" : true,\n  "warnings" : [ '"""
    told = f"""concat_ws(', ', case when age <> '' and not {parsed} then '"Age could not be parsed: ''' || {ages} || '''"' end,
        case when gender <> '' and not {known} then '"Gender value could not be normalized: ''' || gender || '''"' end, '"Matched template: report (score: 12)"')"""
    shown = f"""select *, {names} as name_value, case when {known} then {sex} else {genders} end as gender_value, case when {known} then {genders} else gender end as gender_raw,
        case when {parsed} then cast({years} as varchar) else {ages} end as age_value, case when {parsed} then {ages} else age end as age_raw from ({_REPORTS}) as r"""
    return f"select doc_id, 0 as error_code, {head} || concat_ws(',\n', {', '.join(fields)}) || {tail} || {told} || ' ]\n}}' as json from ({shown}) as t"


@_query(_result_sql())
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents of the same reports."""
    return result.as_json(pipeline.from_boxes(_report_docs(spark, sf_dir), templates.from_json(spark, [_REPORT_TEMPLATE]), as_of=F.lit("2026-07-20")))


_SAID = ", ".join(f"'{b[0]}'" for b in recorded.SAMPLE)


@_query(
    f"""select p_partkey as doc_id, case when p_partkey % 5 = 0 then 2003 else 0 end as error_code, case when p_partkey % 5 > 0 then {len(recorded.SAMPLE)} else -1 end as n_boxes,
    case when p_partkey % 5 > 0 then {recorded.SAMPLE_SIZE[0]} end as image_width, case when p_partkey % 5 > 0 then [{_SAID}][p_partkey % {len(recorded.SAMPLE)} + 1] end as text from part"""
)
def mock_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded boxes for every image but those that failed before; a box of each is shown."""
    image = F.expr("named_struct('height', 1, 'width', 1, 'n_channels', 1, 'data', cast('x' as binary))")
    code = F.when(F.col("p_partkey") % 5 == 0, 2003).otherwise(0)
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), code.alias("error_code"), image.alias("image"))
    nth = (F.col("doc_id") % len(recorded.SAMPLE)).cast("int")
    return engines.recognised(docs, Engine()).select("doc_id", "error_code", F.coalesce(F.size("boxes"), F.lit(-1)).alias("n_boxes"), "image_width", F.get("boxes", nth)["text"].alias("text"))


#: A bitmap of 3 x 2 pixels whose gray levels follow the key, in colours of a PNM file.
_GRAYS = "[k % 251, k * 7 % 251, k * 11 % 251, k * 13 % 251, k * 17 % 251, k * 19 % 251]"


@_query(
    f"""select k, case when k % 7 = 0 then 9001 when k % 7 = 1 then 2003 else 0 end as error_code, case when k % 7 > 1 then 3 end as width, case when k % 7 > 1 then 2 end as height,
    case when k % 7 > 1 then list_transform({_GRAYS}, lambda g: lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(g)), 2, '0')).array_to_string('') end as data
    from (select p_partkey as k from part) as t"""
)
def decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded images from bytes: none, broken ones and gray bitmaps."""
    k = F.col("p_partkey")
    grays = F.concat_ws("", *(F.lpad(F.hex(k * n % 251), 2, "0") for n in (1, 7, 11, 13, 17, 19)))
    whole = F.concat(F.lit("P5 3 2 255\n").cast("binary"), F.unhex(grays))
    content = F.when(k % 7 == 0, F.lit("").cast("binary")).when(k % 7 == 1, F.substring(whole, 1, 14)).otherwise(whole)
    rows = images.decoded(spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("doc_id"), content.alias("content")))
    return rows.select(F.col("doc_id").cast("long").alias("k"), "error_code", "image.width", "image.height", F.lower(F.hex("image.data")).alias("data"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Settings under which the queries run.
DEFAULTS = Config()
