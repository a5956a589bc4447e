import json
import random

from pyspark.sql import functions as F

from docfields import schema
from docfields.functions import geometry as g
from docfields.operators import extract, keywords, relational
from docfields.plans import extraction
from docfields.sources import recorded, templates


def rect(text, x, y, w, h, confidence=0.9):
    return recorded.box(text, x, y, x + w, y + h, confidence)


def docs(spark, *boxes):
    return spark.createDataFrame([(str(i), 1000, 1000, b) for i, b in enumerate(boxes)], schema.RECOGNISED)


def found(spark, boxes, column):
    return docs(spark, boxes).withColumn("p", extract.placed(F.col("boxes"))).select(column).first()[0]


def words(*w):
    return F.array(*map(F.lit, w))


NAME = [rect("姓名：", 100, 100, 120, 30), rect("张三", 250, 100, 80, 30)]


def test_anchor(spark):
    a = extract.anchor(F.col("p"), words("姓名"))["idx"]
    assert found(spark, NAME, a) == 0
    assert found(spark, [rect("Hello", 0, 0, 1, 1)], a) is None


def test_right_and_below(spark):
    a = extract.anchor(F.col("p"), words("姓名", "标题"))
    right = lambda tol, far: extract.right(F.col("p"), a, F.lit(tol), F.lit(far))["idx"]
    assert found(spark, [*NAME, rect("Other", 100, 500, 80, 30)], right(30, 300)) == 1
    assert found(spark, [NAME[0], rect("张三", 250, 200, 80, 30)], right(20, 300)) is None
    assert found(spark, [NAME[0], rect("张三", 800, 100, 80, 30)], right(30, 100)) is None
    assert found(spark, [rect("标题", 100, 100, 120, 30), rect("值在下方", 120, 150, 120, 30)], extract.beneath(F.col("p"), a, F.lit(200))["idx"]) == 1
    tie = [rect("姓名", 0, 0, 10, 10), rect("b", 100, 5, 10, 10), rect("c", 100, -5, 10, 10)]
    assert found(spark, tie, right(30, 300)) == 1


def template(spark, fields):
    import json

    return templates.from_json(spark, [json.dumps({"template_id": "t", "document_type": "ct_report", "optional_keywords": [""], "fields": fields})])


def extracted(spark, boxes, fields):
    row = extraction.extraction(docs(spark, boxes), template(spark, fields), F.lit("2026-07-20")).first()
    return {k: v.value for k, v in row["fields"].items()}, row["warnings"]


def test_region_judges_the_nearest(spark):
    boxes = [*NAME, rect("李四", 330, 100, 80, 30)]
    rule = {"anchors": ["姓名"], "region": [310, 0, 1000, 1000]}
    assert extracted(spark, boxes, {"name": rule})[0] == {}
    assert extracted(spark, boxes, {"name": {**rule, "region": [0, 0, 1000, 1000]}})[0] == {"name": "张三"}
    assert extracted(spark, boxes, {"name": {**rule, "region": [0, 0]}})[0] == {"name": "张三"}


def test_direction_and_kind(spark):
    boxes = [NAME[0], rect("下", 100, 160, 120, 30)]
    assert extracted(spark, boxes, {"name": {"anchors": ["姓名"]}})[0] == {"name": "下"}  # falls back below
    # The kind alone does not change the direction, and its other way is right again.
    assert extracted(spark, boxes, {"name": {"anchors": ["姓名"], "extraction_type": "anchor_below"}})[0] == {}
    assert extracted(spark, boxes, {"name": {"anchors": ["姓名"], "search_direction": "below"}})[0] == {"name": "下"}


def test_paragraph(spark):
    lines = [rect("检查所见", 100, 500, 100, 30), rect("two", 100, 680, 100, 30), rect("one", 100, 600, 100, 30), rect("诊断意见", 100, 800, 100, 30), rect("after", 100, 880, 100, 30)]
    rule = {"findings": {"start_anchors": ["检查所见"], "end_anchors": ["诊断意见"], "extraction_type": "paragraph_between_anchors", "data_type": "text"}}
    assert extracted(spark, lines, rule) == ({"findings": "one\ntwo"}, ["Matched template: t (score: 2)"])
    assert extracted(spark, lines[:3], rule)[0] == {}
    assert extracted(spark, lines[1:], rule)[0] == {}


def test_all_fields(spark):
    boxes = [*NAME, rect("性别：", 400, 100, 60, 30), rect("男", 500, 100, 30, 30), rect("年龄", 600, 100, 60, 30), rect("37岁", 700, 100, 60, 30), rect("出生日期", 100, 200, 100, 30), rect("1988年9月21日", 250, 200, 150, 30)]
    fields = {"name": {"anchors": ["姓名"]}, "gender": {"anchors": ["性别"], "data_type": "gender"}, "age": {"anchors": ["年龄"], "data_type": "age"}, "birth_date": {"anchors": ["出生日期"], "data_type": "date"}, "other": {"anchors": ["zz"]}}
    got, warnings = extracted(spark, boxes, fields)
    assert got == {"name": "张三", "gender": "男", "age": "37", "birth_date": "1988-09-21"}
    assert warnings == ["Field 'other' could not be extracted", "Matched template: t (score: 2)"]
    assert extracted(spark, [rect("x", 0, 0, 1, 1)], {}) == ({}, ["Matched template: t (score: 2)"])


def test_no_template(spark):
    row = extraction.extraction(docs(spark, [rect("ultrasound", 0, 0, 1, 1)]), templates.from_json(spark, ["[]", "{", '{"template_id": ""}'])).first()
    assert (row["type"], row["template_id"], row["warnings"]) == ("ultrasound_report", "", ["No template matched. Document type: ultrasound_report", "Templates loaded: 0, none matched the report"])


def test_arrays_of_templates(spark, monkeypatch):
    """Any length of the arrays gives the same matches; rows need no key, and of equal templates the first loaded wins."""
    rng = random.Random(3)
    known = [
        {"template_id": f"t{i:02}", "required_keywords": rng.sample("abcdef", rng.randrange(3)), "title_keywords": rng.sample("abcdef", 2), "optional_keywords": rng.sample("abcdef", rng.randrange(3))}
        for i in range(23)
    ]
    texts = [None, "", "zz", *("".join(rng.sample("abcdefgh", rng.randrange(1, 8))) for _ in range(60)), "abcdef", "abcdef"]
    rows = spark.createDataFrame([(None if i % 5 == 0 else i % 7, t) for i, t in enumerate(texts)], "doc_id int, t string").coalesce(1)
    loaded = templates.from_json(spark, [json.dumps(x) for x in known])

    def points(t, x):
        hits = [sum(k in t for k in x[f"{kind}_keywords"]) for kind in ("title", "required", "optional")]
        return sum(n * p for n, p in zip(hits, keywords.POINTS[1:], strict=True)) if hits[1] == len(x["required_keywords"]) else 0

    def best(t):
        score, back = max((points(t, x), -i) for i, x in enumerate(known)) if t is not None else (0, 0)
        return (t, score, known[-back]["template_id"]) if score > 0 else (t, None, None)

    for chunk in (3, 23, 100):
        monkeypatch.setattr(keywords, "CHUNK", chunk)
        got = keywords.matched(rows, loaded, F.col("t")).select("t", "match.score", "match.template.template_id", "templates_loaded").collect()
        assert [tuple(r)[:3] for r in got] == [best(t) for t in texts] and {r[3] for r in got} == {23}


def test_columns_and_joins_agree(spark):
    rng = random.Random(7)
    pages = [[rect(rng.choice(["ab", "cd", "ef", "gh"]), rng.randrange(0, 900, 10), rng.randrange(0, 900, 10), 40, 20) for _ in range(25)] for _ in range(40)]
    frame = docs(spark, *pages)
    rows = frame.withColumn("p", extract.placed(F.col("boxes"))).withColumn("a", extract.anchor(F.col("p"), words("ab")))
    boxes = relational.exploded(frame)
    starts = relational.anchors(boxes, ["ab"])
    for column, joined in (
        (extract.right(F.col("p"), F.col("a"), F.lit(30), F.lit(300)), relational.nearest_right(boxes, starts, 30, 300)),
        (extract.beneath(F.col("p"), F.col("a"), F.lit(300)), relational.nearest_below(boxes, starts, 300)),
    ):
        one = {(r[0], r[1]) for r in rows.withColumn("v", column).where("v is not null").select("doc_id", "v.idx").collect()}
        assert one == {(r["doc_id"], r["box_idx"]) for r in joined.collect()} and one
    rule = F.struct(words("ab").alias("start_anchors"), words("cd", "ef").alias("end_anchors"))
    one = {tuple(r) for r in rows.withColumn("f", extract.paragraph(F.col("p"), rule)).where("f is not null").select("doc_id", "f.value").collect()}
    assert one == {tuple(r) for r in relational.between(boxes, ["ab"], ["cd", "ef"]).select("doc_id", "value").collect()} and one


def test_corners_and_pages(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).cast("float").alias("x"), F.lit(float(y)).cast("float").alias("y"))
    mixed = F.array(p(1100, 80), p(100, 100), p(80, 1520), p(1150, 1500))
    got = spark.range(1).select(g.ordered_corners(mixed)).first()[0]
    assert [tuple(x) for x in got] == [(100, 100), (1100, 80), (1150, 1500), (80, 1520)]
    ratios = [210 / 297, 297 / 210, 1.0, 3.0, 0.0, -1.0]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ratios], "r double").select(g.page_type(F.col("r"))).collect()] == ["A4", "A4", *["unknown"] * 4]
