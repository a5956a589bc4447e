import json
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfields import config
from docfields.config import Config, Engine, ServiceError
from docfields.plans import pipeline, result
from docfields.plans.service import Service
from docfields.sources import engines, images, recorded, templates
from docfields.streaming import files

#: Labels and headings of the built-in sample document, which the rules must find.
FIELDS = {
    "name": {"anchors": ["姓名"], "region": [0, 0, 1000, 400]}, "gender": {"anchors": ["性别"], "data_type": "gender", "max_distance": 200},
    "age": {"anchors": ["年龄"], "data_type": "age", "max_distance": 200}, "birth_date": {"anchors": ["出生日期"], "data_type": "date"},
    "id_number": {"anchors": ["身份证号"], "data_type": "id_number", "max_distance": 350}, "department": {"anchors": ["科室"], "max_distance": 200},
    "exam_date": {"anchors": ["检查日期"], "data_type": "date"}, "exam_name": {"anchors": ["检查项目"], "max_distance": 300},
    "report_doctor": {"anchors": ["报告医生"], "max_distance": 200}, "review_doctor": {"anchors": ["审核医生"], "max_distance": 200},
    "findings": {"start_anchors": ["检查所见"], "end_anchors": ["诊断意见"], "extraction_type": "paragraph_between_anchors", "data_type": "text"},
    "impression": {"start_anchors": ["诊断意见"], "end_anchors": ["报告医生"], "extraction_type": "paragraph_between_anchors", "data_type": "text"},
}
TEMPLATE = {
    "template_id": "us", "document_type": "ultrasound_report", "hospital_keywords": ["某某市第一人民医院", "某某医院"], "title_keywords": ["超声检查报告", "超声波检查报告"],
    "required_keywords": ["姓名", "性别", "检查所见"], "optional_keywords": ["年龄", "出生日期", "身份证号"], "fields": FIELDS,
}


def test_sample_document(spark):
    rows = pipeline.from_boxes(recorded.sample(spark), templates.from_json(spark, [json.dumps(TEMPLATE)]), as_of=F.lit("2026-07-20"))
    text = result.as_json(rows).first()["json"]
    got = json.loads(text)
    assert got["document"] == {"image_height": 3508, "image_width": 2480, "page_type": "unknown", "template_id": "us", "type": "ultrasound_report"}
    assert {k: v["value"] for k, v in got["patient"].items()} == {"age": "37", "birth_date": "1988-09-21", "gender": "男", "id_number": "4403**********1234", "name": "张三"}
    assert got["patient"]["id_number"]["checksum_valid"] is False and got["patient"]["id_number"]["raw_value"] == "4403**********1234"
    assert got["patient"]["age"]["raw_value"] == "37岁" and "raw_value" not in got["patient"]["name"]
    assert got["examination"]["department"]["value"] == "超声科" and "hospital_name" not in got["examination"]
    assert got["warnings"] == ["ID number checksum failed", "Matched template: us (score: 39)"]
    assert '"confidence" : 0.9800000190734863' in text and list(got) == sorted(got)
    plain = json.loads(result.as_json(rows, masked=False).first()["json"])
    assert plain["patient"]["id_number"]["value"] == "440305198809211234" and "checksum_valid" not in plain["patient"]["id_number"]


def test_recorded_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"boxes": [{"text": "x"}, {"points": [{"x": 1, "y": 2}]}]}')
    (tmp_path / "b.json").write_text("{")
    row = recorded.read(spark, str(tmp_path)).collect()
    assert len(row) == 1 and (row[0]["image_width"], row[0]["image_height"]) == (2480, 3508)
    assert [(b.text, round(b.confidence, 4), [tuple(p) for p in b.points]) for b in row[0]["boxes"]] == [("x", 0.95, [(0, 0)] * 4), ("", 0.95, [(0, 0)] * 4)]


def test_templates(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"template_id": "b", "required_keywords": ["k"], "title_keywords": ["k"]}))
    (tmp_path / "a.json").write_text(json.dumps({"template_id": "a", "required_keywords": ["k"], "title_keywords": ["k"], "fields": {"z": {}, "c": {"search_direction": "below", "region": [1, 2]}}}))
    (tmp_path / "bad.json").write_text('{"template_id": 3, "fields": 4}')
    (tmp_path / "n.txt").write_text(json.dumps({"template_id": "n"}))
    rows = templates.read(spark, str(tmp_path)).orderBy("load_order").collect()
    assert [r["template_id"] for r in rows] == ["a", "b"] and rows[0]["document_type"] == "unknown"
    rules = rows[0]["rules"]
    assert [r.name for r in rules] == ["c", "z"] and rules[0].rule.region is None
    assert [(r.rule.search_direction, r.rule.extraction_type, r.rule.same_line_tolerance, r.rule.max_distance, r.rule.data_type) for r in rules] == [("below", "anchor_below", 20, 250, "string"), ("right", "anchor_right", 20, 250, "string")]


def test_config(tmp_path):
    got = config.parse('{"ocr": {"engine": "x", "minimum_confidence": 0.5}, "preprocessing": {"minimum_width": 5, "enable_denoise": false}, "privacy": {"mask_id_number": false}}')
    assert (got.engine.engine, got.quality.minimum_width, got.preprocess.enable_denoise, got.mask_id_number) == ("x", 5, False, False)
    assert config.load(None) == Config() and got.templates_directory == "./config/templates"
    for bad in (lambda: config.parse("{"), lambda: config.parse("[]"), lambda: config.load(str(tmp_path / "none"))):
        with pytest.raises(ServiceError) as e:
            bad()
        assert e.value.code == 1003


def image_rows(spark, *pictures):
    rows = [(str(i), None if p is None else images.packed(p)) for i, p in enumerate(pictures)]
    return spark.createDataFrame(rows, f"doc_id string, image {images.IMAGE}")


def test_service(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(TEMPLATE))
    settings = {"templates_directory": str(tmp_path), "preprocessing": {"minimum_width": 50, "minimum_height": 50, "target_width": 60, "target_height": 80}}
    (tmp_path / "c.cfg").write_text(json.dumps(settings))
    service = Service(spark)
    with pytest.raises(ServiceError) as e:
        service.recognize_files("x")
    assert e.value.code == 1001
    with pytest.raises(ServiceError) as e:
        service.init(config_path=str(tmp_path / "missing"))
    assert e.value.code == 1003 and service.last_error
    service.init(config_path=str(tmp_path / "c.cfg"))
    with pytest.raises(ServiceError) as e:
        service.init()
    assert e.value.code == 1005
    with pytest.raises(ServiceError) as e:
        service.recognize_files(None)
    assert e.value.code == 9001
    noise = np.random.default_rng(0).integers(0, 255, (90, 70, 3)).astype(np.uint8)
    rows = service.recognize_images(image_rows(spark, noise, np.zeros((90, 70, 3), np.uint8), noise[:20], None), "2026-07-20").orderBy("doc_id").collect()
    assert [r["error_code"] for r in rows] == [0, 2004, 2004, 9001]
    got = json.loads(rows[0]["json"])
    assert got["success"] and got["document"]["template_id"] == "us" and got["patient"]["name"]["value"] == "张三"
    assert json.loads(rows[1]["json"])["warnings"] == [pipeline.NO_DOCUMENT]
    assert [r["error_code"] for r in service.recognize_files(str(tmp_path / "none.png")).collect()] == [2001]
    (tmp_path / "junk.png").write_bytes(b"no image")
    assert [r["error_code"] for r in service.recognize_files(str(tmp_path / "junk.png")).collect()] == [2003]
    service.shutdown()
    assert service.version() == "1.0.0"


def broken(settings):
    class Broken:
        def recognise(self, image):
            raise ValueError("no text")

    return Broken()


def test_engines(spark, tmp_path):
    for engine, code in (("none", 1002), ("paddle", 1004)):
        with pytest.raises(ServiceError) as e:
            engines.checked(Engine(engine=engine, model_directory=str(tmp_path)))
        assert e.value.code == code
    rows = image_rows(spark, np.zeros((4, 4, 3), np.uint8)).withColumn("error_code", F.lit(0))
    make = types.FunctionType(broken.__code__, {"__builtins__": __builtins__})  # travels by value, as workers do not import tests
    row = engines.recognised(rows, Engine(), lambda s: make(s)).first()
    assert (row["error_code"], row["boxes"]) == (3001, None)
    (tmp_path / "r.json").write_text('{"image_width": 7, "boxes": [{"text": "q"}]}')
    row = engines.recognised(rows, Engine(mock_data_path=str(tmp_path / "r.json"))).first()
    assert (row["image_width"], [b.text for b in row["boxes"]]) == (7, ["q"])


def test_stream_equals_batch(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text(json.dumps({"boxes": [{"text": f"姓名 性别 检查所见 {i}"}]}))
    known = templates.from_json(spark, [json.dumps(TEMPLATE)])
    files.write(files.results(files.recorded(spark, str(source)), known, as_of=F.lit("2026-07-20")), str(out), str(tmp_path / "ck")).awaitTermination()
    batch = result.as_json(pipeline.from_boxes(recorded.read(spark, str(source)), known, as_of=F.lit("2026-07-20")))
    strip = lambda rows: sorted(r["json"] for r in rows)
    assert strip(spark.read.parquet(str(out)).collect()) == strip(batch.collect()) and batch.count() == 3
