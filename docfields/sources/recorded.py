"""Recorded recognition results: JSON files and a built-in sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields import schema

_ZEROS = "array_repeat(named_struct('x', cast(0 as float), 'y', cast(0 as float)), 4)"


def _defaults(boxes: Column) -> Column:
    def one(b: Column) -> Column:
        points = F.when(F.size(b["points"]) == 4, F.transform(b["points"], lambda p: F.struct(F.coalesce(p["x"], F.lit(0.0)).cast("float").alias("x"), F.coalesce(p["y"], F.lit(0.0)).cast("float").alias("y"))))
        return F.struct(
            F.coalesce(b["text"], F.lit("")).alias("text"),
            F.coalesce(b["confidence"], F.lit(0.95).cast("float")).alias("confidence"),
            F.coalesce(b["direction"], F.lit(0.0).cast("float")).alias("direction"),
            F.coalesce(points, F.expr(_ZEROS)).alias("points"),
        )

    return F.transform(F.coalesce(boxes, F.expr(f"cast(array() as {schema.BOXES})")), one)


#: How files are read, in batches and in streams alike.
KIND, OPTIONS = f"image_width int, image_height int, boxes {schema.BOXES}, _bad string", {"multiLine": True, "columnNameOfCorruptRecord": "_bad"}


def parsed(rows: DataFrame) -> DataFrame:
    """doc_id, image_width, image_height, boxes of what was read as ``KIND``."""
    rows = rows.withColumn("doc_id", F.input_file_name())
    # The second condition always holds: a query of the error column alone is refused.
    rows = rows.where("_bad is null and coalesce(size(boxes), 0) >= -1")
    return rows.select(
        "doc_id",
        F.coalesce("image_width", F.lit(2480)).alias("image_width"),
        F.coalesce("image_height", F.lit(3508)).alias("image_height"),
        _defaults(F.col("boxes")).alias("boxes"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path), image_width, image_height, boxes of JSON files, one document each; missing keys get their defaults.

    Files that hold no JSON object are left out.
    """
    return parsed(spark.read.schema(KIND).options(**OPTIONS).json(path))


#: The built-in sample's texts with left, top, right and bottom in pixels, and a confidence.
SAMPLE_SIZE = (2480, 3508)
SAMPLE = (
    ("某某市第一人民医院", 800, 80, 1680, 140, 0.98),
    ("超声检查报告", 950, 160, 1480, 230, 0.98),
    ("姓名：", 200, 300, 350, 360, 0.98),
    ("张三", 380, 300, 560, 360, 0.98),
    ("性别：", 700, 300, 850, 360, 0.98),
    ("男", 880, 300, 960, 360, 0.98),
    ("年龄：", 1100, 300, 1250, 360, 0.98),
    ("37岁", 1280, 300, 1400, 360, 0.98),
    ("出生日期：", 200, 380, 420, 440, 0.98),
    ("1988-09-21", 450, 380, 700, 440, 0.98),
    ("身份证号：", 200, 460, 430, 520, 0.98),
    ("440305198809211234", 460, 460, 880, 520, 0.98),
    ("科室：", 200, 540, 330, 600, 0.98),
    ("超声科", 360, 540, 520, 600, 0.98),
    ("检查日期：", 200, 620, 430, 680, 0.98),
    ("2026-07-20", 460, 620, 700, 680, 0.98),
    ("检查项目：", 200, 700, 430, 760, 0.98),
    ("腹部超声检查", 460, 700, 760, 760, 0.98),
    ("检查所见：", 200, 900, 430, 970, 0.98),
    (
        "肝脏形态大小正常，表面光滑，实质回声均匀。肝内管道系统走行正常，门静脉内径正常。胆囊大小形态正常，壁光滑，腔内未见异常回声。"
        "胆总管未见扩张。胰腺形态大小正常，实质回声均匀，胰管未见扩张。脾脏大小形态正常，实质回声均匀。双肾大小形态正常，实质回声均匀，集合系统未见分离。",
        200, 1000, 2280, 1400, 0.96,
    ),
    ("诊断意见：", 200, 1500, 430, 1570, 0.98),
    ("1. 肝脏、胆囊、胰腺、脾脏、双肾未见明显异常。\n2. 建议定期复查。", 200, 1600, 2280, 1800, 0.97),
    ("报告医生：", 200, 1950, 430, 2010, 0.98),
    ("李医生", 460, 1950, 620, 2010, 0.98),
    ("审核医生：", 900, 1950, 1130, 2010, 0.98),
    ("王主任", 1160, 1950, 1360, 2010, 0.98),
    ("本报告仅供临床参考，不作为最终诊断依据。", 700, 2150, 1800, 2210, 0.95),
)


def box(text: str, left: float, top: float, right: float, bottom: float, confidence: float = 0.98, direction: float = 0.0) -> tuple:
    corners = ((left, top), (right, top), (right, bottom), (left, bottom))
    return text, confidence, direction, [(float(x), float(y)) for x, y in corners]


def sample(spark: SparkSession, doc_id: str = "sample") -> DataFrame:
    """The built-in sample document."""
    return spark.createDataFrame([(doc_id, *SAMPLE_SIZE, [box(*b) for b in SAMPLE])], schema.RECOGNISED)
