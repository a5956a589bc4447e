"""Types and closed value sets of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:float,y:float>"
BOX = f"struct<text:string,confidence:float,direction:float,points:array<{POINT}>>"
BOXES = f"array<{BOX}>"
#: A document's recognised text; boxes are in reading order, and that order counts.
RECOGNISED = f"doc_id string, image_width int, image_height int, boxes {BOXES}"
RULE = (
    "struct<anchors:array<string>,search_direction:string,same_line_tolerance:int,max_distance:int,region:array<int>,"
    "data_type:string,extraction_type:string,start_anchors:array<string>,end_anchors:array<string>>"
)
TEMPLATE = (
    "template_id string, document_type string, description string, hospital_keywords array<string>, title_keywords array<string>, "
    f"required_keywords array<string>, optional_keywords array<string>, fields map<string,{RULE}>"
)
FIELD = f"struct<value:string,raw_value:string,confidence:float,source_bbox:array<{POINT}>,extraction_method:string,validation_status:string>"
QUALITY = "struct<blur_score:double,is_blurry:boolean,is_overexposed:boolean,document_detected:boolean>"

PATIENT = ("name", "gender", "birth_date", "age", "id_number")
EXAMINATION = ("hospital_name", "report_type", "exam_name", "exam_date", "department", "findings", "impression", "report_doctor", "review_doctor")

DOCUMENT_TYPES = ("ultrasound_report", "ct_report", "mri_report", "xray_report", "laboratory_report")
STATUSES = ("valid", "invalid", "uncertain", "not_validated")
METHODS = ("anchor_right", "anchor_below", "anchor_region", "paragraph_between_anchors", "regex", "default")

#: Error codes and their texts.
ERRORS = {
    0: "Success",
    1001: "Not initialized",
    1002: "Initialization failed",
    1003: "Configuration file not found",
    1004: "Model loading failed",
    1005: "Already initialized",
    2001: "Image file not found",
    2002: "Unsupported image format",
    2003: "Image decode failed",
    2004: "Image quality check failed",
    3001: "OCR recognition failed",
    3002: "OCR returned no results",
    4001: "Field extraction failed",
    4002: "No template matched",
    5001: "Output memory allocation failed",
    9000: "Unknown error",
    9001: "Invalid argument",
    9002: "Internal exception",
}


def document_type(name: Column) -> Column:
    """``name`` if it is one of the known types, else ``unknown``."""
    return F.when(name.isin(*DOCUMENT_TYPES), name).otherwise(F.lit("unknown"))


def error_text(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ERRORS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), F.lit("Unrecognized error code"))
