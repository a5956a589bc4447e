"""Classification by keywords and the choice of a template.

Keyword lists and templates are reference data: the fixed lists become literals, and templates go to the executors
in arrays of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions.scalars import ascii_lower

#: Keywords of each document type.
KEYWORDS = {
    "ultrasound_report": ("超声", "超声波", "B超", "彩超", "多普勒", "ultrasound", "sonography"),
    "ct_report": ("CT", "计算机断层", "螺旋CT", "ct scan", "computed tomography"),
    "mri_report": ("磁共振", "MRI", "核磁", "MR", "magnetic resonance"),
    "xray_report": ("X线", "X光", "胸片", "DR", "CR", "数字摄影", "xray", "x-ray", "radiograph"),
    "laboratory_report": ("检验报告", "化验", "检验", "生化", "血常规", "尿常规", "laboratory", "lab report"),
}
#: Points for each hospital, title, required and optional keyword that is there.
POINTS = (10, 8, 5, 2)
#: Templates in one array; every array is broadcast by itself.
CHUNK = 10_000


def keyword_hits(text: Column, keywords: Column) -> Column:
    """How many of the keywords are in the text; one listed twice counts twice."""
    return F.coalesce(F.size(F.filter(keywords, lambda k: F.contains(text, k))), F.lit(0))


def all_present(text: Column, keywords: Column) -> Column:
    return F.coalesce(F.forall(keywords, lambda k: F.contains(text, k)), F.lit(True))


def votes(text: Column) -> dict[str, Column]:
    """Distinct keywords of each type in the text, without regard to ASCII case."""
    low = ascii_lower(text)
    return {kind: sum((F.contains(low, ascii_lower(F.lit(k))).cast("int") for k in words), F.lit(0)) for kind, words in KEYWORDS.items()}


def classified(text: Column) -> Column:
    """The type with most keywords, of equal ones the first as listed; ``unknown`` where there are none."""
    ranked = F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")) for i, (kind, n) in enumerate(votes(text).items()))))
    return F.when(ranked["n"] > 0, ranked["kind"]).otherwise(F.lit("unknown"))


def score(text: Column, template: Column) -> Column:
    """struct<score, complete, hospital_hits, title_hits> of a template against a text."""
    hits = [keyword_hits(text, template[f"{k}_keywords"]) for k in ("hospital", "title", "required", "optional")]
    total = sum((n * p for n, p in zip(hits, POINTS, strict=True)), F.lit(0))
    return F.struct(
        total.alias("score"), all_present(text, template["required_keywords"]).alias("complete"), hits[0].alias("hospital_hits"), hits[1].alias("title_hits")
    )


def matched(docs: DataFrame, templates: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``match`` (struct<score, template>, null where none fits) and ``templates_loaded``.

    A template fits if all its required keywords are there and it has points; the most points win, of equal ones
    the first loaded (``load_order``).  Templates are taken in arrays of ``CHUNK``, one broadcast after the other, and
    each row keeps its best so far: rows meet any number of templates where they are, need no key and are not
    shuffled.  A null text meets none.
    """
    held = F.struct(*(c for c in templates.columns if c != "load_order"))
    ranked = templates.select(F.row_number().over(Window.orderBy("load_order")).alias("n"), held.alias("template"))
    n = ranked.count()
    out = docs.withColumn("_text", text)
    for start in range(0, max(n, 1), CHUNK):
        some = ranked.where(F.col("n").between(start + 1, start + CHUNK))
        array = some.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "template"))), lambda x: x["template"]).alias("_templates"))
        tried = F.transform("_templates", lambda t, i: F.struct(score(F.col("_text"), t).alias("s"), (-i).alias("before")))
        fit = F.filter(tried, lambda x: x["s"]["complete"] & (x["s"]["score"] > 0))
        best = F.array_max(F.transform(fit, lambda x: F.struct(x["s"]["score"].alias("score"), x["before"].alias("before"))))
        out = out.crossJoin(F.broadcast(array)).withColumn("_best", best)
        better = F.col("_best").isNotNull() if start == 0 else F.col("_best.score") > F.coalesce("match.score", F.lit(0))
        found = F.when(better, F.struct(F.col("_best.score").alias("score"), F.get("_templates", -F.col("_best.before")).alias("template")))
        out = out.withColumn("match", found if start == 0 else found.otherwise(F.col("match"))).drop("_templates", "_best")
    return out.withColumn("templates_loaded", F.lit(n)).drop("_text")
