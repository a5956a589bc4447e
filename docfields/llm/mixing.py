"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  The keys are cut into ranges of about equal rows within each source,
each range is sorted, and running token counts come from a window in each range plus the sum of the ranges
before it; no task sees more than one range.  A source is cut at exactly its budget: whole epochs first, then
the documents whose running count is below what is left, the last one in part.

Null texts count no words; null sources are one source, last in order; a source without words has target 0;
repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.base import cut, packed, unpacked

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Rows of a source that one key range should hold.
RANGE_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space: white space is folded to single blanks, and blanks are counted."""
    folded = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    inner = F.btrim(folded, F.lit(" "))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.length(inner) - F.length(F.translate(inner, " ", "")) + 1
    ).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n, target from one row per source.

    The level at which the water stands is found by repeated sums: a source over its limit is set to the limit
    and the rest share what is left, as often as that puts another source over.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", (F.col("source_size") * MOST).cast("double"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(SHARE)
    # Sources in the order in which rising water fills them; `before` is held by those filled earlier.
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    )
    rows = rows.withColumn("total", total).withColumn("weights", F.sum("weight").over(Window.partitionBy()))
    rows = rows.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("limit"))
    # The first source that is not filled sets the level for itself and all after it.
    reached = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(
        Window.partitionBy()
    )["level"]
    rows = rows.withColumn("reached", reached)
    target = F.when(F.col("reached").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("reached") * F.col("weight")))
    return rows.select("source", "source_size", "n", target.alias("target"))


def _key(seed: str, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")))


def _cut(docs: DataFrame, seed: str) -> DataFrame:
    """One row for each row of ``docs``: its numbers, its source's, and `before`, the words of the source that come before it."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), _key(seed, F.col("doc_id")).alias("key")
    )
    rows = cut(rows)  # the texts are read once; what is left is a few numbers a document
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(sizes).withColumn("ranges", F.ceil(F.col("n") / RANGE_ROWS)).withColumnRenamed("source", "of")
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["of"])).drop("of")
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rows = rows.withColumn("range", F.floor(share * F.col("ranges")))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    rows = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("source", "range").agg(F.sum("size").alias("part"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("source").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("part").over(along), F.lit(0)).alias("base")
    )
    rows = rows.join(parts, rows["source"].eqNullSafe(parts["of"]) & (rows["range"] == parts["at"]))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("before", F.col("base") + F.col("upto") - F.col("size")).withColumn("whole", whole)
    return rows.withColumn("rest", budget - whole * F.col("source_size"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs``."""
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return _cut(docs, seed).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each epoch in which a document is taken.

    The document at which a source's budget ends is cut to the words that are left, joined by blanks; rows of one id
    and size at that place share them evenly.  Only one row a source, the place of its cut, meets the texts.
    """
    rows = _cut(docs, seed)
    same = Window.partitionBy("source", "range", "key", "doc_id", "size")
    ties = rows.withColumn("first", F.min("before").over(same)).withColumn("ties", F.count(F.lit(1)).over(same))
    ends = ties.where("rest > 0 and before < rest and before + size >= rest").groupBy("source").agg(
        *(F.first(c).alias(c) for c in ("key", "doc_id", "size", "whole")),
        F.first(F.least("size", F.floor((F.col("rest") - F.col("first")) / F.col("ties")))).alias("part"),
    )
    none = rows.where("rest <= 0").groupBy("source").agg(F.first("whole").alias("whole"))
    ends = ends.unionByName(none, allowMissingColumns=True)
    row = F.col("row")
    doc_id, text = row["doc_id"].cast("long"), row["text"].cast("string")
    at, end = F.struct(F.col("now").alias("key"), doc_id.alias("doc_id")), F.struct("key", "doc_id")
    less = F.when(F.col("key").isNull(), F.lit(False)).when(at < end, F.lit(True)).when(at == end, words(text) < F.col("size")).otherwise(F.lit(False))
    equal = F.when((F.col("now") == F.col("key")) & doc_id.eqNullSafe(F.col("doc_id")), words(text) == F.col("size")).otherwise(F.lit(False))
    joined = packed(docs).withColumn("now", _key(seed, row["doc_id"])).join(ends, row["source"].cast("string").eqNullSafe(F.col("source")))
    joined = joined.withColumn("copies", F.col("whole") + less.cast("long")).withColumn("left", F.when(equal, F.col("part")).otherwise(F.lit(0)).cast("int"))
    full = F.when(F.col("copies") > 0, F.array_repeat(F.lit(0), F.col("copies").cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    takes = F.concat(full, F.when(F.col("left") > 0, F.array("left")).otherwise(F.expr("cast(array() as array<int>)")))
    out = joined.withColumn("take", F.explode(takes))
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("take")), " ")
    changed = {"text": F.when(F.col("take") > 0, head).otherwise(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("take") > 0, F.length(head).cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return unpacked(out, docs, **changed)


SQL = rf"""
with d as (select doc_id, source, md5('mix:' || cast(doc_id as varchar)) as key,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, cast([{', '.join(map(str, WEIGHTS))}][(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1] as double) as weight,
    cast({MOST} * source_size as double) as lim, {SHARE} * sum(source_size) over () as total from s),
f as (select *, (total - coalesce(sum(lim) over e, 0)) / (sum(weight) over () - coalesce(sum(weight) over e, 0)) as level from w
    window e as (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select first(level order by lim / weight, source nulls last) as reached from f where level * weight < lim),
t as (select source, source_size, coalesce(least(lim, reached * weight), lim) as target from f left join l on true),
o as (select d.doc_id, d.size, t.source_size, t.target, cast(round(t.target) as bigint) as budget,
    sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as before
    from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(case when source_size > 0 then budget // source_size * size
    + greatest(0, least(size, budget - budget // source_size * source_size - before)) else 0 end as bigint) as taken from o
"""
