"""Secrets in texts, with DataFrame functions only.

Three patterns propose base spans.  The fourth kind, ``markov``, comes from two character Markov models, one of
random strings and one of ordinary identifiers: a token is a secret where the mean log-likelihood ratio of its
character pairs is above a threshold.  Both models are trained here from labelled samples.  Nothing else decides,
but runs of fewer than 16 characters are not judged: below that, words without sense pass for random ones (of the
runs of letters only in 10,000 documents without such secrets, 17 of 16 or more characters, 195 of 14, 1,359 of 12).
Digits only are never above the threshold.

Null and empty texts have no spans; repeated rows and ids each keep their own row; other columns are ignored;
positions are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of these characters is one match, so asking for the least length in the pattern finds the same spans.
HEX = r"[0-9a-f]{16,}"
#: Runs that the models judge.
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Mean log-likelihood ratio a character pair from which a token counts as random.
THRESHOLD = 0.25

#: Matches whose positions are summed together.
TOGETHER = 128

#: Symbols of the models: digits, both cases of letters, and one for the other characters.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDE = len(SYMBOLS) + 1

#: Words of which ordinary identifiers are made.
WORDS = (
    "account action active address array async attribute base batch block buffer build button cache call change channel "
    "class client close cluster code color column command commit common component config connect container content "
    "context control copy count create current data date default delete depth device document domain driver element "
    "enable engine entry error event exception execute export factory field file filter first flag format frame "
    "function global group handler header height host image import index init input instance internal item iterator "
    "kernel label language last layout length level limit line link list load local lock logger manager master match "
    "memory message method mode model module name network node number object offset open option order output package "
    "page parameter parent parse partition path pattern payload pending port position prefix process property protocol "
    "provider proxy query queue random range read record region register release remote render replace report request "
    "reset resource response result return root route row sample scale schedule schema scope screen script search "
    "section select sequence server service session shared signal size socket source stack start state status storage "
    "stream string style submit suffix summary support switch symbol sync system table target task template test text "
    "thread time timeout title trace transaction transform transport type update upload user utility validate value "
    "variable vector version view visible volume watch width window worker wrapper write"
).split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """token, label: ``n`` random strings (1) and ``n`` ordinary identifiers (0), the same on every call."""
    row = spark.range(n)
    salt = lambda k: F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 256)
    random = F.when(F.col("id") % 4 == 0, salt("h")).otherwise(F.translate(F.base64(F.unhex(salt("b"))), "=", ""))
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(WORDS))) + 1).cast("int"))
    digits = F.when(F.col("id") % 5 == 0, F.pmod(F.xxhash64(F.lit("d"), "id"), F.lit(2030)).cast("string")).otherwise(F.lit(""))
    parts = [word(k) for k in "pqrs"]
    plain = (
        F.when(F.col("id") % 3 == 0, F.concat_ws("_", *parts, digits))
        .when(F.col("id") % 3 == 1, F.concat(parts[0], *(F.initcap(p) for p in parts[1:]), digits))
        .otherwise(F.concat_ws("-", *parts, digits))
    )
    return row.select(random.alias("token"), F.lit(1).alias("label")).unionByName(row.select(plain.alias("token"), F.lit(0).alias("label")))


def _symbol(c: Column) -> Column:
    """0-based number of a character; every other character is the last one."""
    at = F.instr(F.lit(SYMBOLS), c)
    return F.when(at > 0, at - 1).otherwise(F.lit(WIDE - 1))


def _pairs(token: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(token) - 1),
        lambda i: _symbol(token.substr(i, F.lit(1))) * WIDE + _symbol(token.substr(i + 1, F.lit(1))),
    )


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each of the ``WIDE`` x ``WIDE`` pairs, random against ordinary, add-half smoothed.

    Labels other than 0 and 1 and tokens that are null or shorter than two characters teach nothing.
    """
    usable = labelled.where("label in (0, 1) and length(token) > 1")
    seen = usable.select("label", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("label", "pair").count().collect()  # at most 2 x WIDE^2 rows
    counts = [[0.5] * (WIDE * WIDE) for _ in range(2)]
    for label, pair, n in seen:
        counts[label][pair] += n
    firsts = [[sum(c[a * WIDE : (a + 1) * WIDE]) for a in range(WIDE)] for c in counts]
    return [round(math.log(counts[1][i] / firsts[1][i // WIDE]) - math.log(counts[0][i] / firsts[0][i // WIDE]), 4) for i in range(WIDE * WIDE)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the pairs of ``token``; null for tokens shorter than two characters."""
    table = F.from_json(F.lit(str(model)), "array<double>")
    total = F.aggregate(_pairs(token), F.lit(0.0), lambda acc, i: acc + F.get(table, i))
    return F.when(F.length(token) > 1, total / (F.length(token) - 1))


def _found(text: Column, pattern: str, order: int, keep) -> Column:
    """array<struct<start, ord, end, what>> of the kept matches of ``pattern``, by position.

    What lies between the matches comes from ``split``, so the lengths of both, summed, give the positions: first within
    blocks of ``TOGETHER`` matches, then for the blocks, so that the work follows the number of matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    none = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,what:string>>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        one = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), x["hit"].alias("what"))
        return F.struct(end.alias("at"), F.when(keep(x["hit"]), F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def after(acc, block):
        moved = F.transform(block["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), x["ord"].alias("ord"), (x["end"] + acc["at"]).alias("end"), x["what"].alias("what")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    first = F.sequence(F.lit(1), F.size(both), F.lit(TOGETHER))
    blocks = F.transform(first, lambda i: F.aggregate(F.slice(both, i, TOGETHER), start, step))
    whole = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<array<struct<start:bigint,ord:int,end:bigint,what:string>>>)").alias("out"))
    return F.when(F.size(hits) > 0, F.flatten(F.aggregate(blocks, whole, after, lambda acc: acc["out"]))).otherwise(none)


def _digest(found: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["ord"])
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov: one row for each row of ``docs``."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,what:string>>)")
    random = lambda m: ratio(m, model) > THRESHOLD
    found = rows.select(
        "doc_id",
        _found(text, ASSIGN, 1, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), _found(text, ACCESS, 2, lambda m: F.length(m) >= 18)).otherwise(none).alias("access"),
        _found(text, HEX, 3, lambda m: F.lit(True)).alias("hex"),
        _found(text, TOKEN, 4, random).alias("markov"),
    )
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_digest(base), 256).alias("base_sha256"),
        _digest(F.concat(base, F.col("markov"))).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )
