"""Columns of any name and type pass through what returns the columns of its input; no cluster writes to a machine's own folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfields.llm import base, jaccard, mixing, pii, quality

NAMES = "_h1 _h2 _k1 _k2 _one _nth k1 k2 h1 h2 row one key _key _now now _size size _part part _whole whole take copies left ends at x bag label".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s) for i, (t, s) in enumerate([("a b c d e f", "s"), ("a b c d e f", "s"), (None, None), ("", "t"), ("mail me at x@y.org now please", "t"), ("q w e r t y", None)])]
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("n_chars", F.length("text").cast("short"))
    return frame.withColumns({n: F.concat(F.lit(n + "-"), F.col("doc_id").cast("string")) for n in NAMES} | {"a.b": F.col("doc_id") * 2}).repartition(2)


def whole(frame):
    return [r.asDict() for r in frame.collect()]


def test_clashing_names_and_types(docs):
    for stage in (jaccard.one_each, pii.mask, mixing.mixed):
        out = stage(docs)
        assert out.dtypes == docs.dtypes, stage
        rows = whole(out)
        assert rows and all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in NAMES) and all(r["a.b"] == 2 * r["doc_id"] for r in rows)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
        assert stage(docs.where("false")).count() == 0
    assert sorted(r["doc_id"] for r in whole(jaccard.one_each(docs))) == [0, 2, 3, 4, 5]
    assert [r["text"] for r in whole(pii.mask(docs)) if r["doc_id"] == 4] == ["mail me at [EMAIL] now please"]


def test_repeated_rows_teach_once(spark):
    rng = np.random.default_rng(1)
    word = lambda good: "".join(rng.choice(list("etaoin" if good else "#$%&*!"), 8))
    rows = [(i, " ".join(word(i % 2) for _ in range(60))) for i in range(40)] + [(2, "#$%& &%$# !!**")] * 9000
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.constant is None
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs.where("doc_id <> 2"), model).collect()}
    assert min(scores[i] for i in range(1, 40, 2)) > max(scores[i] for i in range(0, 40, 2) if i != 2)


def test_every_passage_teaches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags: seen.extend(bags) or quality.Model({}, 0.5))
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, "x " * 300_000), (3, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    quality.train(docs, labels)
    assert sorted((y, len(b)) for y, b in seen) == [(0, 1500), (1, 1), (1, 250)]
    monkeypatch.setattr(quality, "BYTES", 200_000)
    seen.clear()
    quality.train(docs, labels)
    assert sorted((y, len(b)) for y, b in seen) == [(1, 1), (1, 250)]


def test_checkpoint_folder_must_be_shared():
    class Nothing:
        def isDefined(self):
            return False

    class Fake:
        master = "spark://somewhere:7077"

        def __getattr__(self, name):
            return self

        def __call__(self, *a):
            return self if len(a) < 2 else ""

        def getCheckpointDir(self):
            return Nothing()

        def get(self, *a):
            return ""

    fake = Fake()
    fake.sparkContext = fake.conf = fake
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        base.checkpoint_dir(fake)
