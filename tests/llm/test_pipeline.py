import corpus_pipeline
from docfields.llm import entry, jaccard, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == start.columns and 0 < docs.count()
        if i == 1:
            want = {r["component_id"] for r in jaccard.join(before).collect()}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
        if i == 2:
            assert pii.find(docs).agg({"n_email": "sum", "n_ip": "sum", "n_phone": "sum"}).first()[0] == 0
    assert docs.select("doc_id").distinct().count() <= start.count() and docs.where("not round_trip").count() == 0


def test_names():
    assert len(corpus_pipeline.STAGES) == 5
    assert [n.split("_")[0] for n in entry.queries()] == [f"op{i}" for i in range(1, 11)]
