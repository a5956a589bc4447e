import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Frame of documents from texts or (id, text[, source]) rows, with columns whose names clash with those of results."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            doc, text, source = (*r, None)[:3] if isinstance(r, tuple) and len(r) < 3 else r if isinstance(r, tuple) else (i, r, "s")
            full.append((doc, text, "en", source, None if text is None else len(text)))
        frame = spark.createDataFrame(full, WIDE)
        return frame.selectExpr("*", "'x' as spans", "'x' as key", "'x' as tid", "'x' as sid", "'x' as n", "'x' as score", "'x' as blob", "'x' as taken", "'x' as kept_id").repartition(3)

    return make
