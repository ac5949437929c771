import corpus_pipeline
from conftest import SF_DIR

from ridelake.llm.queries import QUERIES


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns, name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if out.columns == columns:
            assert 0.5 * before < docs.count() <= before
            kept = docs.select("doc_id").distinct()
            before = docs.count()
    assert corpus_pipeline.run(spark, SF_DIR).agg({"length": "sum"}).first() == docs.agg({"length": "sum"}).first()
    assert docs.select("doc_id").distinct().count() == kept.count()


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_line_query_rows(spark):
    assert QUERIES["op6_line_chunks"](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
