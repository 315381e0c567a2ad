"""The pipeline against its stages' operators, and what each stage must keep."""

import corpus_pipeline
from galleyproof.llm import packing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns
        assert after.join(docs, "doc_id", "left_anti").count() == 0 and after.count() > 0.7 * docs.count()
        docs = after
    packed = {(r["doc_id"], r["start"], r["length"]) for r in packing.pack(docs).select("doc_id", "start", "length").collect()}
    whole = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == {d for d, _, _ in packed}
