import corpus_pipeline


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert set(docs.columns) <= set(out.columns)
    got = {r.doc_id for r in out.select("doc_id").collect()}
    assert got <= {r.doc_id for r in docs.select("doc_id").collect()} and len(got) > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
