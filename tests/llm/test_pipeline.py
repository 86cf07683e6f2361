"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from verdance.llm.ngram_join import near_duplicate_classes


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(out.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            docs = out
        if name == "near_duplicates":
            assert near_duplicate_classes(out).where("doc_id <> component_id").count() == 0
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] == counts[5] > 0
    ids = corpus_pipeline.run(spark, sf_dir)
    assert ids.count() == counts[-1] and ids.where("NOT round_trip OR NOT parity").count() == 0
