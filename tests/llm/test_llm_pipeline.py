"""The pipeline's stages keep what they should and take effect."""

import corpus_pipeline
from lexforge.llm import toxicity


def test_stages_and_run(spark, tmp_path):
    d = str(tmp_path)
    clean = [f"doc number {i} " + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(50, clean[3], "en", "s", 1), (51, "reach me at someone@example.com " + " ".join(f"q{j}" for j in range(40)), "en", "s", 1), (52, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {*range(12), 51, 52}
    assert "[EMAIL]" in left[51].text and left[51].n_chars == len(left[51].text) and left[52].text is None
    packed = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in packed.collect()} == set(left)
    assert toxicity.keep_clean(spark, spark.read.parquet(f"{d}/documents.parquet"), d).count() == 15
