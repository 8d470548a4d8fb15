"""The pipeline's stages on odd rows and on empty tables."""

import corpus_pipeline
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, ids string, component_id string"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables(spark, tmp_path, empty):
    long = "x y " * 20_000
    rows = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "a b c d e f", "en", None), (None, None, None, None), (5, long, "en", "t"), (6, long, "en", "t"), (7, "İΣς é 中文 \x00\x1f  z", "de", "s"), (7, "other", "de", "s")]
    docs = spark.createDataFrame([] if empty else [(*r, 3, True, "size", "ids", "component") for r in rows], DOC)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [] if empty else [(1, 1, 0), (5, 1, 0), (3, None, 1), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    here = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, here, str(tmp_path))
        assert out.columns == here.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        here = spark.read.parquet(f"{tmp_path}/{name}")
        assert empty or here.where("size = 'size' and component_id = 'component'").count() == here.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, here, str(tmp_path))
    assert last.count() == here.count() and (last.count() == 0) == empty
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == last.count()
