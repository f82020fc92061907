import corpus_pipeline
from tests.llm.fixtures import prose


def test_stages_take_effect(spark, tmp_path):
    docs = [(i, prose(i, 60), "en", "s", 0) for i in range(60)]
    docs += [(60 + i, prose(200 + i, 60) + " gromble snerkish", "en", "s", 0) for i in range(20)]
    docs += [(90, prose(3, 60), "en", "s", 0), (91, "1234 !!", "en", "s", 0), (92, None, "en", "s", 0), (93, prose(300, 60) + " password=hunter2hunter2", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 80)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == kept.columns
        kept = spark.createDataFrame(out.collect(), out.schema)
        ids[name] = {r["doc_id"] for r in kept.collect()}
    assert not ids["language ID"] & {91, 92} and set(range(60)) <= ids["language ID"]
    assert not ids["toxicity"] & set(range(60, 80)) and set(range(60)) <= ids["toxicity"]
    assert 90 not in ids["near-duplicates"] and {3, 93} <= ids["near-duplicates"]
    last = {r["doc_id"]: r for r in kept.collect()}[93]
    assert last["text"].endswith(" [SECRET]") and last["n_chars"] == len(last["text"])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == ids["secret scan"]
