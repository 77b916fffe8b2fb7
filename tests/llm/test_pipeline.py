"""The pipeline's stages against brute force on the smallest tables."""

import corpus_pipeline
from greenspark.llm import quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_act_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    kept = {r["doc_id"] for r in quality_rules.quality_digest(docs).where("kept").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= before
        if k == 0:
            assert now == kept
        if k in (3, 4):
            assert now == before
        if k < 4:
            assert docs.columns == columns
        if k == 3:
            assert docs.where("text rlike '[a-z0-9]@[a-z0-9]+[.]'").count() == 0
        before = now
    assert docs.where("not round_trip").count() == 0


def test_run_gives_the_rows_of_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_copies_by_five_words_go(spark):
    words = [f"w{k}" for k in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:25], "changed", *words[26:]])), (3, " ".join(words[::-1]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_per_group(spark, docs, SF).collect()) == [1, 3]
