"""The pipeline's stages on odd rows: null ids and texts, empty texts, repeated rows, further columns, no rows at all."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(300)
    more = [(None, None, None, None, None), (None, "", "en", "s", 0), (5_000_000, None, "en", "s", None), (5_000_001, "", "en", "s", 0), (5_000_002, " \n", None, "s", 2), (5_000_003, "12 34 !!", "en", "s", 8)]
    texts = docs.where("lang = 'en'").limit(3).collect()
    more += [(None, texts[0].text, "en", "s", 1), (7_000_000, texts[1].text + " the end", "en", "s", 1), (7_000_000, texts[1].text + " the end", "en", "s", 1), (texts[2].doc_id, texts[2].text, "en", "other", 1)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema)).selectExpr("*", "'x' AS id", "1 AS label", "2L AS component_id")


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_a_stage_keeps_columns_and_treats_equal_rows_alike(spark, odd, stage):
    out = corpus_pipeline.materialize(stage(spark, odd, SF))
    assert out.columns == odd.columns
    rows, kept = [tuple(r) for r in odd.collect()], [tuple(r) for r in out.collect()]
    assert set(kept) <= set(rows)
    if stage is not corpus_pipeline.drop_near_duplicates:
        assert all(kept.count(r) in (0, rows.count(r)) for r in set(rows))
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_what_each_stage_does_with_odd_rows(spark, odd):
    spoken = [tuple(r) for r in corpus_pipeline.filter_language(spark, odd, SF).select("doc_id", "text").collect()]
    assert not any(t is None or not any(c.isalpha() for c in t) for _, t in spoken)
    assert any(i is None for i, _ in spoken)
    single = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, odd, SF).select("doc_id", "text").collect()]
    assert {(5_000_000, None), (5_000_001, ""), (5_000_002, " \n"), (None, None), (None, "")} <= set(single)
    assert len(single) == len(set(single)) and not any(i == 7_000_000 for i, _ in single)


def test_empty_corpus_goes_through(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
