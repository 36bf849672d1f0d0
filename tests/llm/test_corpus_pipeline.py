"""The near-duplicate stage of the pipeline against brute force."""

from test_pairs import brute_join, near_copies

import corpus_pipeline


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    rows = near_copies(120, 11)
    kept, fewer = ({c for _, _, c in brute_join(rows, k, percent)} for k, percent in ((5, 80), (3, 90)))
    assert kept != fewer
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(tuple(r) for r in got.collect()) == [r for r in rows if r[0] in kept]


def test_near_duplicates_without_ids_and_of_one_id(spark):
    text, other, third = (" ".join(map(str, range(a, a + 50))) for a in (0, 100, 200))
    rows = [(3, text), (3, text), (None, text), (5, text), (5, other), (9, other), (None, third), (None, third), (None, third + " 7"), (7, "")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id) == [(3, text), (5, other), (7, "")]
    assert [r.text in (third, third + " 7") for r in got if r.doc_id is None] == [True]
