"""Greedy dedup of a stream against the batch operator, in several micro-batches with a restart between."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import dedup
from sparkloom.streaming import greedy
from test_dedup import sequential


@pytest.fixture
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def started(spark, folder, schema, n_bands, rows, threshold):
    signed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    settled = greedy.settle_stream(signed, f"{folder}/decisions", n_bands, rows, threshold)
    return greedy.write_decisions(settled, f"{folder}/decisions", f"{folder}/checkpoint")


def test_stream_settles_as_a_sequential_pass(few_partitions, tmp_path):
    spark, rng, signed = few_partitions, random.Random(6), {}
    for d in range(45):
        base = list(signed[rng.choice(list(signed))]) if signed and rng.random() < 0.75 else [rng.randrange(3) for _ in range(8)]
        signed[d] = [x if rng.random() < 0.85 else rng.randrange(3) for x in base]
    schema, rows = "id long, sig array<bigint>", list(signed.items())
    (tmp_path / "in").mkdir()
    for at in range(0, 45, 15):  # a query of its own for each micro-batch of documents
        spark.createDataFrame(rows[at : at + 15], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = started(spark, tmp_path, schema, 4, 2, 0.75)
        query.processAllAvailable()
        query.stop()
        assert greedy.decided(spark, f"{tmp_path}/decisions").count() == at + 15  # nothing is left open
    got = greedy.decided(spark, f"{tmp_path}/decisions", "d").collect()
    assert len(got) == len({r.d for r in got}) == 45
    want = sequential(signed, 4, 2, 0.75)
    assert {r.d for r in got if not r.kept} == want and 5 < len(want) < 40


def test_documents_with_a_stop_in_the_middle(few_partitions, tmp_path):
    """Real documents; the query is stopped wherever it is and started again."""
    spark = few_partitions
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(1000, None), (1001, ""), (1002, "")], "doc_id long, text string")).orderBy("doc_id")
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")

    def start():
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
        return greedy.start_greedy_dedup(stream, f"{tmp_path}/decisions", f"{tmp_path}/checkpoint", num_perm=16, threshold=0.8)

    query = start()
    while query.lastProgress is None and query.isActive:
        query.awaitTermination(1)
    query.stop()
    query = start()
    query.processAllAvailable()
    query.stop()
    n_bands, rows = dedup.optimal_bands(16, 0.8)
    batch = dedup.greedy_duplicates(dedup.signatures_blake2b(docs, 16, 5), n_bands, rows, 0.8)
    got = greedy.decided(spark, f"{tmp_path}/decisions")
    assert got.count() == docs.count()
    assert {r.doc_id for r in got.where(~F.col("kept")).collect()} == {r.doc_id for r in batch.collect()} >= {1001, 1002}
