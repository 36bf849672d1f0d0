"""What is shuffled or sampled: no texts or signatures where a key is enough."""

import re

from pyspark.sql import functions as F

from sparkloom.operators import dedup
from sparkloom.sources import readers, writers


def test_signatures_are_not_repeated_for_each_key(spark):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.array(*[(F.col("id") * i) % 7 for i in range(16)]).alias("sig"))
    plan = dedup.signature_links(df, 16, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    keyed = [x for x in plan.splitlines() if re.search(r"Project \[.*\bkey#", x)]
    assert not any(re.search(r"\b(sig|y)#", x) for x in keyed)


def test_ranges_of_a_source_are_not_cut_by_texts(spark, tmp_path):
    """The driver gets a sample of the columns that ranges are cut by."""
    rows = [(i // 3, "same beginning of a text " * 3 + str(i * 7919 % 1000)) for i in range(300)]
    spark.createDataFrame(rows, "k long, text string").repartition(7).write.parquet(f"{tmp_path}/a")
    got = readers.read_source(spark, readers.SourceSpec("a", f"{tmp_path}/a", order_key="k"))
    assert [r.text for r in got.orderBy("idx").collect()] == [t for _, t in sorted(rows)]
    cut = re.findall(r"rangepartitioning\(([^\n]*)", got._jdf.queryExecution().executedPlan().toString())
    assert cut and not any("text#" in x for x in cut)


def test_signatures_of_a_batch_are_made_in_parts(spark, monkeypatch):
    """A task holds the signatures of a few texts, not of a whole batch."""
    monkeypatch.setattr(dedup, "SIGNED_ROWS", 7)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence("id", F.col("id") + 9)).alias("text"))
    signed = dedup.signatures_blake2b(docs, 16, 3)
    whole = {r.doc_id: r.sig for r in signed.collect()}
    monkeypatch.setattr(dedup, "SIGNED_ROWS", 1000)
    assert len(whole) == 60 and whole == {r.doc_id: r.sig for r in dedup.signatures_blake2b(docs, 16, 3).collect()}


def test_packed_tables_need_no_pandas(spark, tmp_path):
    rows = spark.range(50).select(F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"), F.col("id").alias("pos"), F.sequence(F.lit(0), F.col("id").cast("int")).alias("ids"))
    rows = rows.withColumn("ids", F.when(F.col("pos") == 8, F.array().cast("array<int>")).otherwise(F.col("ids")))
    want = {(r.pos, *r.ids) for r in rows.where("split = 'train'").collect()}
    for dtype in ("uint16", "uint32"):
        writers.write_packed(rows, f"{tmp_path}/{dtype}", dtype)
        got = writers.read_packed(spark, f"{tmp_path}/{dtype}", "train", dtype)
        assert {(r.pos, *r.ids) for r in got.collect()} == want
        assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
