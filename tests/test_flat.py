"""Flat token files: the same bytes as the export, written by tasks in any order; failures leave nothing."""

import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import packing
from sparkloom.sources import flat, writers


@pytest.fixture
def rows(spark):
    spark.dataSource.register(flat.FlatTokens)
    docs = spark.createDataFrame([(i, [(i * 37 + k) % 60_000 for k in range(i % 9 + (400 if i == 50 else 0))]) for i in range(300)], "ord long, ids array<int>")
    return packing.stream_offsets(docs.where("size(ids) > 0").withColumn("n", F.size("ids").cast("long")), "ord", "n")


def save(rows, folder, dtype="uint16", split="train"):
    rows.select("pos", "ids").write.format("flat_tokens").option("split", split).option("dtype", dtype).mode("append").save(str(folder))


@pytest.mark.parametrize("dtype", ["uint16", "uint32"])
def test_bytes_equal_the_export(spark, rows, tmp_path, dtype):
    writers.write_packed(rows.withColumn("split", F.lit("train")), f"{tmp_path}/packed", dtype)
    want = io.BytesIO()
    n = writers.export_binary(spark, f"{tmp_path}/packed", "train", want)
    save(rows.repartition(7, F.xxhash64("ord")), tmp_path / "flat", dtype)  # in no order at all
    got = (tmp_path / "flat" / "train.bin").read_bytes()
    assert got == want.getvalue() and len(got) == n
    manifest = json.loads((tmp_path / "flat" / "train.json").read_text())
    assert manifest == {"dtype": dtype, "file": "train.bin", "tokens": n // np.dtype(dtype).itemsize, "n_docs": rows.count()}
    back = spark.read.format("flat_tokens").option("partitionTokens", "100").load(f"{tmp_path}/flat")
    assert back.rdd.getNumPartitions() == -(-manifest["tokens"] // 100)
    read = [x for r in sorted(back.collect()) for x in r.ids]
    assert read == np.frombuffer(got, dtype=dtype).tolist()


def test_a_failed_task_leaves_no_file(spark, rows, tmp_path):
    save(rows, tmp_path / "flat")
    before = {p.name: p.read_bytes() for p in (tmp_path / "flat").iterdir()}
    broken = rows.repartition(5).withColumn("ids", F.when(F.col("ord") == 77, F.array(F.lit(70_000))).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="no uint16"):
        save(broken, tmp_path / "flat")
    with pytest.raises(Exception, match="gaps or overlap"):
        save(rows.where("ord <> 77"), tmp_path / "flat")
    with pytest.raises(Exception, match="without"):
        save(rows.withColumn("ids", F.when(F.col("ord") != 77, F.col("ids"))), tmp_path / "flat")
    assert {p.name: p.read_bytes() for p in (tmp_path / "flat").iterdir()} == before


def test_empty_splits_and_wrong_settings(spark, rows, tmp_path):
    save(rows.limit(0), tmp_path / "flat", split="val")
    assert os.path.getsize(tmp_path / "flat" / "val.bin") == 0
    assert spark.read.format("flat_tokens").option("split", "val").load(f"{tmp_path}/flat").isEmpty()
    for bad in ({"dtype": "int8"}, {"folder": "s3://bucket/x"}):
        with pytest.raises(Exception, match="unknown token type|any place"):
            save(rows, bad.get("folder", tmp_path / "x"), bad.get("dtype", "uint16"))
