"""Tables in the folder that driver and executors share: where iterative operators cut their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back; such a table outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of ours, by Hadoop's file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``materialize`` once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        delete_path(df.sparkSession, file.rsplit("/", 1)[0])
