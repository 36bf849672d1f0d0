"""Training logs as tables: the numbers of each kind of line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
PATTERNS = {
    "loss": (rf"step\s+(\d+).*?\bloss\s+{NUMBER}", ("step", "loss")),
    "val": (rf"step\s+(\d+).*?\bval[_ ]loss\s+{NUMBER}", ("step", "val_loss")),
    "reward": (rf"step\s+(\d+).*?\breward\s+{NUMBER}.*?\bacc\s+{NUMBER}", ("step", "reward", "accuracy")),
}


def parse_log(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    pattern, names = PATTERNS[kind]
    found = lines.where(F.col(column).rlike(pattern))
    return found.select(*[F.regexp_extract(column, pattern, i + 1).try_cast("long" if n == "step" else "double").alias(n) for i, n in enumerate(names)])


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return parse_log(spark.read.text(path), kind)
