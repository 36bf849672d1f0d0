"""Unit tests of generated code, each group in a process of its own.

This runs untrusted code: a process with a time limit and no environment is weak isolation. It is therefore off unless
``allow_untrusted`` is set, and belongs on throw-away workers."""

from __future__ import annotations

import subprocess
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rewards import extract_code

TIMEOUT_S = 5.0


def run_group(code: str, tests: str, timeout: float = TIMEOUT_S) -> bool:
    """Whether code followed by tests ends with status 0 in time."""
    try:
        done = subprocess.run([sys.executable, "-I", "-c", f"{code}\n\n{tests}\n"], capture_output=True, timeout=timeout, env={})
    except subprocess.TimeoutExpired:
        return False
    return done.returncode == 0


def code_rewards(rows: DataFrame, id_col: str = "id", allow_untrusted: bool = False, timeout: float = TIMEOUT_S) -> DataFrame:
    """``id, pass_rate``: the share of test groups that pass; 0 without any. ``rows`` has completion and tests (array)."""
    if not allow_untrusted:
        raise PermissionError("code_rewards runs generated code; set allow_untrusted=True where that is safe")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["passed"] = [int(run_group(c or "", x or "", timeout)) for c, x in zip(pdf["code"], pdf["test"], strict=True)]
            yield pdf[[id_col, "passed"]]

    groups = rows.select(id_col, extract_code(F.col("completion")).alias("code"), F.explode("tests").alias("test"))
    kind = rows.schema[id_col].dataType.simpleString()
    rates = groups.mapInPandas(run, f"{id_col} {kind}, passed int").groupBy(id_col).agg(F.avg("passed").alias("pass_rate"))
    return rows.select(id_col).join(rates, id_col, "left").select(id_col, F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"))
