"""One flat token stream: end tokens, splits, stream offsets by two-level prefix sums, blocks, manifest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents (by order number) whose lengths one task sums up.
ORDER_BLOCK = 65_536


def with_end_token(encoded: DataFrame, end_id: int, vocab_size: int, ids_col: str = "ids") -> DataFrame:
    """Empty documents go; an id beyond the vocabulary is an error; the end token is appended."""
    ids = F.col(ids_col)
    checked = F.when(F.array_max(ids) < vocab_size, ids).otherwise(F.raise_error(F.lit("token id beyond the vocabulary")).cast("array<int>"))
    return encoded.where(F.size(ids) > 0).withColumn(ids_col, F.concat(checked, F.array(F.lit(end_id))))


def token_dtype(vocab_size: int) -> str:
    return "uint16" if vocab_size <= 1 << 16 else "uint32"


def split_of(order: Column, val_fraction: float, seed: int = 0) -> Column:
    """Train or val by a hash of the order number (32 bits of MD5, the same in every engine), so a document's split doesn't
    depend on the others."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), order.cast("string"))), 1, 8), 16, 10).cast("long") % F.lit(1_000_000)
    return F.when(drawn < int(val_fraction * 1_000_000), "val").otherwise("train")


def sequential_split(rows: DataFrame, order_col: str, val_fraction: float, seed: int = 0) -> DataFrame:
    """Adds ``split`` as a sequential pass draws it: the k-th document in order gets the k-th number of a generator.

    Documents are numbered in two levels, and each block of ORDER_BLOCK numbers moves the generator on to its first."""
    numbered = stream_offsets(rows.withColumn("_one", F.lit(1).cast("long")), order_col, "_one").drop("_one").withColumnRenamed("pos", "_k")

    @F.pandas_udf("string")
    def draw(places: pd.Series) -> pd.Series:
        out = np.empty(len(places), dtype=object)
        for block in np.unique(places // ORDER_BLOCK):
            bits = np.random.PCG64(seed)
            bits.advance(int(block) * ORDER_BLOCK)  # a double takes one step
            drawn = np.random.Generator(bits).random(ORDER_BLOCK)
            at = (places // ORDER_BLOCK == block).to_numpy()
            out[at] = np.where(drawn[places[at] % ORDER_BLOCK] < val_fraction, "val", "train")
        return pd.Series(out)

    return numbered.withColumn("split", draw("_k")).drop("_k")


def stream_offsets(rows: DataFrame, order_col: str, length_col: str, split_col: str | None = None) -> DataFrame:
    """Adds ``pos``, the tokens of the split before each document.

    Sums inside blocks of order numbers, then over the block totals: no task sees more than a block of documents or one
    row for each block."""
    keys = [split_col] if split_col else []
    blocked = rows.withColumn("_block", F.floor(F.col(order_col) / ORDER_BLOCK))
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(length_col).alias("_total"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(starts, [*keys, "_block"]).withColumn("pos", F.col("_start") + F.coalesce(F.sum(length_col).over(inside), F.lit(0))).drop("_block", "_start")


def blocks(rows: DataFrame, block: int, ids_col: str = "ids") -> DataFrame:
    """``block, x, y`` of ``pos, ids``: x are the block's tokens, y the ones after each; only full blocks.

    Documents are sliced to the blocks they lie in, so what is shuffled are slices, not tokens. The first token of a
    block is sent to the previous one as well, which needs it as its last label."""
    first = F.floor(F.col("pos") / block)
    last = F.floor((F.col("pos") + F.size(ids_col) - 1) / block)
    parts = rows.where(F.size(ids_col) > 0).select("pos", ids_col, F.explode(F.sequence(F.greatest(first - F.when(F.col("pos") % block == 0, 1).otherwise(0), F.lit(0)), last)).alias("block"))
    begin = F.greatest(F.col("block") * block, F.col("pos"))
    end = F.least((F.col("block") + 1) * block + 1, F.col("pos") + F.size(ids_col))
    sliced = parts.where(begin < end).select("block", begin.alias("at"), F.slice(ids_col, (begin - F.col("pos") + 1).cast("int"), (end - begin).cast("int")).alias("s"))
    whole = sliced.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("p"))
    tokens = whole.select("block", F.flatten(F.col("p.s")).alias("t")).where(F.size("t") == block + 1)
    return tokens.select("block", F.slice("t", 1, block).alias("x"), F.slice("t", 2, block).alias("y"))


def crops(rows: DataFrame, starts: DataFrame, block: int, ids_col: str = "ids") -> DataFrame:
    """``start, x, y`` of ``block`` tokens from each start of ``pos, ids`` on; y are the tokens after each of x. Starts
    without as many tokens behind them give nothing. A crop meets the documents of the blocks that it touches."""
    last = F.col("pos") + F.size(ids_col) - 1
    parts = rows.where(F.size(ids_col) > 0).select("pos", ids_col, F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor(last / block))).alias("_b"))
    first = F.floor(F.col("start") / block)
    wanted = starts.select("start", F.explode(F.sequence(first, F.floor((F.col("start") + block) / block))).alias("_b"))
    begin = F.greatest(F.col("start"), F.col("pos"), F.col("_b") * block)
    end = F.least(F.col("start") + block + 1, F.col("pos") + F.size(ids_col), (F.col("_b") + 1) * block)
    met = wanted.join(parts, "_b").where(begin < end).select("start", begin.alias("at"), F.slice(ids_col, (begin - F.col("pos") + 1).cast("int"), (end - begin).cast("int")).alias("s"))
    whole = met.groupBy("start").agg(F.flatten(F.sort_array(F.collect_list(F.struct("at", "s"))).getField("s")).alias("t")).where(F.size("t") == block + 1)
    return whole.select("start", F.slice("t", 1, block).alias("x"), F.slice("t", 2, block).alias("y"))


def token_totals(rows: DataFrame, split_col: str = "split", length_col: str = "n_tokens") -> DataFrame:
    return rows.groupBy(split_col).agg(F.count("*").alias("n_docs"), F.sum(length_col).alias("tokens"))


def shards(rows: DataFrame, shard_tokens: int) -> DataFrame:
    """Adds the shard that a document's first token falls in."""
    return rows.withColumn("shard", F.floor(F.col("pos") / shard_tokens))


def manifest(rows: DataFrame, vocab_size: int, end_id: int) -> DataFrame:
    """One row that describes the packed splits."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n_tokens"))), F.lit(0)).alias(f"{s}_tokens")
    totals = rows.agg(F.count("*").alias("n_docs"), of("train"), of("val"))
    files = F.create_map(F.lit("train"), F.lit("train"), F.lit("val"), F.lit("val"))
    return totals.select(F.lit(token_dtype(vocab_size)).alias("dtype"), F.lit(end_id).alias("eot_id"), F.lit(vocab_size).alias("vocab_size"), "n_docs", "train_tokens", "val_tokens", files.alias("files"))
