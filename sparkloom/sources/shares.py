"""Exact token shares of sources: the documents of each source that a hash orders first, up to its number of tokens.

The place where a source has to be cut is found by refined histograms: sums of tokens in 4,096 bins of the hash, then in
4,096 bins inside the one that crosses the target, and so on, five rounds at most over a narrow table. No source is sorted,
no task has more than the bins of a source, and the driver sees one row a source and round."""

from __future__ import annotations

from fractions import Fraction
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .checkpoint import drop_table, materialize

#: Bits of the order's hash, and those that a round decides.
BITS, ROUND_BITS = 60, 12


def hash_order(order: Column, seed: int) -> Column:
    """60 bits of MD5, the same in every engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(order.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def share_targets(totals: dict[str, int], weights: dict[str, float], budget: int | None = None) -> dict[str, int]:
    """Tokens of each source, in proportion to the weights: as many as the scarcest source allows, or the budget.

    Exact in fractions of the decimal weights. Sources without tokens or weight have no share and hold up no other."""
    parts = {s: Fraction(str(weights[s])) for s, n in totals.items() if n and weights.get(s, 0) > 0}
    if not parts:
        return {}
    scale = min(Fraction(totals[s]) / w for s, w in parts.items())
    if budget is not None:
        scale = min(scale, Fraction(budget) / sum(parts.values()))
    return {s: floor(scale * w) for s, w in parts.items()}


def _of_source(source: Column, values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for s, v in values.items() for x in (s, v)])[source]


def token_shares(docs: DataFrame, weights: dict[str, float], tokens_col: str, source_col: str = "source", order_col: str = "ord", seed: int = 0, budget: int | None = None) -> DataFrame:
    """Documents so chosen that each source has its share of tokens, less than one document short of it.

    ``weights`` are the configuration's, a number a source. Documents of one source are taken in the order of a hash of
    ``order_col`` for as long as they fit; those of equal order numbers go together. Null tokens count as none; sources
    without a weight, and the null source, go. Columns are those of ``docs``; an empty table has no documents."""
    known = [s for s, w in weights.items() if w > 0]
    key = hash_order(F.col(order_col), seed)
    if not known:
        return docs.limit(0)
    narrow = docs.where(F.col(source_col).isin(known)).select(F.col(source_col).alias("s"), key.alias("k"), F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("t"))
    narrow = materialize(narrow)
    totals = {r["s"]: r["n"] for r in narrow.groupBy("s").agg(F.sum("t").alias("n")).collect()}  # a row a weight
    targets = share_targets(totals, weights, budget)
    # Hashes below the bound are kept; a source that its target holds whole needs no search.
    bounds = {s: 1 << BITS for s in targets}
    open_ = {s: (0, n) for s, n in targets.items() if n < totals[s]}  # the hash's leading bits so far, tokens left for it
    for shift in range(BITS - ROUND_BITS, -1, -ROUND_BITS):
        if not open_:
            break
        source = F.col("s")
        inside = F.shiftright("k", shift + ROUND_BITS) == _of_source(source, {s: p for s, (p, _) in open_.items()})
        bins = narrow.where(inside).groupBy("s", F.shiftright("k", shift).alias("bin")).agg(F.sum("t").alias("t"), F.count("*").alias("n"))
        upto = bins.withColumn("upto", F.sum("t").over(Window.partitionBy("s").orderBy("bin")))
        crossed = upto.where(F.col("upto") > _of_source(source, {s: n for s, (_, n) in open_.items()}))
        first = crossed.groupBy("s").agg(F.min(F.struct("bin", (F.col("upto") - F.col("t")).alias("before"), "n")).alias("b"))
        for r in first.collect():  # a row a source
            s, (bin_, before, n) = r["s"], r["b"]
            bounds[s] = bin_ << shift
            if n > 1:
                open_[s] = (bin_, open_[s][1] - before)
            else:
                del open_[s]  # the one document of this bin is what no longer fits
    drop_table(narrow)
    return docs.where(key < F.coalesce(_of_source(F.col(source_col), bounds), F.lit(0))) if bounds else docs.limit(0)
