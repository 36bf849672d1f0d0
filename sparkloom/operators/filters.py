"""Quality rules: a ladder in which the first failing rule names the reason; a value at a threshold passes."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as t


@dataclass(frozen=True)
class FilterConfig:
    # The thresholds that published results were made with.
    min_chars: int = 200
    max_chars: int = 100_000
    min_mean_word_len: float = 3.0
    max_mean_word_len: float = 10.0
    max_symbol_to_word_ratio: float = 0.10
    min_alpha_fraction: float = 0.60
    max_dup_line_fraction: float = 0.30
    code_max_mean_line_len: float = 200.0
    code_min_alnum_fraction: float = 0.40

    @classmethod
    def from_dict(cls, values: dict | None) -> "FilterConfig":
        """Thresholds by name, as numbers. A key that is none of them changes nothing and is warned of."""
        given = dict(values or {})
        config = {f.name: type(f.default)(given.pop(f.name)) for f in fields(cls) if given.get(f.name) is not None}
        if given:
            warnings.warn(f"unknown filter settings: {', '.join(sorted(map(str, given)))}", stacklevel=2)
        return cls(**config)


def _features(is_code: Column) -> dict[str, Column]:
    """What the rules compare, each computed once and only for the kind that needs it."""
    x = F.col("text")
    prose = lambda c: F.when(~is_code, c)
    return {
        "_chars": F.length(x),
        "_sizes": prose(t.let(t.normalise_space(x), lambda n: F.struct(t.count_words(n).alias("words"), t.inked(n).alias("inked")))),
        "_symbols": prose(t.symbol_count(x)),
        "_alpha": prose(t.alpha_fraction(x)),
        "_dup": prose(t.duplicate_line_fraction(x)),
        "_line": F.when(is_code, t.mean_line_length(x)),
        "_alnum": F.when(is_code, t.alnum_fraction(x)),
    }


def prose_ladder(c: FilterConfig) -> Column:
    n, w = F.col("_f._chars"), F.col("_f._sizes.words")
    word_len, symbols = F.col("_f._sizes.inked") / F.nullif(w, F.lit(0)), F.col("_f._symbols") / F.nullif(w, F.lit(0))
    return (
        F.when(n < c.min_chars, "too_short")
        .when(n > c.max_chars, "too_long")
        .when(w == 0, "no_words")
        .when(word_len < c.min_mean_word_len, "mean_word_len_low")
        .when(word_len > c.max_mean_word_len, "mean_word_len_high")
        .when(symbols > c.max_symbol_to_word_ratio, "symbol_ratio_high")
        .when(F.col("_f._alpha") < c.min_alpha_fraction, "alpha_fraction_low")
        .when(F.col("_f._dup") > c.max_dup_line_fraction, "dup_lines_high")
    )


def code_ladder(c: FilterConfig) -> Column:
    n = F.col("_f._chars")
    return (
        F.when(n < c.min_chars, "too_short")
        .when(n > c.max_chars, "too_long")
        .when(F.col("_f._line") > c.code_max_mean_line_len, "code_line_len_high")
        .when(F.col("_f._alnum") < c.code_min_alnum_fraction, "code_alnum_low")
    )


def with_reason(docs: DataFrame, c: FilterConfig = FilterConfig(), kind: Column | None = None) -> DataFrame:
    """Adds ``reason``, null for a document to keep. Anything but code counts as prose, a null kind too.

    Features come out of a generator of one row. A filter on the reason stays above it; above a mere projection the
    optimiser would push the filter down and write every feature into it once for each rule."""
    is_code = F.coalesce(F.col("kind") if kind is None else kind, F.lit("prose")) == "code"
    features = F.struct(*[c.alias(n) for n, c in _features(is_code).items()])
    marked = docs.select("*", F.explode_outer(F.array(features)).alias("_f"))
    return marked.withColumn("reason", F.when(is_code, code_ladder(c)).otherwise(prose_ladder(c))).drop("_f")


def keep_documents(docs: DataFrame, c: FilterConfig = FilterConfig()) -> DataFrame:
    return with_reason(docs, c).where("reason is null").drop("reason")


def reason_histogram(marked: DataFrame) -> DataFrame:
    return marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


# The names of the rules, in the order of the ladders.
REASONS = ("too_short", "too_long", "no_words", "mean_word_len_low", "mean_word_len_high", "symbol_ratio_high", "alpha_fraction_low", "dup_lines_high", "code_line_len_high", "code_alnum_low")


def observed(marked: DataFrame) -> tuple[DataFrame, Callable[[], tuple[dict, dict]]]:
    """The rows, and what gives ``filter_stats`` and ``reason_histogram`` of them after the first action that reads all."""
    seen = Observation()
    out = marked.observe(seen, F.count(F.lit(1)).alias("documents_in"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])

    def counted() -> tuple[dict, dict]:
        found = seen.get
        reasons = {r: found[r] for r in REASONS if found[r]}
        rejected = sum(reasons.values())
        return {"documents_in": found["documents_in"], "kept": found["documents_in"] - rejected, "rejected": rejected}, reasons

    return out, counted


def filter_stats(marked: DataFrame) -> DataFrame:
    """One row: documents in, kept, rejected; one shuffle of a few counters."""
    return marked.agg(F.count("*").alias("documents_in"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
