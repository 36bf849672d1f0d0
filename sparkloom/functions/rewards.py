"""Verifiable rewards of completions, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Tags and number format of the completions.
ANSWER, THINK_OR_ANSWER = r"(?is)<answer>(.*?)</answer>", r"(?is)<{tag}>.*?</{tag}>"
FENCE, FINAL = r"(?is)```(?:python)?[ \t]*\n?(.*?)```", r"####\s*(-?[\d,]+)"
NUMBER = r"-?\p{Nd}[\p{Nd},]*\.?\p{Nd}*"


def _last(text: Column, pattern: str) -> Column:
    """Group 1 of the last match, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def extract_answer(completion: Column) -> Column:
    """Stripped content of the last answer block; null without one."""
    return strip(_last(completion, ANSWER))


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """All decimal digits of Unicode beyond ASCII, and the ASCII digits they stand for."""
    found = [(chr(c), str(unicodedata.decimal(chr(c)))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def to_number(text: Column) -> Column:
    """First number of a text once commas and blanks are gone, in digits of any script; null without one."""
    plain = F.replace(F.replace(text, F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    return F.translate(F.regexp_substr(plain, F.lit(NUMBER)), *_digits()).try_cast("double")


def format_reward(completion: Column) -> Column:
    """Half for a think block, half for an answer block, wherever they are."""
    has = lambda tag: F.coalesce(completion.rlike(THINK_OR_ANSWER.format(tag=tag)), F.lit(False)).cast("double")
    return F.lit(0.5) * has("think") + F.lit(0.5) * has("answer")


def numeric_reward(completion: Column, gold: Column, tolerance: float = 1e-6) -> Column:
    return F.coalesce((F.abs(to_number(extract_answer(completion)) - to_number(gold)) <= tolerance).cast("double"), F.lit(0.0))


def total_reward(completion: Column, gold: Column, format_weight: float = 0.1) -> Column:
    return numeric_reward(completion, gold) + F.lit(format_weight) * format_reward(completion)


def extract_code(completion: Column) -> Column:
    """Last fenced block, else last answer block, else the whole text; stripped."""
    return strip(F.coalesce(_last(completion, FENCE), _last(completion, ANSWER), completion))


def final_answer(solution: Column) -> Column:
    """The number behind the first ``####``, without commas; empty without one."""
    return F.replace(F.regexp_extract(solution, FINAL, 1), F.lit(","), F.lit(""))


def reasoning(solution: Column) -> Column:
    return strip(F.regexp_replace(solution, FINAL, ""))
