"""Text features as Column expressions, with Python's Unicode rules for white space and line breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that Python's str.isspace and str.splitlines know, as classes for Java and RE2.
WS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same white space as a string, and single line breaks as a class.
WS_CHARS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BREAK = r"\x{A}-\x{D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}"
LB = r"\r\n|[\x{A}-\x{D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
SYMBOLS = r"#|\.\.\.|…"
# Ranges of code points that are letters (or numbers) in Unicode 15.1 and unknown to Java 17, whose Unicode is 13.
NEW_LETTERS = """870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7D0-A7D1 A7D3 A7D5-A7D9 A7F2-A7F4
10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 10780-10785 10787-107B0
107B2-107BA 10F70-10F81 11071-11072 11075 1123F-11240 11740-11746 11AB0-11ABF 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F
13441-13446 16A70-16ABE 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D
1E290-1E2AD 1E4D0-1E4EB 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"""
NEW_NUMBERS = "11F50-11F59 16AC0-16AC9 1D2C0-1D2D3 1E4F0-1E4F9"


def _class(ranges: str) -> str:
    """Java's class of code points from ranges in hexadecimal."""
    return "[" + "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in ranges.split()) + "]"


#: Letters, and letters or numbers, by Unicode 15.1. The first new code point guards the ranges, so other texts never try them.
LETTER = rf"[\p{{L}}[\x{{870}}-\x{{10FFFF}}&&{_class(NEW_LETTERS)}]]"
LETTER_OR_NUMBER = rf"[\p{{L}}\p{{N}}[\x{{870}}-\x{{10FFFF}}&&{_class(NEW_LETTERS + " " + NEW_NUMBERS)}]]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def char_length(text: Column) -> Column:
    """Code points."""
    return F.length(text)


def words(text: Column) -> Column:
    """Runs of anything but white space. Splitting is linear; collecting matches copies the text for each of them."""
    return F.filter(F.split(text, f"[{WS}]+", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return let(normalise_space(text), count_words)


def count_words(normal: Column) -> Column:
    """Words of a text whose white space is normalised: its blanks, and one."""
    return F.when(normal == "", 0).otherwise(F.length(normal) - inked(normal) + 1)


def inked(normal: Column) -> Column:
    """Characters of a normalised text that are no blanks."""
    return F.length(F.replace(normal, F.lit(" "), F.lit("")))


def mean_word_length(text: Column) -> Column:
    """Null without words."""
    return let(normalise_space(text), lambda n: inked(n) / F.nullif(count_words(n), F.lit(0)))


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS))


def symbol_ratio(text: Column) -> Column:
    return symbol_count(text) / F.nullif(word_count(text), F.lit(0))


def _share(text: Column, others: str) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, others, "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def alpha_fraction(text: Column) -> Column:
    """Letters of Unicode 15.1 among all characters; 0 for the empty text."""
    return _share(text, f"[^{LETTER}]")


def alnum_fraction(text: Column) -> Column:
    return _share(text, f"[^{LETTER_OR_NUMBER}]")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WS_CHARS))


def duplicate_line_fraction(text: Column) -> Column:
    """Share of non-empty stripped lines that repeat an earlier one; 0 up to one line."""
    lines = F.filter(F.transform(F.split(text, f"[{_BREAK}]+", -1), strip), lambda x: x != "")
    return let(lines, lambda x: F.when(F.size(x) <= 1, 0.0).otherwise((F.size(x) - F.size(F.array_distinct(x))) / F.size(x)))


def mean_line_length(text: Column) -> Column:
    """Over all lines, empty ones too; a break at the end opens no line."""
    count = let(F.split(text, LB, -1), lambda p: F.size(p) - F.when(F.element_at(p, -1) == "", 1).otherwise(0))
    return F.length(F.regexp_replace(text, LB, "")) / F.greatest(count, F.lit(1))


def normalise_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def spaced_digits(number: Column) -> Column:
    """Every character of a number, parted by blanks."""
    return strip(F.regexp_replace(number.cast("string"), "(.)", "$1 "))


def shingles(text: Column, k: int) -> Column:
    """Distinct runs of k words; a shorter text is one shingle, a wordless one has none.

    For long texts give the words as a column that exists already (see ``operators.dedup``): inside a lambda Spark
    would split the text again for each element."""
    return shingles_of(words(text), k)


def shingles_of(w: Column, k: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def prompt_text(question: Column, instruction: str = "Solve the problem. Think first, then give the answer.") -> Column:
    return F.concat(F.lit(instruction + "\n"), F.lit("Question: "), question, F.lit("\n"))


def target_text(thought: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>"), thought, F.lit("</think>\n<answer>"), answer, F.lit("</answer>"))


def code_points(text: Column) -> Column:
    """Code points of a text, as stand-ins for token ids."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.ascii)
