"""Column expressions on free text and multi-select cells.

White space is Unicode white space throughout: ``(?U)`` makes ``\\s`` cover it, which the
plain regular expressions and ``trim`` of the engine do not. Callers that use one derived text
several times put it in a column first, so that it is computed once per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv

# --- fixed values: the characters of the Unicode property White_Space ---
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def text(c: str | Column) -> Column:
    """The cell as a string, null as the empty string."""
    return F.coalesce((F.col(f"`{c}`") if isinstance(c, str) else c).cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """White space removed at both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(_SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_token(c: Column) -> Column:
    """Lower case, only digits, Latin letters and Hangul syllables."""
    return F.regexp_replace(F.lower(c), fv.NON_TOKEN_CHARS, "")


def cleaned_tokens(tokens: Iterable[str]) -> list[str]:
    """The none tokens as ``clean_token`` leaves them."""
    keep = lambda ch: ch.isascii() and ch.isalnum() or "가" <= ch <= "힣"
    return sorted({"".join(ch for ch in t.lower() if keep(ch)) for t in tokens})


def blank_if_none(c: Column, tokens: Iterable[str]) -> Column:
    """Stripped text; the empty string if it is exactly one of the none tokens."""
    t = strip(c)
    return F.when(t.isin(list(tokens)), "").otherwise(t)


def is_none_like(c: Column, tokens: Iterable[str]) -> Column:
    """True if the cleaned text is empty or a cleaned none token ("없음." counts)."""
    return clean_token(c).isin(["", *cleaned_tokens(tokens)])


def blank_if_none_like(c: Column, tokens: Iterable[str]) -> Column:
    return F.when(is_none_like(c, tokens), "").otherwise(c)


def is_filled(c: str | Column, tokens: Iterable[str]) -> Column:
    """Not null, not blank, not exactly a none token, not nan/none in any case."""
    col = F.col(f"`{c}`") if isinstance(c, str) else c
    t = strip(text(col))
    return (t != "") & ~t.isin(list(tokens)) & ~F.lower(t).isin("nan", "none")


def split_tokens(c: Column) -> Column:
    """Parts between list separators, stripped, without empty ones."""
    parts = F.transform(F.split(c, fv.TOKEN_SPLIT, -1), strip)
    return F.filter(parts, lambda t: t != "")


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """Literal, case-insensitive substring test for any of the words."""
    return lower_contains_any(F.lower(c), words)


def lower_contains_any(low: Column, words: Iterable[str]) -> Column:
    """The same on text that is lower case already."""
    return reduce(or_, [F.contains(low, F.lit(w.lower())) for w in words])


def any_token_contains(tokens: Column, words: Iterable[str]) -> Column:
    return F.exists(tokens, lambda t: contains_any(t, words))


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def keyword_flags(low: Column, rules: Mapping[str, Iterable[str]], prefix: str) -> dict[str, Column]:
    """One 0/1 column per rule on lower-case text."""
    return {f"{prefix}{name}": flag(lower_contains_any(low, words)) for name, words in rules.items()}


def total(flags: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, flags)


def char_length(c: Column) -> Column:
    return F.length(c)


def word_count(squeezed: Column) -> Column:
    """Words of squeezed text: one more than its single spaces."""
    return F.when(squeezed == "", 0).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1)


def lettered_codes(c: Column) -> Column:
    """Distinct codes "A." of a multi-select cell; a leading code hides others in its part."""
    cell = strip(c)
    parts = F.filter(F.transform(F.split(cell, r"[\n,;/|]+", -1), strip), lambda p: p != "")
    lead = lambda p: F.regexp_extract(p, r"^([A-Z])\.", 1)
    found = F.transform(parts, lambda p: F.when(lead(p) != "", F.array(lead(p))).otherwise(F.regexp_extract_all(p, F.lit(r"([A-Z])\."), F.lit(1))))
    codes = F.array_distinct(F.flatten(found))
    return F.when(F.lower(cell).isin("", "nan", "none"), F.array().cast("array<string>")).otherwise(codes)


def leading_letter_codes(c: Column) -> Column:
    """Distinct codes of the parts that start with "A." (white space before the dot allowed)."""
    codes = F.transform(split_tokens(c), lambda t: F.regexp_extract(t, r"(?U)^([A-Z])\s*\.", 1))
    return F.array_distinct(F.filter(codes, lambda t: t != ""))


def numbered_codes(c: Column, none_tokens: Iterable[str]) -> Column:
    """Distinct four-digit codes that start a part, followed by a colon or a word boundary."""
    parts = F.filter(split_tokens(strip(c)), lambda t: ~t.isin(list(none_tokens)))
    codes = F.transform(parts, lambda t: F.regexp_extract(t, r"(?U)^(\d{4})(?:\s*[:：]|\b)", 1))
    return F.array_distinct(F.filter(codes, lambda t: t != ""))


def without_parentheses(c: Column) -> Column:
    return F.regexp_replace(c, fv.PARENTHESISED, " ")


def certificate_name(c: Column) -> Column:
    """A certificate token without parentheses, status words and separators."""
    t = F.regexp_replace(without_parentheses(strip(c)), fv.PREPARING_WORD, " ")
    t = F.regexp_replace(t, fv.CERT_STATUS_WORDS, " ")
    return squeeze(F.regexp_replace(t, fv.CERT_SEPARATORS, " "))


def joined(first: Column, second: Column, separator: str, missing: str = "UNK") -> Column:
    """Two categories as one, null as ``missing``."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(missing))
    return F.concat(part(first), F.lit(separator), part(second))


def placeholder_to_null(c: Column, placeholders: Iterable[str] = fv.PLACEHOLDERS) -> Column:
    """Stripped text; null if it is a placeholder."""
    t = strip(c)
    return F.when(~t.isin(list(placeholders)), t)


def number_in_text(c: Column) -> Column:
    """The number left after removing everything but digits, points and minus signs, else null."""
    kept = F.regexp_replace(c.cast("string"), r"[^0-9.\-]+", "")
    # only what reads as a number is cast: a cast that fails costs an exception for every row
    return F.get(F.regexp_extract_all(kept, F.lit(r"^-?(?:\d+\.?\d*|\.\d+)$"), F.lit(0)), F.lit(0)).try_cast("double")


def to_number(c: Column, default: float | None = None) -> Column:
    """Numeric value, null (or ``default``) where the text is not a number."""
    n = c.try_cast("double")
    n = F.when(~F.isnan(n), n)
    return n if default is None else F.coalesce(n, F.lit(float(default)))
