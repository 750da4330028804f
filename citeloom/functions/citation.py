"""Column builders for citation strings: no UDF, everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits of the Thai script, full-width digits, and what they stand for.
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
WIDE_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"


def ascii_digits(c: Column) -> Column:
    """Thai and full-width digits as ASCII digits; null stays null."""
    return F.translate(c, THAI_DIGITS + WIDE_DIGITS, ASCII_DIGITS * 2)


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only strings (white space of any script)."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def cited_base(c: Column) -> Column:
    """The base section a citation names: its first number without leading zeros, with a capital letter that
    stands directly after it; sub-paragraphs are dropped. Null where the text has no number."""
    a = ascii_digits(c)
    number = F.regexp_extract(a, r"(\d+)", 1)
    letter = F.regexp_extract(a, r"^\D*\d+([A-Z])(?![A-Za-z])", 1)
    return F.when(number != "", F.concat(F.regexp_replace(number, r"^0+(?=\d)", ""), letter))


# Fixed value: the unit words that a citation may begin with, longest first.
UNIT_PREFIX = r"(?i)^(article|section|paragraph|clause|art\.?|sec\.?|para\.?|cl\.?|§)"


def strip(c: Column) -> Column:
    """Without outer white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_citation(c: Column) -> Column:
    """The form in which citations are compared: one leading unit word dropped, blanks beside parentheses dropped, blank
    separated sub-units put in parentheses, lower case. ``32 1 a`` and ``Art. 32 (1)(a)`` are ``32(1)(a)``."""
    s = strip(F.regexp_replace(strip(c), UNIT_PREFIX, ""))
    tight = F.regexp_replace(F.regexp_replace(s, r"(?U)\s*\(\s*", "("), r"(?U)\s*\)\s*", ")")
    return F.lower(F.when(F.contains(s, F.lit("(")), tight).otherwise(F.regexp_replace(s, r"(?U)\s+(\S+)", "($1)")))


def base_section(c: Column) -> Column:
    """The leading number with its letter in upper case; the input where it doesn't begin with a number."""
    head = F.regexp_extract(c, r"^(\d+[A-Za-z]?)", 1)
    return F.when(head != "", F.upper(head)).otherwise(c)


def canonical_citation(c: Column) -> Column:
    """``normalize_citation`` with a trailing letter in upper case, as registries hold it."""
    n = normalize_citation(c)
    tail = F.regexp_extract(n, r"([a-z])$", 1)
    return F.when(tail != "", F.concat(F.regexp_replace(n, r"[a-z]$", ""), F.upper(tail))).otherwise(n)


def section_order(c: Column) -> Column:
    """What canonical ids are sorted by before the id itself: their number; ids without one stand last."""
    return F.coalesce(F.regexp_extract(c, r"^(\d+)", 1).try_cast("long"), F.lit(1_000_000_000))


def citation_match(predicted: Column, expected: Column) -> Column:
    """1 where both are there, not empty, and equal in normal form; else 0."""
    same = (predicted != "") & (expected != "") & (normalize_citation(predicted) == normalize_citation(expected))
    return F.coalesce(same, F.lit(False)).cast("int")


def citation_match_any(predicted: Column, expected: Column) -> Column:
    """1 where any of an array of predictions matches."""
    return F.coalesce(F.exists(predicted, lambda p: citation_match(p, expected) == 1), F.lit(False)).cast("int")


def thai_citations(c: Column) -> Column:
    """The distinct sections that a Thai text cites, digits as ASCII, as sorted strings."""
    found = F.regexp_extract_all(c, F.lit(r"มาตรา\s*([๐-๙0-9]+)(?![๐-๙0-9])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("มาตรา "), ascii_digits(x)))))


# Fixed value: marks of a citation in English, German, French and Thai text.
CITATION_MARK = r"(?iU)(?:§\s*\d+|\bArticle\s+\d+|\bArt\.?\s+\d+|\bSection\s+\d+|\bSec\.?\s+\d+|มาตรา\s*[๐-๙0-9]+)"


def citation_marks(c: Column) -> Column:
    """How many citation marks a text holds."""
    return F.regexp_count(c, F.lit(CITATION_MARK))


def expand_range(first: Column, last: Column, most: int = 100) -> Column:
    """All numbers of "a to b" where a <= b and at most ``most`` apart; else an empty array."""
    ok = (first <= last) & (last - first <= most)
    return F.when(ok, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
