"""Text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(c: Column) -> Column:
    """Words between white space of any script."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")).cast("long")


def estimated_tokens(system: Column, user: Column) -> Column:
    """A quarter of the characters, rounded down; missing parts count as empty."""
    return F.floor((F.length(F.coalesce(system, F.lit(""))) + F.length(F.coalesce(user, F.lit("")))) / 4).cast("long")


def distinct_non_ascii(c: Column) -> Column:
    """The distinct printable characters beyond ASCII."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([\P{ASCII}&&[^\p{C}\p{Z}]])"), F.lit(1)))


def is_single_byte(c: Column) -> Column:
    return F.octet_length(c) == 1


def fill_template(template: str, **values: Column) -> Column:
    """A template with {name} fields filled; null and empty values become ``<name missing>``."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    cols = [F.lit(p) if i % 2 == 0 else F.coalesce(F.when(values[p] != "", values[p].cast("string")), F.lit(f"<{p} missing>")) for i, p in enumerate(parts)]
    return F.concat(*cols)


def parse_mix(c: Column) -> Column:
    """``a/b/c`` as an array of three whole numbers; null where it is anything else."""
    return F.when(c.rlike(r"^\s*\d+\s*/\s*\d+\s*/\s*\d+\s*$"), F.transform(F.split(c, "/"), lambda x: F.trim(x).try_cast("int")))
