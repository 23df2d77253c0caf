"""Small Column helpers for text, numbers and rounding, all JVM-side builtins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_array(element_type: str = "string") -> Column:
    return F.array().cast(f"array<{element_type}>")


def py_strip(c: Column) -> Column:
    """Remove leading/trailing Unicode white space (Spark ``trim`` removes spaces only). A text that begins and ends with a
    printed ASCII character has none, and is not searched."""
    ends = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(ends, c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def fmt_1dp(c: Column) -> Column:
    """One decimal, half-even on the binary value, no grouping (like ``f"{x:.1f}"``)."""
    return F.call_function("format_number", c, F.lit("0.0"))


def first_number(c: Column, pattern: str = r"[\d.]+") -> Column:
    """First match of ``pattern`` parsed as double; no match or unparsable -> null."""
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit("")).try_cast("double")
