"""Line-level helpers over string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends (the built-in trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_lines(content: Column) -> Column:
    """Array of the lines: ended by line feeds, less one carriage return each; no empty last one."""
    lines = F.split(F.regexp_replace(content, "\n\\z", ""), "\n")
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.transform(lines, lambda x: F.regexp_replace(x, "\r\\z", "")))


def is_comment(line: Column) -> Column:
    """A shell line that only holds a comment."""
    return line.rlike(r"(?U)^\s*#")
