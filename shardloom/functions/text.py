"""Classification of SQL texts: read or write, and the first table named."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keyword, one space and a name that a space, quote, comma, bracket or the end follows (fixed pattern).
TABLE_PATTERN = r"(?i)(?:FROM|UPDATE|MERGE INTO|INSERT [a-z ]*INTO) ['`\"]?([a-zA-Z0-9_]+)(?:[ '`\",)]|\z)"


def operation(sql: str) -> str:
    """``read`` for a SELECT of more than ten bytes that does not end in FOR UPDATE, else ``write``."""
    text = sql.strip()
    if len(text.encode("utf-8")) > 10 and text[:6].lower() == "select" and text[-10:].lower() != "for update":
        return "read"
    return "write"


def operation_expr(sql: Column) -> Column:
    """The column form of ``operation``; null gives null."""
    text = F.regexp_replace(F.regexp_replace(sql, r"^\s+", ""), r"\s+\z", "")
    read = (F.octet_length(text) > 10) & (F.lower(F.substring(text, 1, 6)) == "select") & (F.lower(F.right(text, F.lit(10))) != "for update")
    return F.when(sql.isNull(), None).when(read, "read").otherwise("write")


def table_of(sql: str) -> str:
    """The first table a SQL text names, or an empty text."""
    m = re.search(TABLE_PATTERN.replace(r"\z", r"\Z"), sql)
    return m[1] if m else ""


def table_of_expr(sql: Column) -> Column:
    """The column form of ``table_of``."""
    return F.regexp_extract(sql, TABLE_PATTERN, 1)
