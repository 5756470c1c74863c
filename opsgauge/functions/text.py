"""Text expressions: lengths, quoting and literal splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name for SQL text, also when it holds dots or spaces."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string for SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(name: str) -> Column:
    """A column by its exact name."""
    return F.col(quoted(name))


def is_blank(value: Column) -> Column:
    return F.rtrim(value) == ""


def quote_name(name: Column) -> Column:
    """``name`` in square brackets, a closing bracket inside it doubled."""
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))


def sql_string(value: Column) -> Column:
    """``value`` as a quoted SQL literal."""
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def literal_pattern(text: str) -> str:
    """A regular expression that matches exactly ``text``."""
    return "".join(ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch for ch in text)


def split_all(value: Column, delimiter: str) -> Column:
    """All elements of a delimited string, untrimmed; the whole is trimmed first."""
    if not delimiter:
        raise ValueError("delimiter must not be empty")
    return F.split(F.trim(value), literal_pattern(delimiter), -1)


def is_empty(part: Column) -> Column:
    return F.length(F.trim(part)) == 0


def parse_list(text: str) -> list[str]:
    """The same splitting for a comma list given as a parameter.

    Trailing blanks of an element do not count in a comparison, so they go.
    """
    return [part.rstrip(" ") for part in text.strip(" ").split(",") if part.strip(" ")]


def joined_in_order(value: str, order: Sequence[str], separator: str = ", ") -> Column:
    """Ordered string aggregation of the SQL expression ``value``; no rows give ''."""
    keys = ", ".join(order)
    return F.expr(f"coalesce(listagg({value}, '{separator}') WITHIN GROUP (ORDER BY {keys}), '')")
