"""Sanitised delimited files and rendered INSERT statements."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsgauge.functions.sizing import profilable_columns
from opsgauge.functions.text import column, is_blank, sql_string

_COMPLEX = (T.ArrayType, T.MapType, T.StructType)


def sanitize_for_export(
    df: DataFrame,
    delimiter: str = "|",
    override_char: str = "~",
    not_null: Iterable[str] = (),
    widths: Mapping[str, int] | None = None,
    use_null: bool = True,
) -> DataFrame:
    """Replace string values that a delimited file cannot carry.

    A value that is blank, or holds the delimiter, a tab or a line break, turns
    NULL; in a ``not_null`` column it turns into the override character repeated
    to the column's width.  Without ``use_null`` every column is treated so.
    """
    required = set(not_null)
    known = {c.name: c.declared for c in profilable_columns(df.schema, None, widths)}
    projection = []
    for field in df.schema.fields:
        value = column(field.name)
        if isinstance(field.dataType, T.StringType):
            filler = F.lit(None).cast("string")
            if not use_null or field.name in required:
                if known[field.name] is None:
                    raise ValueError(f"column {field.name} needs a width")
                filler = F.lit(override_char * known[field.name])
            unsafe = is_blank(value) | value.contains(delimiter) | value.rlike("[\t\n\r]")
            value = F.when(unsafe, filler).otherwise(value).alias(field.name)
        projection.append(value)
    return df.select(*projection)


def export_delimited(
    df: DataFrame,
    path: str,
    delimiter: str = "|",
    top: int | None = None,
    order_by: Sequence[str | Column] = (),
    mode: str = "errorifexists",
) -> None:
    """Write one unquoted line per row, NULL as nothing, in parallel files.

    The columns keep their order.  ``top`` limits the rows; give ``order_by``
    to say which.  Run ``sanitize_for_export`` first when strings may hold the
    delimiter.
    """
    if top is not None:
        df = (df.orderBy(*order_by) if order_by else df).limit(top)
    fields = [F.coalesce(_export_text(field), F.lit("")) for field in df.schema.fields]
    df.select(F.concat_ws(delimiter, *fields).alias("value")).write.mode(mode).text(path)


def export_path(table: str, directory: str) -> str:
    """Where a table's export goes: dots in its name become underscores."""
    return f"{directory.rstrip('/')}/{table.replace('.', '_')}.dat"


def render_inserts(
    df: DataFrame,
    target: str,
    top: int | None = None,
    order_by: Sequence[str | Column] = (),
    max_identifier: int | None = None,
) -> DataFrame:
    """One INSERT statement per row in ``sql_statement``.

    ``top`` limits the rows when it is given, ``max_identifier`` the length of column
    names; names that would become the same are refused.
    """
    names = ",".join(f'"{name}"' for name in shortened(df.columns, max_identifier))
    values = []
    for at, field in enumerate(df.schema.fields):
        separator = [F.lit(",")] if at else []
        values += [*separator, F.coalesce(_literal(field), F.lit("NULL"))]
    if top is not None:
        df = (df.orderBy(*order_by) if order_by else df).limit(top)
    head = F.lit(f"INSERT INTO {target} ({names}) VALUES (")
    return df.select(F.concat(head, *values, F.lit(");")).alias("sql_statement"))


def shortened(names: Sequence[str], max_identifier: int | None) -> list[str]:
    """The names cut to a length, which must leave them different."""
    short = [name[:max_identifier] for name in names]
    if len(set(short)) < len(set(names)):
        raise ValueError(f"column names are not different in their first {max_identifier} characters")
    return short


def _literal(field: T.StructField) -> Column:
    value, kind = column(field.name), field.dataType
    _refuse_complex(field)
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("string")
    if isinstance(kind, T.NumericType):
        return value.cast("string")
    if isinstance(kind, T.DateType):
        return sql_string(F.date_format(value, "yyyy-MM-dd"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return sql_string(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return sql_string(value.cast("string"))


def _export_text(field: T.StructField) -> Column:
    value, kind = column(field.name), field.dataType
    _refuse_complex(field)
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSS")
    return value.cast("string")


def _refuse_complex(field: T.StructField) -> None:
    if isinstance(field.dataType, _COMPLEX):
        raise ValueError(f"column {field.name} of type {field.dataType.simpleString()} has no text form")
