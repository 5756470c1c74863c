"""Byte sizes of integer and character columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Width in bytes of each integer kind.
INTEGER_BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}

# Catalog type names that can be profiled.
INTEGER_TYPES = ("tinyint", "smallint", "int", "bigint")
CHARACTER_TYPES = ("char", "varchar", "nchar", "nvarchar")

# Largest maximum and smallest minimum that fit in 1, 2 and 4 bytes.
BOUNDS = ((1, 255, 0), (2, 32767, -32768), (4, 2147483647, -2147483648))
COMPAT_BOUNDS = ((1, 255, 0), (2, 32768, -32768), (4, 2147483647, -2147483647))

# Display units.
UNIT_BYTES = {"KB": 1024, "MB": 1024**2, "GB": 1024**3, "TB": 1024**4}

_KINDS = {T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "int", T.LongType: "bigint"}


@dataclass(frozen=True)
class SizedColumn:
    """A column that can be profiled; ``declared`` is its width in bytes if known."""

    name: str
    kind: str
    declared: int | None

    @property
    def is_integer(self) -> bool:
        return self.kind in INTEGER_BYTES


def profilable_columns(
    schema: T.StructType,
    cols: Iterable[str] | None = None,
    declared_lengths: Mapping[str, int] | None = None,
) -> list[SizedColumn]:
    """The integer and character columns of a schema, others ignored.

    Character widths come from ``declared_lengths`` or from the char/varchar
    width kept with the field; Parquet strings carry none.
    """
    wanted = None if cols is None else set(cols)
    if wanted is not None and wanted - set(schema.names):
        raise ValueError(f"unknown columns: {sorted(wanted - set(schema.names))}")
    widths = declared_lengths or {}
    found = []
    for field in schema.fields:
        if wanted is not None and field.name not in wanted:
            continue
        kind = _KINDS.get(type(field.dataType))
        if kind:
            found.append(SizedColumn(field.name, kind, INTEGER_BYTES[kind]))
        elif isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType)):
            declared = widths.get(field.name, _kept_width(field))
            found.append(SizedColumn(field.name, "string", declared))
    return found


def profilable_catalog(catalog: DataFrame, table: str | None = None) -> DataFrame:
    """The rows of a column catalog whose type can be profiled."""
    kept = catalog.where(F.lower("type").isin(*INTEGER_TYPES, *CHARACTER_TYPES))
    return kept if table is None else kept.where(F.col("table") == table)


def required_bytes(
    is_integer: Column,
    max_value: Column,
    min_value: Column,
    max_len: Column,
    percent_growth: int = 10,
    compat: bool = False,
) -> Column:
    """Bytes needed for the values seen, integers allowed to grow by a percentage.

    The product is exact decimal.  Character columns need their longest value.
    A column with only NULLs has no answer; ``compat`` gives 8 for integers.
    """
    grown = max_value.cast("decimal(20,0)") * F.lit(100 + percent_growth).cast("decimal(5,0)")
    steps = None
    for size, high, low in COMPAT_BOUNDS if compat else BOUNDS:
        fits = (grown <= F.lit(high * 100).cast("decimal(26,0)")) & (min_value >= F.lit(low))
        steps = F.when(fits, size) if steps is None else steps.when(fits, size)
    needed = steps.otherwise(8)
    if not compat:
        needed = F.when(max_value.isNotNull(), needed)
    return F.when(is_integer, needed).otherwise(max_len).cast("bigint")


def _kept_width(field: T.StructField) -> int | None:
    if isinstance(field.dataType, (T.CharType, T.VarcharType)):
        return field.dataType.length
    text = (field.metadata or {}).get("__CHAR_VARCHAR_TYPE_STRING", "")
    width = re.fullmatch(r"(?:var)?char\((\d+)\)", text)
    return int(width.group(1)) if width else None
