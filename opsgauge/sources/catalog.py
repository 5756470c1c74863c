"""Column catalogs and metadata snapshots."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsgauge.functions.calendar import moment
from opsgauge.functions.sizing import profilable_columns
from opsgauge.operators import SCOPE

CATALOG_SCHEMA = (
    "server string, database string, table string, column_id int, name string, type string, "
    "length int, precision int, scale int, nullable boolean"
)

# Catalog type names of Spark types.
_TYPE_NAMES = {
    T.ByteType: "tinyint",
    T.ShortType: "smallint",
    T.IntegerType: "int",
    T.LongType: "bigint",
    T.FloatType: "real",
    T.DoubleType: "float",
    T.BooleanType: "bit",
    T.DateType: "date",
    T.TimestampType: "datetime2",
    T.TimestampNTZType: "datetime2",
    T.BinaryType: "varbinary",
}


def catalog_from(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    database: str,
    server: str = "",
    declared_lengths: Mapping[str, Mapping[str, int]] | None = None,
) -> DataFrame:
    """The column catalog of some DataFrames; its size is that of their schemas."""
    rows = []
    for table, df in tables.items():
        widths = (declared_lengths or {}).get(table, {})
        declared = {c.name: c.declared for c in profilable_columns(df.schema, None, widths)}
        for at, field in enumerate(df.schema.fields, start=1):
            kind = field.dataType
            precision = scale = None
            length = declared.get(field.name)
            if isinstance(kind, T.DecimalType):
                name, precision, scale = "decimal", kind.precision, kind.scale
            elif isinstance(kind, T.StringType):
                name = "varchar"
                length = -1 if length is None else length
            else:
                name = _TYPE_NAMES.get(type(kind), kind.simpleString())
            rows.append(
                (server, database, table, at, field.name, name, length, precision, scale, field.nullable)
            )
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def latest_snapshot(snapshots: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """The newest snapshot of each database, up to ``as_of``."""
    if as_of is not None:
        snapshots = snapshots.where(F.col("snapshot_ts") <= moment(as_of, snapshots, "snapshot_ts"))
    newest = snapshots.groupBy(*SCOPE).agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return snapshots.join(newest, [*SCOPE, "snapshot_ts"], "left_semi")
