"""Inventory, definitions and drift of indexes.

An index is any named, ordered group of a table's columns.  Inputs are catalog
snapshots of all servers; lists per index are aggregated once and joined.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.functions.statements import describe_index
from opsgauge.functions.text import joined_in_order
from opsgauge.operators import INDEX, OBJECT, SCOPE
from opsgauge.operators.fleet import REPORT_EXCLUDED

DEFINITION_KEYS = ("serverName", "databaseName", "schemaName", "tableName", "indexName")
DEFINITION_FIELDS = (
    "indexType",
    "indexKeys",
    "includedColumns",
    "partitionKeys",
    "isPrimaryKey",
    "isUnique",
    "isUniqueConstraint",
    "isFilteredIndex",
    "filterDefinition",
)


def key_and_included_columns(index_columns: DataFrame, columns: DataFrame) -> DataFrame:
    """Names of the key and of the included columns of each index, in index order."""
    named = _named(index_columns, columns)
    order = ["index_column_id"]
    return named.groupBy(*INDEX).agg(
        joined_in_order("CASE WHEN NOT is_included_column THEN column_name END", order).alias("indexed_columns"),
        joined_in_order("CASE WHEN is_included_column THEN column_name END", order).alias("included_columns"),
    )


def index_inventory(
    tables: DataFrame,
    indexes: DataFrame,
    partitions: DataFrame,
    index_columns: DataFrame,
    columns: DataFrame,
    schemes: DataFrame,
    functions: DataFrame,
    table: str | None = None,
) -> DataFrame:
    """Each index with description, columns, partition scheme and row count."""
    named_tables = tables.select(*OBJECT, F.col("name").alias("table_name"))
    if table is not None:
        named_tables = named_tables.where(F.col("table_name") == table)
        indexes, partitions, index_columns = _only(named_tables, indexes, partitions, index_columns)
    sizes = partitions.groupBy(*INDEX).agg(
        F.count("partition_number").alias("partition_count"), F.sum("rows").alias("row_count")
    )
    placed = schemes.join(functions.select(*SCOPE, "function_id"), [*SCOPE, "function_id"]).select(
        *SCOPE, "data_space_id", F.col("name").alias("partition_scheme_name")
    )
    described = indexes.select(
        *INDEX,
        "data_space_id",
        F.coalesce("name", F.lit("")).alias("index_name"),
        describe_index(
            F.col("index_id"), F.col("ignore_dup_key"), F.col("is_unique"), F.col("is_primary_key")
        ).alias("index_description"),
    )
    return (
        described.join(sizes, list(INDEX))
        .join(key_and_included_columns(index_columns, columns), list(INDEX), "left")
        .join(named_tables, list(OBJECT))
        .join(placed, [*SCOPE, "data_space_id"], "left")
        .select(
            *SCOPE,
            "table_name",
            "index_name",
            "object_id",
            "index_id",
            "index_description",
            F.coalesce("indexed_columns", F.lit("")).alias("indexed_columns"),
            F.coalesce("included_columns", F.lit("")).alias("included_columns"),
            F.coalesce("partition_scheme_name", F.lit("")).alias("partition_scheme_name"),
            "partition_count",
            "row_count",
        )
        .orderBy(*SCOPE, "table_name", "index_id", "object_id")
    )


def index_definitions(
    tables: DataFrame,
    indexes: DataFrame,
    index_columns: DataFrame,
    columns: DataFrame,
    databases: DataFrame,
    table: str | None = None,
    schemas: DataFrame | None = None,
) -> DataFrame:
    """One comparable row per index: ordered column lists, flags and filter.

    ``schemaName`` is empty without ``schemas``.
    """
    if schemas is None:
        named_tables = tables.select(*OBJECT, F.lit("").alias("schemaName"), F.col("name").alias("tableName"))
    else:
        owners = schemas.select(*SCOPE, "schema_id", F.col("name").alias("schemaName"))
        owned = tables.join(owners, [*SCOPE, "schema_id"], "left")
        named_tables = owned.select(*OBJECT, F.coalesce("schemaName", F.lit("")).alias("schemaName"), F.col("name").alias("tableName"))
    if table is not None:
        named_tables = named_tables.where(F.col("tableName") == table)
        indexes, index_columns = _only(named_tables, indexes, index_columns)
    is_key = "NOT is_included_column AND key_ordinal > 0"
    marked = "concat(column_name, CASE WHEN is_descending_key THEN ' DESC' ELSE '' END)"
    lists = (
        _named(index_columns, columns)
        .groupBy(*INDEX)
        .agg(
            joined_in_order(f"CASE WHEN {is_key} THEN {marked} END", ["key_ordinal", "column_id"]).alias("indexKeys"),
            joined_in_order("CASE WHEN is_included_column THEN column_name END", ["column_id"]).alias(
                "includedColumns"
            ),
            joined_in_order(
                "CASE WHEN partition_ordinal > 0 THEN column_name END", ["partition_ordinal", "column_id"]
            ).alias("partitionKeys"),
        )
    )
    named_databases = databases.select(*SCOPE, F.col("name").alias("databaseName"))
    # Databases go into the tables first: the large side is never joined on its database alone.
    return (
        indexes.join(lists, list(INDEX))
        .join(named_tables.join(named_databases, list(SCOPE)), list(OBJECT))
        .select(
            F.col("server").alias("serverName"),
            "databaseName",
            "schemaName",
            "tableName",
            F.col("name").alias("indexName"),
            F.col("type_desc").alias("indexType"),
            "indexKeys",
            "includedColumns",
            "partitionKeys",
            F.col("is_primary_key").alias("isPrimaryKey"),
            F.col("is_unique").alias("isUnique"),
            F.col("is_unique_constraint").alias("isUniqueConstraint"),
            F.col("has_filter").alias("isFilteredIndex"),
            F.coalesce("filter_definition", F.lit("")).alias("filterDefinition"),
        )
        .orderBy("serverName", "databaseName", "schemaName", "tableName", "indexName")
    )


def index_definitions_fleet(
    tables: DataFrame,
    indexes: DataFrame,
    index_columns: DataFrame,
    columns: DataFrame,
    databases: DataFrame,
    exclude: Iterable[str] = REPORT_EXCLUDED,
    schemas: DataFrame | None = None,
) -> DataFrame:
    """Definitions of all databases but the servers' own."""
    kept = databases.where(~F.col("name").isin(*exclude))
    return index_definitions(tables, indexes, index_columns, columns, kept, schemas=schemas)


def definition_drift(
    a: DataFrame,
    b: DataFrame,
    keys: Iterable[str] | None = None,
    fields: Iterable[str] = DEFINITION_FIELDS,
    across_servers: bool = False,
) -> DataFrame:
    """What changed from ``a`` to ``b``: added, removed and changed definitions.

    ``changed_fields`` lists the fields that differ; equal definitions give no row.  Definitions
    are matched by the ``DEFINITION_KEYS`` that both sides have; ``across_servers`` leaves the server
    out, to compare one server with another.  A side with two rows of the same key is refused.
    """
    left_out = {"serverName"} if across_servers else set()
    if keys is None:
        keys = [key for key in DEFINITION_KEYS if key in a.columns and key in b.columns and key not in left_out]
    keys, fields = list(keys), list(fields)
    for side in (a, b):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"definitions are not unique by {', '.join(keys)}")
    old, new = _prefixed(a, "a_", keys + fields), _prefixed(b, "b_", keys + fields)
    on = [F.col(f"a_{key}").eqNullSafe(F.col(f"b_{key}")) for key in keys]
    differing = F.array_join(
        F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]), ", "
    )
    only_new, only_old = F.col("a__here").isNull(), F.col("b__here").isNull()
    change = F.when(only_new, "added").when(only_old, "removed").when(differing != "", "changed")
    return (
        old.join(new, on, "full_outer")
        .select(
            *[F.when(only_new, F.col(f"b_{key}")).otherwise(F.col(f"a_{key}")).alias(key) for key in keys],
            change.alias("change"),
            F.when(only_new | only_old, F.lit("")).otherwise(differing).alias("changed_fields"),
        )
        .where(F.col("change").isNotNull())
    )


def definition_differences(
    a: DataFrame, b: DataFrame, columns: Iterable[str] = (*DEFINITION_KEYS, *DEFINITION_FIELDS)
) -> DataFrame:
    """The quick form: rows of ``a`` that ``b`` lacks, duplicates counted."""
    names = list(columns)
    return a.select(*names).exceptAll(b.select(*names))


def _named(index_columns: DataFrame, columns: DataFrame) -> DataFrame:
    names = columns.select(*OBJECT, "column_id", F.col("name").alias("column_name"))
    return index_columns.join(names, [*OBJECT, "column_id"])


def _only(chosen: DataFrame, *frames: DataFrame) -> list[DataFrame]:
    """The rows of the chosen tables, so that nothing else is aggregated."""
    keys = chosen.select(*OBJECT)
    return [frame.join(keys, list(OBJECT), "left_semi") for frame in frames]


def _prefixed(df: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    return df.select(*[F.col(name).alias(prefix + name) for name in names], F.lit(True).alias(f"{prefix}_here"))
