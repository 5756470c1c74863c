"""Column catalogs translated to another system's DDL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgauge.functions.statements import target_table_name, truncate_statement
from opsgauge.functions.text import joined_in_order

# Source type names and their translation.
TYPE_MAPPING = {
    "bit": "BYTEINT",
    "tinyint": "SMALLINT",
    "uniqueidentifier": "CHAR(38)",
    "datetime": "TIMESTAMP(3)",
    "money": "DECIMAL(18,4)",
    "xml": "CLOB",
    "smalldatetime": "TIMESTAMP(0)",
    "datetime2": "TIMESTAMP(0)",
}
UNICODE_CLAUSE = " CHARACTER SET UNICODE NOT CASESPECIFIC"


def translate_types(
    columns: DataFrame, mapping: Mapping[str, str] = TYPE_MAPPING, compat: bool = False
) -> DataFrame:
    """Add ``target_type`` and ``null_clause`` to a column catalog.

    Types without a rule stay as they are.  Unlimited widths become CLOB and
    decimals keep precision and scale; ``compat`` leaves both untreated.
    """
    return columns.withColumns(
        {
            "target_type": _target_type(mapping, compat),
            "null_clause": F.when(F.col("nullable"), F.lit(" NULL")).otherwise(" NOT NULL"),
        }
    )


def generate_ddl(
    columns: DataFrame,
    target_db: str,
    target_table: str | None = None,
    max_identifier: int | None = None,
    mapping: Mapping[str, str] = TYPE_MAPPING,
    compat: bool = False,
) -> DataFrame:
    """One row per catalogued table: CREATE TABLE and the statement that empties it.

    ``target_table`` names the target of a single table and is refused for more.  ``same_target`` counts the
    tables that share a target, which is 1 unless ``compat`` shortens the names.
    """
    name = F.col("name") if max_identifier is None else F.substring("name", 1, max_identifier)
    clause = F.concat(
        F.lit('"'), name, F.lit('" '), F.col("target_type"), F.col("null_clause")
    )
    # Only cut names can become the same.
    differ = F.lit(True) if max_identifier is None else F.count("short") == F.count_distinct("short")
    same_names = [F.any_value(differ).alias("names_differ") if max_identifier is None else differ.alias("names_differ")]
    clash = F.lit(f"column names are not different in their first {max_identifier} characters")
    tables = (
        translate_types(columns, mapping, compat)
        .select("server", "database", "table", "column_id", name.alias("short"), clause.alias("clause"))
        .groupBy("server", "database", "table")
        .agg(joined_in_order("clause", ["column_id"], ",").alias("clauses"), *same_names)
        .withColumn("clauses", F.when(F.col("names_differ"), F.col("clauses")).otherwise(F.raise_error(clash)))
    )
    if target_table is not None and len(tables.take(2)) > 1:
        raise ValueError("one target table is given for more than one table")
    owner = [F.col(name) for name in ("server", "database", "table")]
    tables = tables.withColumn("target_table", target_table_name(*owner, target_db, target_table, compat))
    shared = tables.groupBy("target_table").agg(F.count(F.lit(1)).alias("same_target"))
    tables = tables.join(shared, "target_table")
    create = F.concat(
        F.lit("CREATE TABLE "), F.col("target_table"), F.lit("("), F.col("clauses"), F.lit(");")
    )
    return tables.select(
        "server",
        "database",
        "table",
        "target_table",
        create.alias("ddl_statement"),
        truncate_statement(F.col("target_table")).alias("truncate_statement"),
        "same_target",
    )


def _target_type(mapping: Mapping[str, str], compat: bool) -> Column:
    kind, plain = F.col("type"), F.lower("type")
    length = F.col("length")
    halved = F.call_function("div", length, F.lit(2))
    unicode_text = F.concat(
        F.substring(kind, 2, 10), F.lit("("), halved.cast("string"), F.lit(")" + UNICODE_CLAUSE)
    )
    text = F.concat(kind, F.lit("("), length.cast("string"), F.lit(")"))
    # Literal pairs, a handful of them: a map lookup needs no join.
    pairs = [F.lit(part) for pair in mapping.items() for part in (pair[0].lower(), pair[1])]
    translated = F.try_element_at(F.create_map(*pairs), plain) if pairs else F.lit(None)
    is_unicode, is_text = plain.isin("nvarchar", "nchar"), plain.isin("varchar", "char")
    steps = F.when(translated.isNotNull(), translated)
    if not compat:
        exact = F.concat(
            kind, F.lit("("), F.col("precision").cast("string"), F.lit(","), F.col("scale").cast("string"), F.lit(")")
        )
        steps = (
            steps.when(is_unicode & (length < 0), F.lit("CLOB CHARACTER SET UNICODE"))
            .when(is_text & (length < 0), F.lit("CLOB"))
            .when(plain.isin("decimal", "numeric"), exact)
        )
    return steps.when(is_unicode, unicode_text).when(is_text, text).otherwise(kind)
