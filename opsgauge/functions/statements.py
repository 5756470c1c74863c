"""Generated statement texts.

The templates are fixed output formats: their wording must stay as it is.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsgauge.functions.text import sql_string


def describe_index(index_id: Column, ignore_dup_key: Column, is_unique: Column, is_primary_key: Column) -> Column:
    """Kind of index followed by its flags in a fixed order."""
    kind = F.when(index_id == 0, "heap").when(index_id == 1, "clustered").otherwise("nonclustered")
    flags = [
        (ignore_dup_key, ", ignore duplicate keys"),
        (is_unique, ", unique"),
        (is_primary_key, ", primary key"),
    ]
    return F.concat(kind, *[F.when(flag, F.lit(text)).otherwise("") for flag, text in flags])


def index_type_text(is_unique: Column, type_desc: Column) -> Column:
    return F.concat(F.when(is_unique, F.lit("UNIQUE ")).otherwise(""), type_desc)


def drop_statement(
    index_type: Column, is_unique: Column, index: Column, database: Column, schema: Column, table: Column
) -> Column:
    """How to remove a nonclustered index: a plain one is dropped, a unique one is a constraint."""
    place = F.concat_ws(".", database, schema, table)
    drop_index = F.concat(F.lit("Drop Index "), index, F.lit(" On "), place, F.lit(";"))
    drop_constraint = F.concat(
        F.lit("Alter Table "), place, F.lit(" Drop Constraint "), index, F.lit(";")
    )
    nonclustered = index_type == 2
    return (
        F.when(nonclustered & ~is_unique, drop_index)
        .when(nonclustered & is_unique, drop_constraint)
        .otherwise("")
    )


def create_index_statement(
    table: Column,
    rank: Column,
    target: Column,
    equality: Column,
    inequality: Column,
    included: Column,
    as_of: date,
) -> Column:
    """The statement that would create a suggested index."""
    keys = F.concat_ws(",", equality, inequality)
    name = F.concat(F.lit("IX_"), table, F.lit(f"_missing_{as_of:%Y%m%d}_"), rank.cast("string"))
    include = F.coalesce(F.concat(F.lit(" INCLUDE ("), included, F.lit(")")), F.lit(""))
    return F.concat(
        F.lit("CREATE NONCLUSTERED INDEX "), name, F.lit(" ON "), target,
        F.lit(" ("), keys, F.lit(")"), include, F.lit(";"),
    )


REBUILD_OPTIONS = "ONLINE = Off, SORT_IN_TEMPDB = ON"


def maintenance_command(
    action: Column,
    database: Column,
    schema: Column,
    table: Column,
    index: Column,
    partition_number: Column,
    partition_count: Column,
    rebuild_options: str = REBUILD_OPTIONS,
) -> Column:
    """The command for a planned action; a partitioned index names its partition."""
    head = F.concat(
        F.lit("ALTER INDEX "), index, F.lit(" ON "), database, F.lit("."), schema, F.lit("."), table
    )
    partition = F.when(
        partition_count > 1, F.concat(F.lit(" PARTITION = "), partition_number.cast("string"))
    ).otherwise("")
    return F.when(action == "REORGANIZE", F.concat(head, F.lit(" REORGANIZE"), partition)).when(
        action == "REBUILD", F.concat(head, F.lit(f" REBUILD WITH ({rebuild_options})"))
    )


def disable_job_statement(job_id: Column) -> Column:
    return F.concat(
        F.lit("EXECUTE msdb.dbo.sp_update_job @job_id = "),
        sql_string(job_id.cast("string")),
        F.lit(", @enabled = 0;"),
    )


def truncate_statement(target: Column) -> Column:
    return F.concat(F.lit("DELETE FROM "), target, F.lit(";"))


def target_table_name(
    server: Column, database: Column, table: Column, target_db: str, override: str | None = None, compat: bool = False
) -> Column:
    """``db."server.database.table"``, or the name that is given.

    Dots in server and database names are doubled, so different tables have different
    targets.  ``compat`` keeps the short form: ``db.tmp_`` and 26 characters after the table's first dot.
    """
    if override is not None:
        return F.lit(f"{target_db}.{override}")
    if compat:
        short = F.substring(table, F.instr(table, ".") + 1, F.lit(26))
        return F.concat(F.lit(f"{target_db}.tmp_"), short)
    owners = [F.replace(part, F.lit("."), F.lit("..")) for part in (server, database)]
    full = F.replace(F.concat_ws(".", *owners, table), F.lit('"'), F.lit('""'))
    return F.concat(F.lit(f'{target_db}."'), full, F.lit('"'))
