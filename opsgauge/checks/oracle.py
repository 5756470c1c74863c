"""The SQL each registered query is checked against.

Written for DuckDB over the test tables; ``{name}`` is a test table or one of
the shared adapters.
"""

from __future__ import annotations

from opsgauge.checks.adapters import with_adapters

ORACLE: dict[str, str] = {}

# Integer columns with their bytes, string columns with their declared width.
_COLUMNS = {
    "region": {"r_regionkey": 4, "r_name": ""},
    "nation": {"n_nationkey": 4, "n_name": "", "n_regionkey": 4},
    "customer": {"c_custkey": 8, "c_name": "25", "c_nationkey": 4, "c_mktsegment": "10"},
    "supplier": {"s_suppkey": 8, "s_name": "", "s_nationkey": 4},
    "part": {"p_partkey": 8, "p_name": "55", "p_brand": "10", "p_type": "25", "p_size": 4},
    "orders": {"o_orderkey": 8, "o_custkey": 8, "o_orderstatus": "1", "o_orderpriority": "15"},
    "lineitem": {
        "l_orderkey": 8,
        "l_partkey": 8,
        "l_suppkey": 8,
        "l_linenumber": 4,
        "l_returnflag": "10",
        "l_linestatus": "10",
    },
    "events": {"event_id": 8, "user_id": 8, "event_type": "", "props": ""},
    "documents": {"doc_id": 8, "text": "", "lang": "10", "source": "", "n_chars": 8},
    "embeddings": {"vec_id": 8, "label": 4},
    "pages": {"page_id": 8, "url": "", "html": ""},
    "benchmark": {"item_id": 8, "text": ""},
    "labels": {"doc_id": 8, "quality": 4, "toxic": 4},
    "conversations": {"conv_id": 8, "turn": 8, "role": "10", "text": ""},
}


def _reductions(table: str, growth: int, bounds: str) -> str:
    two, four = (32768, -2147483647) if bounds == "compat" else (32767, -2147483648)
    parts = []
    for name, width in _COLUMNS[table].items():
        if isinstance(width, int):
            grown = f"CAST(max({name}) AS HUGEINT) * {100 + growth}"
            needed = f"""CASE WHEN {grown} <= 25500 AND min({name}) >= 0 THEN 1
              WHEN {grown} <= {two}00 AND min({name}) >= -32768 THEN 2
              WHEN {grown} <= 214748364700 AND min({name}) >= {four} THEN 4 ELSE 8 END"""
            average = "NULL"
        else:
            needed = f"max(length(rtrim({name})))"
            average = f"CAST(sum(length(rtrim({name}))) AS BIGINT) // nullif(count({name}), 0)"
        parts.append(
            f"SELECT '{table}' AS tab, '{name}' AS col, CAST({width or 'NULL'} AS BIGINT) - CAST({needed} AS BIGINT) AS red, "
            f"CAST({average} AS BIGINT) AS len, count(*) AS n FROM {{{table}}}"
        )
    return "\nUNION ALL ".join(parts)


def _space(table: str, growth: int = 10, divisor: int = 1048576, bounds: str = "exact") -> str:
    return f"""
WITH r AS ({_reductions(table, growth, bounds)})
SELECT col AS columnName, red AS byteReduction, CAST(red * n AS DOUBLE) / {divisor} AS estimatedSpaceSavings,
       len AS avgLength, red < 0 AS at_risk FROM r
UNION ALL
SELECT 'Total', NULL, CAST(sum(red * n) AS DOUBLE) / {divisor}, NULL, NULL FROM r"""


ORACLE["wasted_space_lineitem"] = _space("lineitem")
ORACLE["wasted_space_compat"] = _space("orders", 25, 1024, "compat")
ORACLE["wasted_space_all"] = f"""
WITH r AS ({" UNION ALL ".join(_reductions(table, 10, "exact") for table in _COLUMNS)})
SELECT tab AS tableName, col AS columnName, red AS byteReduction,
       CAST(red * n AS DOUBLE) / 1024 AS estimatedSpaceSavings, len AS avgLength, red < 0 AS at_risk FROM r
UNION ALL
SELECT tab, 'Total', NULL, CAST(sum(red * n) AS DOUBLE) / 1024, NULL, NULL FROM r GROUP BY tab
UNION ALL
SELECT 'Total', 'Total', NULL, CAST(sum(red * n) AS DOUBLE) / 1024, NULL, NULL FROM r"""


def _profile(table: str, columns: dict[str, str]) -> str:
    parts = []
    for name, kind in columns.items():
        if kind == "string":
            values = (
                f"NULL, NULL, max(length(rtrim({name}))), "
                f"CAST(sum(length(rtrim({name}))) AS BIGINT) // nullif(count({name}), 0)"
            )
        else:
            values = f"max({name}), min({name}), NULL, NULL"
        high, low, longest, average = values.split(", ", 3)
        parts.append(
            f"SELECT '{name}' AS \"column\", '{kind}' AS kind, CAST({high} AS BIGINT) AS \"max\", "
            f'CAST({low} AS BIGINT) AS "min", CAST({longest} AS BIGINT) AS max_len, '
            f"CAST({average} AS BIGINT) AS avg_len, count(*) AS row_count FROM {{{table}}}"
        )
    return "\nUNION ALL ".join(parts)


ORACLE["profile_strings"] = _profile("documents", dict.fromkeys(("text", "lang", "source"), "string"))
ORACLE["profile_lineitem"] = _profile(
    "lineitem",
    {
        "l_orderkey": "bigint",
        "l_partkey": "bigint",
        "l_suppkey": "bigint",
        "l_linenumber": "int",
        "l_returnflag": "string",
        "l_linestatus": "string",
    },
)

# Merged from the states of parts, both are those of the whole table.
ORACLE["profile_merged"] = ORACLE["profile_lineitem"]
ORACLE["wasted_space_merged"] = ORACLE["wasted_space_lineitem"]

ORACLE["split_documents"] = """
SELECT doc_id, CAST(generate_subscripts(parts, 1) AS INTEGER) AS pos, unnest(parts) AS stringValue
FROM (SELECT doc_id, list_filter(string_split(trim(text), ','), lambda x: length(trim(x)) > 0) AS parts
      FROM {documents})"""
ORACLE["split_words"] = """
SELECT lang, count(*) AS words, CAST(sum(length(word)) AS BIGINT) AS characters
FROM (SELECT lang, unnest(string_split(trim(text), ' ')) AS word FROM {documents})
WHERE length(trim(word)) > 0
GROUP BY lang"""
ORACLE["split_filter_list"] = """
SELECT * FROM {supplier}
WHERE s_name IN ('Supplier#000000003', 'Supplier#000000007', 'Supplier#000000042', 'nobody')"""


def _unsafe(column: str, delimiter: str = "|") -> str:
    holds = " OR ".join(f"contains({column}, {text})" for text in (f"'{delimiter}'", "chr(9)", "chr(10)", "chr(13)"))
    return f"(rtrim({column}) = '' OR {holds})"


ORACLE["export_sanitized"] = f"""
SELECT doc_id, CASE WHEN NOT {_unsafe("text")} THEN text END AS text,
       CASE WHEN NOT {_unsafe("lang")} THEN lang END AS lang,
       CASE WHEN {_unsafe("source")} THEN '~~~~' ELSE source END AS source, n_chars
FROM {{documents}}"""
ORACLE["export_delimited_files"] = """
SELECT c_custkey, CASE WHEN contains(c_name, '#') THEN '~~~~~' ELSE c_name END AS c_name, c_nationkey,
       CAST(c_acctbal AS DECIMAL(18, 2)) AS c_acctbal,
       CASE WHEN NOT contains(c_mktsegment, '#') THEN c_mktsegment END AS c_mktsegment
FROM {customer}"""
ORACLE["render_inserts_part"] = """
SELECT 'INSERT INTO mart.tmp_part ("p_partkey","p_name","p_brand","p_type","p_size","p_retailprice") VALUES ('
       || coalesce(CAST(p_partkey AS VARCHAR), 'NULL') || ','
       || coalesce('''' || replace(p_name, '''', '''''') || '''', 'NULL') || ','
       || coalesce('''' || replace(p_brand, '''', '''''') || '''', 'NULL') || ','
       || coalesce('''' || replace(p_type, '''', '''''') || '''', 'NULL') || ','
       || coalesce(CAST(p_size AS VARCHAR), 'NULL') || ','
       || coalesce(CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR), 'NULL') || ');' AS sql_statement
FROM {part}"""
ORACLE["render_inserts_events"] = """
SELECT 'INSERT INTO mart.tmp_events ("event_id","ts","user_id","event_type","value","props") VALUES ('
       || CAST(event_id AS VARCHAR) || ',''' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || ''','
       || CAST(user_id AS VARCHAR) || ',''' || event_type || ''',' || CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) || ',' || CASE WHEN event_type <> 'view' THEN '''' || replace(props, '''', '''''') || ''''
                                      ELSE 'NULL' END || ');' AS sql_statement
FROM {events}"""


def _target_type(compat: bool) -> str:
    unlimited = (
        ""
        if compat
        else """
    WHEN lower(type) IN ('nvarchar', 'nchar') AND length < 0 THEN 'CLOB CHARACTER SET UNICODE'
    WHEN lower(type) IN ('varchar', 'char') AND length < 0 THEN 'CLOB'
    WHEN lower(type) IN ('decimal', 'numeric') THEN type || '(' || precision || ',' || scale || ')'"""
    )
    return f"""CASE
    WHEN lower(type) = 'bit' THEN 'BYTEINT'
    WHEN lower(type) = 'tinyint' THEN 'SMALLINT'
    WHEN lower(type) = 'uniqueidentifier' THEN 'CHAR(38)'
    WHEN lower(type) = 'datetime' THEN 'TIMESTAMP(3)'
    WHEN lower(type) = 'money' THEN 'DECIMAL(18,4)'
    WHEN lower(type) = 'xml' THEN 'CLOB'
    WHEN lower(type) IN ('smalldatetime', 'datetime2') THEN 'TIMESTAMP(0)'{unlimited}
    WHEN lower(type) IN ('nvarchar', 'nchar')
        THEN substr(type, 2, 10) || '(' || (length // 2) || ') CHARACTER SET UNICODE NOT CASESPECIFIC'
    WHEN lower(type) IN ('varchar', 'char') THEN type || '(' || length || ')'
    ELSE type END"""


_NULL_CLAUSE = "CASE WHEN nullable THEN ' NULL' ELSE ' NOT NULL' END"

ORACLE["translated_types"] = f"""
SELECT server, database, "table", column_id, type, {_target_type(False)} AS target_type,
       {_NULL_CLAUSE} AS null_clause
FROM {{fleet_columns}}"""


def _ddl(target: str, compat: bool) -> str:
    return f"""
SELECT *, count(*) OVER (PARTITION BY target_table) AS same_target FROM (
SELECT server, database, "table", {target} AS target_table,
       'CREATE TABLE ' || {target} || '('
       || string_agg('"' || name || '" ' || {_target_type(compat)} || {_NULL_CLAUSE}, ',' ORDER BY column_id)
       || ');' AS ddl_statement,
       'DELETE FROM ' || {target} || ';' AS truncate_statement
FROM {{fleet_columns}}
GROUP BY server, database, "table")"""


ORACLE["ddl_from_catalog"] = _ddl("""'mart."' || server || '.' || database || '.' || "table" || '"'""", False)
ORACLE["ddl_compat"] = _ddl("""'mart.tmp_' || substr("table", strpos("table", '.') + 1, 26)""", True)

_LISTS = """
SELECT i.server, i.database_id, i.object_id, i.index_id,
       coalesce(string_agg(c.name, ', ' ORDER BY i.index_column_id) FILTER (WHERE NOT i.is_included_column), '') AS indexed_columns,
       coalesce(string_agg(c.name, ', ' ORDER BY i.index_column_id) FILTER (WHERE i.is_included_column), '') AS included_columns
FROM {index_columns} AS i JOIN {columns} AS c USING (server, database_id, object_id, column_id)
GROUP BY ALL"""
ORACLE["key_and_included_columns"] = _LISTS
ORACLE["index_inventory"] = f"""
WITH lists AS ({_LISTS}),
sizes AS (
    SELECT server, database_id, object_id, index_id, count(partition_number) AS partition_count,
           CAST(sum(rows) AS BIGINT) AS row_count
    FROM {{partitions}} GROUP BY ALL),
placed AS (
    SELECT s.server, s.database_id, s.data_space_id, s.name
    FROM {{partition_schemes}} AS s JOIN {{partition_functions}} AS f USING (server, database_id, function_id))
SELECT server, database_id, o.name AS table_name, coalesce(x.name, '') AS index_name, object_id, index_id,
       CASE index_id WHEN 0 THEN 'heap' WHEN 1 THEN 'clustered' ELSE 'nonclustered' END
       || CASE WHEN ignore_dup_key THEN ', ignore duplicate keys' ELSE '' END
       || CASE WHEN is_unique THEN ', unique' ELSE '' END
       || CASE WHEN is_primary_key THEN ', primary key' ELSE '' END AS index_description,
       coalesce(indexed_columns, '') AS indexed_columns, coalesce(included_columns, '') AS included_columns,
       coalesce(p.name, '') AS partition_scheme_name, partition_count, row_count
FROM {{indexes}} AS x
JOIN {{objects}} AS o USING (server, database_id, object_id)
JOIN sizes USING (server, database_id, object_id, index_id)
LEFT JOIN lists USING (server, database_id, object_id, index_id)
LEFT JOIN placed AS p USING (server, database_id, data_space_id)"""


def _definitions(where: str = "TRUE") -> str:
    return f"""
SELECT x.server AS serverName, d.name AS databaseName, coalesce(s.name, '') AS schemaName, o.name AS tableName, x.name AS indexName,
       x.type_desc AS indexType,
       coalesce(string_agg(c.name || CASE WHEN i.is_descending_key THEN ' DESC' ELSE '' END, ', '
                           ORDER BY i.key_ordinal, i.column_id)
                FILTER (WHERE NOT i.is_included_column AND i.key_ordinal > 0), '') AS indexKeys,
       coalesce(string_agg(c.name, ', ' ORDER BY i.column_id) FILTER (WHERE i.is_included_column), '') AS includedColumns,
       coalesce(string_agg(c.name, ', ' ORDER BY i.partition_ordinal, i.column_id)
                FILTER (WHERE i.partition_ordinal > 0), '') AS partitionKeys,
       x.is_primary_key AS isPrimaryKey, x.is_unique AS isUnique, x.is_unique_constraint AS isUniqueConstraint,
       x.has_filter AS isFilteredIndex, coalesce(x.filter_definition, '') AS filterDefinition
FROM {{indexes}} AS x
JOIN {{objects}} AS o USING (server, database_id, object_id)
JOIN {{databases}} AS d USING (server, database_id)
LEFT JOIN {{schemas}} AS s USING (server, database_id, schema_id)
JOIN {{index_columns}} AS i USING (server, database_id, object_id, index_id)
JOIN {{columns}} AS c USING (server, database_id, object_id, column_id)
WHERE {where}
GROUP BY ALL"""


ORACLE["index_definitions"] = _definitions()
ORACLE["index_definitions_table"] = _definitions("o.name = 'Supplier#000000005'")
ORACLE["index_definitions_fleet"] = _definitions("d.name NOT IN ('tempdb', 'master', 'msdb', 'model')")


def _drift() -> str:
    fields = (
        "indexType indexKeys includedColumns partitionKeys isPrimaryKey isUnique isUniqueConstraint "
        "isFilteredIndex filterDefinition"
    ).split()
    environment = {
        status: with_adapters(
            _definitions(), {"lineitem": f"SELECT * FROM lineitem WHERE l_linestatus = '{status}'"}
        )
        for status in ("F", "O")
    }
    differing = ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in fields)
    return f"""
WITH a AS ({environment["F"]}), b AS ({environment["O"]}),
compared AS (
    SELECT coalesce(a.serverName, b.serverName) AS serverName, coalesce(a.databaseName, b.databaseName) AS databaseName,
           coalesce(a.schemaName, b.schemaName) AS schemaName,
           CASE WHEN a.tableName IS NULL THEN b.tableName ELSE a.tableName END AS tableName,
           CASE WHEN a.tableName IS NULL THEN b.indexName ELSE a.indexName END AS indexName,
           CASE WHEN a.tableName IS NULL THEN 'added' WHEN b.tableName IS NULL THEN 'removed' ELSE 'changed' END AS change,
           CASE WHEN a.tableName IS NULL OR b.tableName IS NULL THEN ''
                ELSE concat_ws(', ', {differing}) END AS changed_fields
    FROM a FULL JOIN b ON a.serverName = b.serverName AND a.databaseName = b.databaseName
                      AND a.schemaName = b.schemaName AND a.tableName = b.tableName
                      AND coalesce(a.indexName, '') = coalesce(b.indexName, ''))
SELECT * FROM compared WHERE change <> 'changed' OR changed_fields <> ''"""


ORACLE["definition_drift"] = _drift()

_SIZES = """
SELECT server, database_id, object_id, index_id, CAST(sum(rows) AS BIGINT) AS row_count,
       count(partition_id) AS partition_count,
       CASE WHEN count(partition_id) > 1 THEN 'yes' ELSE 'no' END AS partitioned
FROM {partitions} GROUP BY ALL"""
ORACLE["partition_rollup"] = _SIZES

_DROP = """CASE WHEN x.type = 2 AND NOT x.is_unique
            THEN 'Drop Index ' || x.name || ' On ' || d.name || '.' || s.name || '.' || o.name || ';'
            WHEN x.type = 2 AND x.is_unique
            THEN 'Alter Table ' || d.name || '.' || s.name || '.' || o.name || ' Drop Constraint ' || x.name || ';'
            ELSE '' END AS SQL_DropStatement"""
_TYPE = "CASE WHEN x.is_unique THEN 'UNIQUE ' ELSE '' END || x.type_desc"


def _usage(where: str = "TRUE") -> str:
    return f"""
WITH sizes AS ({_SIZES})
SELECT d.name AS databaseName, o.name AS objectName, x.name AS indexName, {_TYPE} AS indexType,
       user_seeks, user_scans, user_lookups, user_seeks + user_scans + user_lookups AS total_seekScanLookup,
       user_updates, row_count AS rowCounts, {_DROP}
FROM {{indexes}} AS x
JOIN {{index_usage}} USING (server, database_id, object_id, index_id)
JOIN sizes USING (server, database_id, object_id, index_id)
JOIN {{objects}} AS o USING (server, database_id, object_id)
JOIN {{schemas}} AS s USING (server, database_id, schema_id)
JOIN {{databases}} AS d USING (server, database_id)
WHERE o.is_user_table AND d.name NOT IN ('master', 'msdb', 'tempdb', 'model') AND {where}"""


ORACLE["usage_report"] = _usage()
ORACLE["usage_report_filtered"] = _usage(
    f"{_TYPE} = 'UNIQUE NONCLUSTERED' AND row_count BETWEEN 60 AND 95 "
    "AND user_seeks + user_scans + user_lookups BETWEEN 65 AND 90"
)
ORACLE["usage_by_database"] = _usage(
    "d.name IN ('nation_4', 'nation_5', 'nation_6', 'nation_7', 'nation_9') AND d.state = 0 AND NOT d.is_read_only"
)
ORACLE["user_databases"] = """
SELECT * FROM {databases} WHERE state = 0 AND NOT is_read_only AND name NOT IN ('master', 'tempdb')"""


def _unused(join: str, max_reads: int) -> str:
    reads = "coalesce(user_seeks, 0) + coalesce(user_scans, 0) + coalesce(user_lookups, 0)"
    counters = ", ".join(
        f"coalesce({c}, 0) AS {c}" for c in ("user_seeks", "user_scans", "user_lookups", "user_updates")
    )
    drop = _DROP.replace("s.name", "o.schema_name")
    return f"""
WITH sizes AS ({_SIZES.replace("{partitions}", "{part_partitions}")})
SELECT o.name AS objectName, x.name AS indexName, {_TYPE} AS indexType, {counters},
       row_count, partitioned, {drop}
FROM {{part_indexes}} AS x
{join} JOIN {{part_usage}} USING (server, database_id, object_id, index_id)
JOIN sizes USING (server, database_id, object_id, index_id)
JOIN {{part_objects}} AS o USING (server, database_id, object_id)
JOIN {{databases}} AS d USING (server, database_id)
WHERE x.type = 2 AND NOT x.is_unique AND {reads} <= {max_reads}"""


ORACLE["unused_parts"] = _unused("", 0)
ORACLE["unused_parts_never_seen"] = _unused("LEFT", 1)

_MISSING = """
SELECT *, row_number() OVER (PARTITION BY server, database_id, affected_table
                             ORDER BY est_impact DESC, index_handle) AS "rank"
FROM (
    SELECT d.server, d.database_id, t.name AS affected_table, d.index_handle, d.statement, d.equality_columns,
           d.inequality_columns, d.included_columns, s.user_seeks, s.user_scans,
           CAST(trunc((s.user_seeks + s.user_scans) * s.avg_user_impact) AS BIGINT) AS est_impact, s.last_user_seek
    FROM {missing_groups} AS g
    JOIN {missing_group_stats} AS s ON s.server = g.server AND s.group_handle = g.index_group_handle
    JOIN {missing_details} AS d ON d.server = g.server AND d.index_handle = g.index_handle
    JOIN {nation_tables} AS t ON t.server = d.server AND t.database_id = d.database_id AND t.object_id = d.object_id)
WHERE est_impact > 100"""
ORACLE["missing_candidates"] = _MISSING
ORACLE["missing_candidates_top"] = f'SELECT * FROM ({_MISSING}) WHERE "rank" <= 3'
ORACLE["missing_statements"] = f"""
SELECT server, database_id, affected_table,
       'CREATE NONCLUSTERED INDEX IX_' || affected_table || '_missing_20240105_' || "rank" || ' ON ' || statement
       || ' (' || coalesce(equality_columns, '')
       || CASE WHEN equality_columns IS NOT NULL AND inequality_columns IS NOT NULL THEN ',' ELSE '' END
       || coalesce(inequality_columns, '') || ')'
       || CASE WHEN included_columns IS NULL THEN ';' ELSE ' INCLUDE (' || included_columns || ');' END AS sql_statement,
       user_seeks, user_scans, est_impact, last_user_seek
FROM ({_MISSING})"""

_HOT = """
SELECT server, plan_handle, CAST(sum(execution_count) AS BIGINT) AS statement_executions
FROM {query_stats}
WHERE last_execution_time > TIMESTAMP '2024-01-11 00:00:00'
GROUP BY server, plan_handle
HAVING sum(execution_count) > 25"""
ORACLE["hot_plans"] = _HOT
_FOUND = f"""
SELECT p.server, p.database_id, p.object_id, p.plan_handle, p.query_plan, h.statement_executions
FROM {{query_plans}} AS p JOIN ({_HOT}) AS h USING (server, plan_handle)
WHERE p.object_id IS NOT NULL AND p.query_plan LIKE '%<MissingIndex Database=%' AND p.query_plan LIKE '%</ShowPlanXML>'"""
ORACLE["plan_log_missing"] = _FOUND
ORACLE["missing_plan_log"] = f"""
SELECT f.server, d.name AS databaseName, f.database_id AS databaseID, o.name AS objectName,
       f.object_id AS objectID, f.query_plan, TIMESTAMP '2024-01-31 00:00:00' AS executionDate,
       f.statement_executions AS statementExecutions
FROM ({_FOUND}) AS f
JOIN {{objects}} AS o USING (server, database_id, object_id)
JOIN {{databases}} AS d USING (server, database_id)"""

_CANDIDATES = """
SELECT p.server, p.database_id, p.object_id, p.index_id, p.partition_number, o.range_scan_count,
       sum(p.avg_fragmentation_in_percent) AS fragmentation, CAST(sum(p.page_count) AS BIGINT) AS page_count
FROM {index_physical} AS p
JOIN {index_operational} AS o USING (server, database_id, object_id, index_id, partition_number)
WHERE p.avg_fragmentation_in_percent >= 10 AND p.page_count > 8 AND p.index_level = 0 AND p.index_id > 0
GROUP BY ALL"""
_NOT_LATEST = """(server, database_id, object_id, index_id, partition_number) NOT IN (
    SELECT (server, database_id, object_id, index_id, max(partition_number)) FROM {partitions}
    WHERE partition_number > 1 AND rows > 0 GROUP BY server, database_id, object_id, index_id)"""
ORACLE["maintenance_candidates"] = _CANDIDATES
ORACLE["maintenance_without_latest"] = f"SELECT * FROM ({_CANDIDATES}) AS u WHERE {_NOT_LATEST}"
# 7 January 2024 is a Sunday: bit 1.
_MASKED = """
SELECT u.*, coalesce(e.exclusionMask, 0) AS exclusionMask
FROM ({units}) AS u LEFT JOIN {exclusions} AS e USING (server, database_id, object_id, index_id)
WHERE coalesce(e.exclusionMask, 0) % 2 = 0"""
ORACLE["maintenance_calendar"] = _MASKED.replace("{units}", _CANDIDATES)
ORACLE["maintenance_pending"] = """
SELECT server, database_id, object_id, index_id, partition_number, page_count, printStatus
FROM {maintenance_status}
WHERE defragDate IS NULL AND NOT printStatus AND page_count >= 9 AND page_count <= 14"""
ORACLE["maintenance_queue"] = f"""
SELECT *, row_number() OVER (ORDER BY page_count DESC, server, database_id, object_id, index_id, partition_number) AS priority
FROM ({_CANDIDATES})"""


def _decided(units: str) -> str:
    return f"""
SELECT f.*, CASE
    WHEN (fragmentation < 50 OR has_lob OR partition_count > 1) AND NOT page_locks_off THEN 'REORGANIZE'
    WHEN (fragmentation >= 50 OR page_locks_off) AND NOT has_lob AND partition_count <= 1 THEN 'REBUILD'
    ELSE 'SKIP' END AS action
FROM (
    SELECT u.*,
           (SELECT count(*) FROM {{partitions}} AS p WHERE p.server = u.server AND p.database_id = u.database_id
                AND p.object_id = u.object_id AND p.index_id = u.index_id) AS partition_count,
           EXISTS (SELECT 1 FROM {{columns}} AS c WHERE c.server = u.server AND c.database_id = u.database_id
                AND c.object_id = u.object_id AND (c.system_type_id IN (34, 35, 99) OR c.max_length = -1)) AS has_lob,
           EXISTS (SELECT 1 FROM {{indexes}} AS x WHERE x.server = u.server AND x.database_id = u.database_id
                AND x.object_id = u.object_id AND x.index_id = u.index_id AND NOT x.allow_page_locks) AS page_locks_off
    FROM ({units}) AS u) AS f"""


def _quoted(name: str) -> str:
    return f"'[' || replace({name}, ']', ']]') || ']'"


def _commands(units: str) -> str:
    return f"""
SELECT *, CASE action
    WHEN 'REORGANIZE' THEN 'ALTER INDEX ' || indexName || ' ON ' || databaseName || '.' || schemaName || '.' || objectName
        || ' REORGANIZE' || CASE WHEN partition_count > 1 THEN ' PARTITION = ' || partition_number ELSE '' END
    WHEN 'REBUILD' THEN 'ALTER INDEX ' || indexName || ' ON ' || databaseName || '.' || schemaName || '.' || objectName
        || ' REBUILD WITH (ONLINE = Off, SORT_IN_TEMPDB = ON)' END AS sql_statement
FROM (
    SELECT a.*, {_quoted("d.name")} AS databaseName, {_quoted("s.name")} AS schemaName,
           {_quoted("o.name")} AS objectName, {_quoted("x.name")} AS indexName
    FROM ({units}) AS a
    LEFT JOIN {{objects}} AS o USING (server, database_id, object_id)
    LEFT JOIN {{schemas}} AS s USING (server, database_id, schema_id)
    LEFT JOIN {{indexes}} AS x USING (server, database_id, object_id, index_id)
    LEFT JOIN {{databases}} AS d USING (server, database_id))"""


ORACLE["maintenance_actions"] = _commands(_decided(_CANDIDATES))
# A run of 20 minutes: units take three seconds a page, a minute where not measured, and a pause.
_RUN = _decided(f"SELECT * FROM ({_MASKED.replace('{units}', _CANDIDATES)}) WHERE page_count BETWEEN 8 AND 14")
_UNIT_ORDER = "server, database_id, object_id, index_id, partition_number"
ORACLE["maintenance_run"] = _commands(f"""
SELECT * FROM (
    SELECT *, row_number() OVER w AS priority,
           CAST(coalesce(sum(est_seconds + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
               AS seconds_before
    FROM (
        SELECT *, CASE WHEN index_id % 2 = 1 THEN page_count * 3 ELSE 60 END AS est_seconds
        FROM ({_RUN}) WHERE action <> 'SKIP')
    WINDOW w AS (ORDER BY range_scan_count DESC, {_UNIT_ORDER}))
WHERE seconds_before < 1200""")
# Runs 1 and 2 print 20 units each, run 3 works on all, run 4 starts over; the last scan's status is left.
_WORK = _decided(_CANDIDATES)
ORACLE["maintenance_cycle"] = f"""
WITH work AS (
    SELECT *, row_number() OVER (ORDER BY range_scan_count DESC, {_UNIT_ORDER}) AS place
    FROM ({_WORK}) WHERE action <> 'SKIP'),
runs(run_id, low, high, logged) AS (
    VALUES ('run1', 0, 20, FALSE), ('run2', 20, 40, FALSE), ('run3', 0, 1000000000, TRUE), ('run4', 0, 20, FALSE))
SELECT run_id, {_UNIT_ORDER}, place - low AS priority, action,
       CASE WHEN logged THEN CASE WHEN object_id % 7 = 3 THEN 'FAILED' ELSE 'DONE' END END AS status,
       CASE WHEN logged THEN CASE WHEN object_id % 7 = 3 THEN -1 ELSE page_count END END AS durationSeconds,
       CASE WHEN logged AND object_id % 7 = 3 THEN 'deadlock' END AS errorMessage,
       place <= 20 AS printStatus, FALSE AS done
FROM work JOIN runs ON place > low AND place <= high"""
ORACLE["maintenance_plan"] = f"""
SELECT *, row_number() OVER (ORDER BY range_scan_count DESC, server, database_id, object_id, index_id, partition_number) AS priority
FROM ({_decided(_MASKED.replace("{units}", ORACLE["maintenance_without_latest"]))})"""
ORACLE["maintenance_budget"] = """
SELECT l_suppkey, l_linenumber, size, "position", seconds_before
FROM (
    SELECT *, row_number() OVER w AS "position",
           CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seconds_before
    FROM (SELECT l_suppkey, l_linenumber, count(*) AS size FROM {lineitem} GROUP BY ALL)
    WINDOW w AS (ORDER BY size DESC, l_suppkey, l_linenumber))
WHERE seconds_before < 5000"""
ORACLE["maintenance_budget_by_database"] = f"""
SELECT * FROM (
    SELECT *, row_number() OVER w AS "position",
           CAST(coalesce(sum(page_count + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
               AS seconds_before
    FROM ({_CANDIDATES})
    WINDOW w AS (PARTITION BY server, database_id ORDER BY fragmentation DESC, object_id, index_id, partition_number))
WHERE seconds_before < 300"""

_UNIT = "run_id, server, database_id, object_id, index_id, partition_number"
_ATTEMPTS = f"""
SELECT s.run_id, s.server, s.database_id, s.object_id, s.index_id, s.partition_number,
       CASE WHEN e.event IS NULL THEN 'RUNNING' WHEN e.event = 'finished' THEN 'DONE' ELSE 'FAILED' END AS status,
       s.event_ts AS dateTimeStart, e.event_ts AS dateTimeEnd,
       CASE WHEN e.event = 'failed' THEN -1 ELSE date_diff('second', s.event_ts, e.event_ts) END AS durationSeconds,
       e.error_message AS errorMessage,
       s.databaseName, s.objectName, s.indexName, s.fragmentation, s.page_count, s.sql_statement
FROM (SELECT * FROM {{maintenance_log}} WHERE event = 'started') AS s
LEFT JOIN (SELECT * FROM {{maintenance_log}} WHERE event <> 'started') AS e USING ({_UNIT})"""
ORACLE["maintenance_log_summary"] = (
    f"SELECT * FROM ({_ATTEMPTS}) WHERE dateTimeEnd >= TIMESTAMP '2024-01-10 00:00:00'"
)
ORACLE["maintenance_estimates"] = f"""
SELECT server, database_id, object_id, index_id, partition_number, durationSeconds AS est_seconds
FROM ({_ATTEMPTS}) WHERE status = 'DONE'"""
ORACLE["maintenance_retry"] = f"""
SELECT server, database_id, object_id, index_id, partition_number, errorMessage
FROM ({_ATTEMPTS}) WHERE status = 'FAILED'"""
ORACLE["layout_stats"] = """
SELECT o_orderstatus AS status, CAST(6 AS BIGINT) AS page_count, CAST(100 AS DOUBLE) AS fragmentation, TRUE AS has_bytes
FROM {orders} GROUP BY o_orderstatus"""
ORACLE["compaction"] = """
SELECT o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN '001' WHEN 'O' THEN '1.50' ELSE '0' END AS code,
       count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
       CAST(sum(o_custkey) AS BIGINT) AS customer_sum, TRUE AS fewer_files
FROM {orders} GROUP BY o_orderstatus"""
ORACLE["compaction_plan"] = """
SELECT 'r1' AS run_id, o_orderstatus AS status, CAST(6 AS BIGINT) AS page_count, CAST(100 AS DOUBLE) AS fragmentation,
       row_number() OVER (ORDER BY o_orderstatus) AS priority, 'DONE' AS state, CAST(NULL AS VARCHAR) AS errorMessage
FROM {orders} GROUP BY o_orderstatus"""

_SUMMARY = """
SELECT server, job_id, success, cancel, fail, retry, last_execution_id,
       lpad(CAST(d // 10000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(d // 100 % 100 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST(d % 100 AS VARCHAR), 2, '0') AS last_duration,
       make_timestamp(y // 10000, y // 100 % 100, y % 100, t // 10000, t // 100 % 100, CAST(t % 100 AS DOUBLE))
           AS last_execution_start
FROM (
    SELECT s.*, h.run_duration AS d, h.run_date AS y, h.run_time AS t
    FROM (
        SELECT server, job_id,
               count(*) FILTER (WHERE run_status = 1 AND step_id = 0) AS success,
               count(*) FILTER (WHERE run_status = 3 AND step_id = 0) AS cancel,
               count(*) FILTER (WHERE run_status = 0 AND step_id = 0) AS fail,
               count(*) FILTER (WHERE run_status = 2) AS retry,
               max(instance_id) FILTER (WHERE step_id = 0) AS last_execution_id
        FROM {job_history} GROUP BY server, job_id) AS s
    LEFT JOIN {job_history} AS h
      ON h.server = s.server AND h.job_id = s.job_id AND h.instance_id = s.last_execution_id)"""
ORACLE["job_run_summary"] = _SUMMARY
ORACLE["job_last_start"] = f"SELECT job_id, last_execution_id, last_execution_start FROM ({_SUMMARY})"


def _days(mask: str) -> str:
    names = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()
    tests = ", ".join(f"CASE WHEN {mask} & {1 << bit} <> 0 THEN '{name}' END" for bit, name in enumerate(names))
    return f"nullif(concat_ws(', ', {tests}), '')"


ORACLE["weekday_masks"] = f"""
SELECT event_id, mask, {_days("mask")} AS days
FROM (SELECT event_id, CAST(event_id % 128 AS INTEGER) AS mask FROM {{events}})"""


def _every(unit: str) -> str:
    factor = "freq_recurrence_factor"
    one = {"weeks": "weekly", "months": "monthly"}[unit]
    return f"CASE WHEN {factor} = 1 THEN '; {one}' WHEN {factor} <> 0 THEN '; every ' || {factor} || ' {unit}' END"


def _decoded(job_schedules: str) -> str:
    padded = "lpad(CAST({} AS VARCHAR), 6, '0')"
    return f"""
SELECT s.server, s.name AS scheduleName, schedule_id, j.job_id,
       CASE freq_type
         WHEN 1 THEN 'Once'
         WHEN 4 THEN CASE WHEN freq_interval = 1 THEN 'Daily' ELSE 'Every ' || freq_interval || ' days' END
         WHEN 8 THEN {_days("freq_interval")} || {_every("weeks")}
         WHEN 16 THEN 'On day ' || freq_interval || ' of every ' || freq_recurrence_factor || ' months'
         WHEN 32 THEN CASE freq_relative_interval WHEN 1 THEN 'First' WHEN 2 THEN 'Second' WHEN 4 THEN 'Third'
                                                  WHEN 8 THEN 'Fourth' WHEN 16 THEN 'Last' END
             || CASE freq_interval WHEN 1 THEN ' Sunday' WHEN 2 THEN ' Monday' WHEN 3 THEN ' Tuesday'
                                   WHEN 4 THEN ' Wednesday' WHEN 5 THEN ' Thursday' WHEN 6 THEN ' Friday'
                                   WHEN 7 THEN ' Saturday' WHEN 8 THEN ' Day' WHEN 9 THEN ' Weekday'
                                   WHEN 10 THEN ' Weekend' END
             || {_every("months")}
         WHEN 64 THEN 'StartUp'
         WHEN 128 THEN 'Idle' END AS frequency,
       coalesce('Every ' || freq_subday_interval
           || CASE freq_subday_type WHEN 2 THEN ' seconds' WHEN 4 THEN ' minutes' WHEN 8 THEN ' hours' END, 'Once')
           AS subFrequency,
       {padded.format("active_start_time")} AS startTime, {padded.format("active_end_time")} AS endTime,
       {padded.format("next_run_time")} AS nextRunTime, CAST(next_run_date AS VARCHAR) AS nextRunDate
FROM {{schedules}} AS s JOIN {job_schedules} AS j USING (server, schedule_id)
WHERE enabled = 1"""


ORACLE["schedule_text"] = _decoded(
    "(SELECT server, schedule_id, CAST(schedule_id AS VARCHAR) AS job_id, 20240201 AS next_run_date, "
    "active_start_time AS next_run_time FROM {schedules})"
)
ORACLE["job_status_report"] = f"""
SELECT j.server AS serverName, j.job_id AS jobID, j.name AS jobName, 'Enabled' AS jobStatus,
       coalesce(scheduleName, '(unscheduled)') AS scheduleName, coalesce(frequency, '') AS frequency,
       coalesce(subFrequency, '') AS subFrequency,
       coalesce(startTime[1:2] || ':' || startTime[3:4] || ' - ' || endTime[1:2] || ':' || endTime[3:4], '') AS scheduleTime,
       coalesce(nextRunDate[1:4] || '/' || nextRunDate[5:6] || '/' || nextRunDate[7:8] || ' '
           || nextRunTime[1:2] || ':' || nextRunTime[3:4], '') AS nextRunDate,
       coalesce(success, 0) AS success, coalesce(cancel, 0) AS cancel, coalesce(fail, 0) AS fail,
       coalesce(retry, 0) AS retry, coalesce(last_execution_id, 0) AS lastExecutionID,
       last_execution_start AS lastExecutionStart, coalesce(last_duration, '00:00:01') AS lastDuration,
       'EXECUTE msdb.dbo.sp_update_job @job_id = ''' || j.job_id || ''', @enabled = 0;' AS disableSQLScript
FROM {{jobs}} AS j
LEFT JOIN ({_decoded("{job_schedules}")}) AS s ON s.server = j.server AND s.job_id = j.job_id
LEFT JOIN ({_SUMMARY}) AS h ON h.server = j.server AND h.job_id = j.job_id
WHERE j.enabled = 1"""
ORACLE["recent_jobs"] = f"""
SELECT jobID, lastExecutionID, lastExecutionStart
FROM ({ORACLE["job_status_report"]}) WHERE lastExecutionStart >= TIMESTAMP '2024-01-30 00:00:00'"""

_HOPS = """date_diff('second', post_ts, distributor_ts) AS distributor_latency, subscriber, subscriber_db,
       date_diff('second', distributor_ts, subscriber_ts) AS subscriber_latency,
       date_diff('second', post_ts, subscriber_ts) AS overall_latency"""
_LATENCY = f"""
SELECT server, publication, iteration, tracer_id, {_HOPS}
FROM (SELECT *, row_number() OVER (PARTITION BY server, publication ORDER BY post_ts, tracer_id) AS iteration FROM {{posts}})
LEFT JOIN {{receipts}} USING (server, publication, tracer_id)"""
_NORMAL = """coalesce(distributor_latency, 0) AS distributor_latency, subscriber, subscriber_db,
       coalesce(subscriber_latency, 0) AS subscriber_latency,
       coalesce(overall_latency, coalesce(distributor_latency, 0) + coalesce(subscriber_latency, 0)) AS overall_latency"""
ORACLE["token_latency"] = _LATENCY
ORACLE["latency_batch"] = f"SELECT server, publication, iteration, tracer_id, {_NORMAL} FROM ({_LATENCY})"
ORACLE["latency_history"] = f"""
SELECT run.moment AS monitorDate, server, publication AS publicationName, 'publisher' AS publicationDB, iteration, tracer_id, {_NORMAL}
FROM ({_LATENCY})
CROSS JOIN (VALUES (TIMESTAMP '2024-02-01 12:00:00'), (TIMESTAMP '2024-02-02 12:00:00')) AS run(moment)"""
ORACLE["latency_purge"] = """
SELECT * FROM (
    SELECT time_bucket(INTERVAL 6 HOURS, post_ts, TIMESTAMP '2024-01-01 00:00:00') AS monitorDate, publication, tracer_id
    FROM {posts})
WHERE monitorDate >= TIMESTAMP '2024-01-15 12:00:00'"""
ORACLE["latency_stream"] = f"""
SELECT server, publication, tracer_id, post_ts, {_HOPS}
FROM {{posts}} LEFT JOIN {{receipts}} USING (server, publication, tracer_id)"""

# Every token once for each subscription; a publication without one keeps a single row.
_BY_SUBSCRIPTION = f"""
SELECT server, publication, iteration, tracer_id, post_ts, {_HOPS}
FROM (
    SELECT server, publication, tracer_id, post_ts,
           row_number() OVER (PARTITION BY server, publication ORDER BY post_ts, tracer_id) AS iteration FROM {{posts}})
LEFT JOIN {{subscriptions}} USING (server, publication)
LEFT JOIN (SELECT server, publication, tracer_id, subscriber, subscriber_db, distributor_ts, subscriber_ts FROM {{deliveries}})
    USING (server, publication, tracer_id, subscriber, subscriber_db)"""
ORACLE["subscription_latency"] = f"SELECT * EXCLUDE (post_ts) FROM ({_BY_SUBSCRIPTION})"
ORACLE["subscription_stream"] = _BY_SUBSCRIPTION
_REPORT = """server, publication, subscriber, subscriber_db, count(*) AS tokens,
       count(*) - count(overall_latency) AS undelivered, CAST(sum(overall_latency) AS BIGINT) AS total_latency,
       max(overall_latency) AS max_latency"""
ORACLE["latency_windows_stream"] = f"""
SELECT from_ts, from_ts + INTERVAL 6 HOURS AS to_ts, {_REPORT}
FROM (
    SELECT *, time_bucket(INTERVAL 3 HOURS, post_ts, TIMESTAMP '2024-01-01 00:00:00') - INTERVAL 3 HOURS * back AS from_ts
    FROM ({_BY_SUBSCRIPTION}), (VALUES (0), (1)) AS v(back))
GROUP BY ALL"""
ORACLE["latency_sessions"] = f"""
SELECT min(post_ts) AS from_ts, max(post_ts) + INTERVAL 15 MINUTES AS to_ts, {_REPORT}
FROM (
    SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY server, publication, subscriber, subscriber_db
                                             ORDER BY post_ts, tracer_id) AS no
    FROM (
        SELECT *, coalesce(post_ts >= lag(post_ts) OVER (PARTITION BY server, publication, subscriber, subscriber_db
                                                        ORDER BY post_ts, tracer_id) + INTERVAL 15 MINUTES, TRUE) AS begins
        FROM ({_BY_SUBSCRIPTION})))
GROUP BY server, publication, subscriber, subscriber_db, no"""

ORACLE["latency_purge_hour"] = """
SELECT server, publication AS publicationName, tracer_id, post_ts AS monitorDate
FROM {posts} WHERE post_ts >= TIMESTAMP '2024-01-15 12:37:20'"""

# Counted from the rows themselves, not from snapshots.
_IN_PERIOD = "l_shipdate > TIMESTAMP '1995-05-31 12:00:00'"
_PERIOD = f"""
SELECT CASE WHEN l_partkey % 25 < 13 THEN 'east' ELSE 'west' END AS server, CAST(l_partkey % 25 AS INT) AS database_id,
       l_partkey AS object_id, 2 AS index_id,
       count(*) FILTER ({_IN_PERIOD} AND l_returnflag = 'R') AS user_seeks,
       count(*) FILTER ({_IN_PERIOD} AND l_returnflag = 'A') AS user_scans,
       count(*) FILTER ({_IN_PERIOD} AND l_returnflag = 'N') AS user_lookups,
       count(*) FILTER ({_IN_PERIOD}) AS user_updates,
       TIMESTAMP '1995-05-31 12:00:00' AS stats_since,
       count(DISTINCT CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 1 WHEN l_shipdate < TIMESTAMP '1999-07-01' THEN 2
                           ELSE 3 END) - 1 AS resets
FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '2001-02-28 12:00:00' GROUP BY l_partkey"""
ORACLE["usage_between_resets"] = _PERIOD
ORACLE["unused_between_resets"] = (
    _unused("", 12).replace("{part_usage}", f"({_PERIOD}) AS u").replace("partitioned,", "partitioned, stats_since,")
)

_ADVICE = """
SELECT p.server, p.plan_handle, object_id, statement_executions, suggestion, impact, '[db]' AS database, '[dbo]' AS schema,
       "table", equality_columns, inequality_columns, included_columns
FROM {advice_plans} AS p
JOIN ({hot}) AS h ON h.server = p.server AND h.plan_handle = p.plan_handle
JOIN (
    SELECT doc_id AS plan_handle, 0 AS suggestion, CAST(doc_id % 90 + 10.5 AS DOUBLE) AS impact,
           '[t' || doc_id % 20 || ']' AS "table", '[a' || doc_id % 3 || '],[b]' AS equality_columns,
           CAST(NULL AS VARCHAR) AS inequality_columns, CASE WHEN doc_id % 2 = 0 THEN '[c]' END AS included_columns
    FROM {documents} WHERE doc_id % 4 < 3
    UNION ALL SELECT doc_id, 1000, 50.25, '[u]', NULL, '[d]', NULL FROM {documents} WHERE doc_id % 4 = 1
    UNION ALL SELECT doc_id, 1001, 50.25, '[v]', '[e]', NULL, NULL FROM {documents} WHERE doc_id % 4 = 1) AS s
  ON s.plan_handle = p.plan_handle
WHERE object_id IS NOT NULL AND p.plan_handle % 50 <> 7""".replace("{hot}", ORACLE["hot_plans"])
ORACLE["plan_suggestions"] = _ADVICE
ORACLE["suggested_indexes"] = f"""
SELECT server, database, schema, "table", equality_columns, inequality_columns, included_columns,
       count(DISTINCT plan_handle) AS plans, CAST(sum(statement_executions) AS BIGINT) AS executions,
       sum(impact * statement_executions) AS est_impact
FROM ({_ADVICE}) GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {name: text if name == "definition_drift" else with_adapters(text) for name, text in ORACLE.items()}
