"""Operational snapshots derived from the test tables.

Each adapter is one SQL expression that Spark and DuckDB both run, so a query
and its oracle start from the same rows.  ``{table}`` stands for a test table
or for another adapter.  Every adapter reads its whole table.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_SCOPE = """CASE WHEN {key} % 25 < 13 THEN 'east' ELSE 'west' END AS server,
       CAST({key} % 25 AS INT) AS database_id"""


def _scope(key: str) -> str:
    return _SCOPE.replace("{key}", key)


_LINE_INDEX = f"""{_scope("l_suppkey")},
       l_suppkey AS object_id, l_linenumber - 1 AS index_id"""

ADAPTERS = {
    "databases": f"""
SELECT {_scope("n_nationkey")},
       CASE n_nationkey WHEN 0 THEN 'master' WHEN 1 THEN 'tempdb' WHEN 2 THEN 'model'
            WHEN 3 THEN 'msdb' ELSE lower(n_name) END AS name,
       CASE WHEN n_nationkey = 9 THEN 6 ELSE 0 END AS state,
       (n_nationkey = 7) AS is_read_only
FROM {{nation}}""",
    "schemas": f"""
SELECT DISTINCT {_scope("s_suppkey")}, CAST(s_suppkey % 3 AS INT) AS schema_id,
       CASE s_suppkey % 3 WHEN 0 THEN 'dbo' WHEN 1 THEN 'sales' ELSE 'od]d' END AS name
FROM {{supplier}}""",
    "objects": f"""
SELECT {_scope("s_suppkey")}, s_suppkey AS object_id, CAST(s_suppkey % 3 AS INT) AS schema_id,
       s_name AS name, (s_suppkey % 11 <> 10) AS is_user_table
FROM {{supplier}}""",
    "indexes": f"""
SELECT server, database_id, object_id, index_id,
       CASE WHEN index_id > 0 THEN 'ix_' || CAST(object_id AS STRING) || '_' || CAST(index_id AS STRING) END AS name,
       CASE WHEN index_id < 2 THEN index_id ELSE 2 END AS type,
       CASE index_id WHEN 0 THEN 'HEAP' WHEN 1 THEN 'CLUSTERED' ELSE 'NONCLUSTERED' END AS type_desc,
       ((object_id + index_id) % 3 = 0) AS is_unique,
       (index_id = 1) AS is_primary_key,
       ((object_id + index_id) % 6 = 0) AS is_unique_constraint,
       (object_id % 7 = 0) AS ignore_dup_key,
       (object_id * index_id % 5 = 4) AS has_filter,
       CASE WHEN object_id * index_id % 5 = 4 THEN '([c' || CAST(index_id AS STRING) || ']>(0))' END AS filter_definition,
       (object_id % 4 <> 0) AS allow_page_locks,
       CAST(object_id % 10 AS INT) AS data_space_id
FROM (SELECT DISTINCT {_LINE_INDEX} FROM {{lineitem}}) AS keys""",
    "partitions": f"""
SELECT {_LINE_INDEX},
       CAST(year(l_shipdate) - 1994 AS INT) AS partition_number,
       l_suppkey * 1000 + (l_linenumber - 1) * 100 + CAST(year(l_shipdate) - 1994 AS BIGINT) AS partition_id,
       count(*) AS rows
FROM {{lineitem}}
GROUP BY l_suppkey, l_linenumber, year(l_shipdate)""",
    "index_physical": f"""
SELECT {_LINE_INDEX},
       CAST(year(l_shipdate) - 1994 AS INT) AS partition_number, 0 AS index_level,
       CAST(100 * count(CASE WHEN l_discount >= 0.05 THEN 1 END) AS DOUBLE) / CAST(count(*) AS DOUBLE)
           AS avg_fragmentation_in_percent,
       count(*) AS page_count
FROM {{lineitem}}
GROUP BY l_suppkey, l_linenumber, year(l_shipdate)""",
    "index_operational": f"""
SELECT {_LINE_INDEX},
       CAST(year(l_shipdate) - 1994 AS INT) AS partition_number,
       count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS range_scan_count
FROM {{lineitem}}
GROUP BY l_suppkey, l_linenumber, year(l_shipdate)""",
    "index_columns": f"""
SELECT {_LINE_INDEX},
       CAST(l_partkey % 10 + 1 AS INT) AS column_id,
       CAST(l_partkey % 10 + 1 AS INT) AS index_column_id,
       CAST(min(l_partkey) % 7 AS INT) AS key_ordinal,
       CASE WHEN l_partkey % 10 = 2 THEN 1 ELSE 0 END AS partition_ordinal,
       (min(l_partkey) % 7 = 0) AS is_included_column,
       (min(l_partkey) % 2 = 1) AS is_descending_key
FROM {{lineitem}}
GROUP BY l_suppkey, l_linenumber, l_partkey % 10""",
    "columns": f"""
SELECT {_scope("l_suppkey")}, l_suppkey AS object_id,
       CAST(l_partkey % 10 + 1 AS INT) AS column_id,
       'c' || CAST(l_partkey % 10 + 1 AS STRING) AS name,
       CASE WHEN (l_suppkey + l_partkey % 10) % 37 = 0 THEN 35 ELSE 56 END AS system_type_id,
       CASE WHEN l_suppkey * (l_partkey % 10) % 41 = 40 THEN -1 ELSE 4 END AS max_length
FROM {{lineitem}}
GROUP BY l_suppkey, l_partkey % 10""",
    "partition_schemes": f"""
SELECT DISTINCT {_scope("s_suppkey")}, CAST(s_suppkey % 5 AS INT) AS data_space_id,
       CAST(s_suppkey % 5 AS INT) + 100 AS function_id,
       'scheme_' || CAST(s_suppkey % 5 AS STRING) AS name
FROM {{supplier}}""",
    "partition_functions": f"""
SELECT {_scope("s_suppkey % 25")}, CAST(s_suppkey % 5 AS INT) + 100 AS function_id,
       'function_' || CAST(s_suppkey % 5 AS STRING) AS name
FROM {{supplier}}
GROUP BY s_suppkey % 25, s_suppkey % 5
HAVING min(s_acctbal) < 9000""",
    "index_usage": f"""
SELECT {_LINE_INDEX},
       count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS user_seeks,
       count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS user_scans,
       count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS user_lookups,
       count(*) AS user_updates
FROM {{lineitem}}
GROUP BY l_suppkey, l_linenumber""",
    "exclusions": f"""
SELECT {_scope("s_suppkey")}, s_suppkey AS object_id, CAST(s_suppkey % 7 AS INT) AS index_id,
       CAST(s_suppkey % 128 AS INT) AS exclusionMask
FROM {{supplier}}""",
    "maintenance_status": """
SELECT server, database_id, object_id, index_id, partition_number, page_count,
       CASE WHEN object_id % 3 = 0 THEN TIMESTAMP '2024-01-05 03:00:00' END AS defragDate,
       (object_id % 2 = 0) AS printStatus
FROM {index_physical}""",
    "part_objects": f"""
SELECT {_scope("p_partkey")}, p_partkey AS object_id, 0 AS schema_id,
       p_name || ' ' || CAST(p_partkey AS STRING) AS name, TRUE AS is_user_table, 'dbo' AS schema_name
FROM {{part}}""",
    "part_indexes": f"""
SELECT {_scope("p_partkey")}, p_partkey AS object_id, 2 AS index_id,
       'ix_' || CAST(p_partkey AS STRING) AS name, CASE WHEN p_size % 5 = 4 THEN 1 ELSE 2 END AS type,
       'NONCLUSTERED' AS type_desc, (p_size % 7 = 6) AS is_unique
FROM {{part}}""",
    "part_usage": f"""
SELECT {_scope("l_partkey")}, l_partkey AS object_id, 2 AS index_id,
       count(CASE WHEN l_shipdate >= TIMESTAMP '2001-06-01 00:00:00' AND l_returnflag = 'R' THEN 1 END) AS user_seeks,
       count(CASE WHEN l_shipdate >= TIMESTAMP '2001-06-01 00:00:00' AND l_returnflag = 'A' THEN 1 END) AS user_scans,
       count(CASE WHEN l_shipdate >= TIMESTAMP '2001-06-01 00:00:00' AND l_returnflag = 'N' THEN 1 END) AS user_lookups,
       count(*) AS user_updates
FROM {{lineitem}}
GROUP BY l_partkey
HAVING max(l_shipdate) >= TIMESTAMP '2000-06-01 00:00:00'""",
    "usage_snapshots": f"""
SELECT server, database_id, object_id, 2 AS index_id, snapshot_ts, stats_since,
       CAST(sum(seeks) OVER w AS BIGINT) AS user_seeks, CAST(sum(scans) OVER w AS BIGINT) AS user_scans,
       CAST(sum(lookups) OVER w AS BIGINT) AS user_lookups, CAST(sum(updates) OVER w AS BIGINT) AS user_updates
FROM (
    SELECT {_scope("l_partkey")}, l_partkey AS object_id, max(l_shipdate) AS snapshot_ts,
           CASE WHEN year(l_shipdate) < 1997 THEN TIMESTAMP '1990-01-01 00:00:00'
                WHEN year(l_shipdate) * 100 + month(l_shipdate) < 199907 THEN TIMESTAMP '1997-01-01 00:00:00'
                ELSE TIMESTAMP '1999-07-01 00:00:00' END AS stats_since,
           count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS seeks,
           count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS scans,
           count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS lookups, count(*) AS updates
    FROM {{lineitem}}
    GROUP BY l_partkey, year(l_shipdate), month(l_shipdate)) AS monthly
WINDOW w AS (PARTITION BY object_id, stats_since ORDER BY snapshot_ts)""",
    "part_partitions": f"""
SELECT {_scope("p_partkey")}, p_partkey AS object_id, 2 AS index_id,
       p_partkey * 2 AS partition_id, CAST(p_size AS BIGINT) AS rows
FROM {{part}}
UNION ALL
SELECT {_scope("p_partkey")}, p_partkey AS object_id, 2 AS index_id,
       p_partkey * 2 + 1 AS partition_id, CAST(p_size AS BIGINT) * 2 AS rows
FROM {{part}}
WHERE p_size > 25""",
    "missing_groups": f"""
SELECT DISTINCT CASE WHEN o_custkey % 25 < 13 THEN 'east' ELSE 'west' END AS server,
       o_custkey AS index_group_handle, o_custkey AS index_handle
FROM {{orders}}""",
    "missing_group_stats": f"""
SELECT CASE WHEN o_custkey % 25 < 13 THEN 'east' ELSE 'west' END AS server,
       o_custkey AS group_handle, count(*) AS user_seeks,
       count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS user_scans,
       CAST(o_custkey % 100 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS avg_user_impact,
       max(o_orderdate) AS last_user_seek
FROM {{orders}}
GROUP BY o_custkey""",
    "missing_details": f"""
SELECT DISTINCT {_scope("o_custkey")}, o_custkey AS index_handle, CAST(o_custkey % 25 AS INT) AS object_id,
       '[db].[dbo].[NATION_' || CAST(o_custkey % 25 AS STRING) || ']' AS statement,
       CASE WHEN o_custkey % 3 <> 0 THEN '[a' || CAST(o_custkey % 9 AS STRING) || ']' END AS equality_columns,
       CASE WHEN o_custkey % 3 <> 1 THEN '[b' || CAST(o_custkey % 8 AS STRING) || ']' END AS inequality_columns,
       CASE WHEN o_custkey % 2 = 0 THEN '[c' || CAST(o_custkey % 7 AS STRING) || ']' END AS included_columns
FROM {{orders}}""",
    "nation_tables": f"""
SELECT {_scope("n_nationkey")}, n_nationkey AS object_id, n_name AS name
FROM {{nation}}""",
    "query_plans": f"""
SELECT {_scope("doc_id")}, doc_id AS plan_handle,
       CASE WHEN doc_id % 10 <> 9 THEN doc_id % 100 END AS object_id,
       CASE WHEN doc_id % 50 = 7 THEN '<ShowPlanXML><S><MissingIndex Database="d"/>'
            ELSE '<ShowPlanXML xmlns="http://schemas.example.org/showplan"><S source="' || source || '" chars="'
                 || CAST(n_chars AS STRING) || '">'
                 || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
                 || CASE doc_id % 3 WHEN 0 THEN '<MissingIndex Database="d"/>' WHEN 1 THEN 'no MissingIndex here' ELSE '' END
                 || '</S></ShowPlanXML>' END AS query_plan
FROM {{documents}}""",
    "advice_plans": f"""
SELECT {_scope("doc_id")}, doc_id AS plan_handle,
       CASE WHEN doc_id % 10 <> 9 THEN doc_id % 100 END AS object_id,
       CASE WHEN doc_id % 50 = 7 THEN '<ShowPlanXML><MissingIndexGroup Impact="1"><MissingIndex Database="d"/>'
            ELSE '<ShowPlanXML xmlns="http://schemas.example.org/showplan"><!-- <MissingIndexGroup Impact="1"></MissingIndexGroup> -->'
                 || '<Statements><StmtSimple StatementText="q"><QueryPlan>'
                 || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
                 || CASE WHEN doc_id % 4 < 3 THEN '<MissingIndexes>'
                    || '<MissingIndexGroup Impact="' || CAST(doc_id % 90 + 10 AS STRING) || '.5">'
                    || '<MissingIndex Database="[db]" Schema="[dbo]" Table="[t' || CAST(doc_id % 20 AS STRING) || ']">'
                    || '<ColumnGroup Usage="EQUALITY"><Column Name="[a' || CAST(doc_id % 3 AS STRING) || ']" ColumnId="1"/>'
                    || '<Column Name="[b]" ColumnId="2"/></ColumnGroup>'
                    || CASE WHEN doc_id % 2 = 0 THEN '<ColumnGroup Usage="INCLUDE"><Column Name="[c]" ColumnId="3"/></ColumnGroup>'
                       ELSE '' END
                    || '</MissingIndex></MissingIndexGroup>'
                    || CASE WHEN doc_id % 4 = 1 THEN '<MissingIndexGroup Impact="50.25">'
                       || '<MissingIndex Database="[db]" Schema="[dbo]" Table="[u]"><ColumnGroup Usage="INEQUALITY">'
                       || '<Column Name="[d]" ColumnId="4"/></ColumnGroup></MissingIndex>'
                       || '<MissingIndex Database="[db]" Schema="[dbo]" Table="[v]"><ColumnGroup Usage="EQUALITY">'
                       || '<Column Name="[e]" ColumnId="5"/></ColumnGroup></MissingIndex></MissingIndexGroup>' ELSE '' END
                    || '</MissingIndexes>' ELSE '' END
                 || '</QueryPlan></StmtSimple></Statements></ShowPlanXML>' END AS query_plan
FROM {{documents}}""",
    "query_stats": f"""
SELECT CASE WHEN CAST(floor(event_id / 10) AS BIGINT) % 25 < 13 THEN 'east' ELSE 'west' END AS server,
       CAST(floor(event_id / 10) AS BIGINT) AS plan_handle,
       event_id % 5 + 1 AS execution_count, ts AS last_execution_time
FROM {{events}}""",
    "job_history": """
SELECT 'east' AS server, CAST(user_id AS STRING) AS job_id, event_id AS instance_id,
       CAST(event_id % 4 AS INT) AS step_id,
       CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS run_status,
       CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INT) AS run_date,
       CAST(hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS INT) AS run_time,
       CAST(floor(floor(value) / 60) * 100 + floor(value) % 60 AS INT) AS run_duration
FROM {events}""",
    "schedules": """
SELECT 'east' AS server, c_custkey AS schedule_id, c_name AS name,
       CASE WHEN c_custkey % 10 = 3 THEN 0 ELSE 1 END AS enabled,
       CASE c_custkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 16
            WHEN 4 THEN 32 WHEN 5 THEN 64 ELSE 128 END AS freq_type,
       CAST(c_custkey % 128 AS INT) AS freq_interval,
       CAST(c_custkey % 3 AS INT) AS freq_recurrence_factor,
       CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END AS freq_relative_interval,
       CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS freq_subday_type,
       CAST(c_custkey % 60 AS INT) AS freq_subday_interval,
       CAST(c_custkey * 37 % 24 * 10000 + c_custkey * 13 % 60 * 100 AS INT) AS active_start_time,
       235959 AS active_end_time
FROM {customer}""",
    "job_schedules": """
SELECT DISTINCT 'east' AS server, user_id AS schedule_id, CAST(user_id AS STRING) AS job_id,
       CAST(20240201 + user_id % 28 AS INT) AS next_run_date,
       CAST(user_id * 7 % 24 * 10000 + user_id % 60 * 100 AS INT) AS next_run_time
FROM {events}""",
    "jobs": """
SELECT DISTINCT 'east' AS server, CAST(user_id AS STRING) AS job_id,
       'job_' || CAST(user_id AS STRING) AS name,
       CASE WHEN user_id % 9 = 4 THEN 0 ELSE 1 END AS enabled
FROM {events}""",
    "maintenance_log": f"""
SELECT CAST(CAST(day(ts) AS INT) AS STRING) AS run_id, {_scope("user_id")},
       user_id AS object_id, CAST(event_id % 6 AS INT) AS index_id, event_id AS partition_number,
       'started' AS event, ts AS event_ts, CAST(NULL AS STRING) AS error_message,
       'db' || CAST(user_id % 25 AS STRING) AS databaseName, 'user_' || CAST(user_id AS STRING) AS objectName,
       'ix_' || CAST(event_id % 6 AS STRING) AS indexName, value AS fragmentation, event_id % 50 AS page_count,
       'ALTER INDEX ix_' || CAST(event_id % 6 AS STRING) AS sql_statement
FROM {{events}}
UNION ALL
SELECT CAST(CAST(day(ts) AS INT) AS STRING) AS run_id, {_scope("user_id")},
       user_id AS object_id, CAST(event_id % 6 AS INT) AS index_id, event_id AS partition_number,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'finished' END AS event,
       ts + INTERVAL 1 SECOND * CAST(event_id % 97 AS INT) AS event_ts,
       CASE WHEN event_type = 'error' THEN props END AS error_message,
       CAST(NULL AS STRING) AS databaseName, CAST(NULL AS STRING) AS objectName, CAST(NULL AS STRING) AS indexName,
       CAST(NULL AS DOUBLE) AS fragmentation, CAST(NULL AS BIGINT) AS page_count, CAST(NULL AS STRING) AS sql_statement
FROM {{events}}
WHERE event_type <> 'signup'""",
    "tokens": """
SELECT CASE WHEN user_id % 2 = 0 THEN 'east' ELSE 'west' END AS server, event_type AS publication,
       CAST(row_number() OVER (PARTITION BY user_id % 2, event_type ORDER BY event_id) AS BIGINT) AS tracer_id,
       event_id, user_id, ts
FROM {events}""",
    "posts": """
SELECT server, publication, tracer_id, ts AS post_ts
FROM {tokens}""",
    "receipts": """
SELECT server, publication, tracer_id, 'sub' || CAST(user_id % 5 AS STRING) AS subscriber,
       'db' || CAST(user_id % 3 AS STRING) AS subscriber_db,
       ts + INTERVAL 1 SECOND * CAST(event_id % 7 AS INT) AS distributor_ts,
       CASE WHEN publication <> 'signup'
            THEN ts + INTERVAL 1 SECOND * CAST(event_id % 7 + event_id % 13 AS INT) END AS subscriber_ts
FROM {tokens}
WHERE publication <> 'error'
UNION ALL
SELECT server, publication, tracer_id, 'mirror' AS subscriber, 'db9' AS subscriber_db,
       ts + INTERVAL 1 SECOND * CAST(event_id % 7 AS INT) AS distributor_ts,
       ts + INTERVAL 1 SECOND * CAST(event_id % 7 + event_id % 5 AS INT) AS subscriber_ts
FROM {tokens}
WHERE publication = 'view'""",
    "subscriptions": """
SELECT server, publication, 'sub' || CAST(no AS STRING) AS subscriber, 'db' || CAST(no % 2 AS STRING) AS subscriber_db
FROM (SELECT DISTINCT server, publication FROM {tokens}) AS published
CROSS JOIN (SELECT DISTINCT r_regionkey AS no FROM {region} WHERE r_regionkey < 3) AS numbers
WHERE publication <> 'error' OR server = 'west'""",
    "deliveries": """
SELECT t.server, t.publication, tracer_id, subscriber, subscriber_db,
       ts + INTERVAL 1 SECOND * CAST(event_id % 7 AS INT) AS distributor_ts,
       CASE WHEN event_id % 50 <> 3
            THEN ts + INTERVAL 1 SECOND * CAST(event_id % 7 + event_id % 11 AS INT) END AS subscriber_ts
FROM {tokens} AS t
JOIN {subscriptions} AS s ON s.server = t.server AND s.publication = t.publication
WHERE NOT (t.server = 'east' AND subscriber = 'sub1' AND ts >= TIMESTAMP '2024-01-16 00:00:00')
  AND NOT (t.publication = 'view' AND subscriber = 'sub2')""",
    "fleet_columns": """
SELECT 'srv' || CAST(p_partkey % 20 AS STRING) AS server,
       'db' || CAST(CAST(floor(p_partkey / 20) AS BIGINT) % 3 AS STRING) AS database,
       'dbo.' || lower(p_type) || '_' || CAST(CAST(floor(p_partkey / 600) AS BIGINT) AS STRING) AS table,
       CAST(p_partkey AS INT) AS column_id,
       replace(p_name, ' ', '_') || '_of_' || lower(p_type) || '_' || CAST(p_partkey AS STRING) AS name,
       CASE p_partkey % 17 WHEN 0 THEN 'bit' WHEN 1 THEN 'tinyint' WHEN 2 THEN 'uniqueidentifier'
            WHEN 3 THEN 'datetime' WHEN 4 THEN 'money' WHEN 5 THEN 'xml' WHEN 6 THEN 'smalldatetime'
            WHEN 7 THEN 'DateTime2' WHEN 8 THEN 'nvarchar' WHEN 9 THEN 'nchar' WHEN 10 THEN 'VARCHAR'
            WHEN 11 THEN 'char' WHEN 12 THEN 'decimal' WHEN 13 THEN 'int' WHEN 14 THEN 'bigint'
            WHEN 15 THEN 'varchar' ELSE 'float' END AS type,
       CASE WHEN p_partkey % 17 = 15 THEN -1 ELSE p_size * 2 END AS length,
       p_size % 30 + 1 AS precision, p_size % 5 AS scale, (p_size % 3 <> 0) AS nullable
FROM {part}""",
}


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its footer is read once per session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapter(spark: SparkSession, sf_dir: str, name: str, **tables: DataFrame) -> DataFrame:
    """An adapter as a DataFrame; ``tables`` replaces test tables."""
    text = ADAPTERS[name]
    inputs = {
        used: tables[used] if used in tables
        else adapter(spark, sf_dir, used, **tables) if used in ADAPTERS
        else table(spark, sf_dir, used)
        for used in set(_references(text))
    }
    return spark.sql(text, **inputs)


def with_adapters(query: str, sources: dict[str, str] | None = None) -> str:
    """A DuckDB query whose ``{adapter}`` references are defined as CTEs.

    ``sources`` replaces test tables by subqueries.
    """
    needed: list[str] = []

    def visit(text: str) -> None:
        for used in _references(text):
            if used in ADAPTERS and used not in needed:
                visit(ADAPTERS[used])
                needed.append(used)

    visit(query)
    body = _plain(query, sources).strip()
    if not needed:
        return body
    ctes = ",\n".join(f'"{name}" AS ({_plain(ADAPTERS[name], sources)})' for name in needed)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _references(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


def _plain(text: str, sources: dict[str, str] | None = None) -> str:
    def replacement(found: re.Match) -> str:
        name = found.group(1)
        return f"({sources[name]})" if sources and name in sources else f'"{name}"'

    return re.sub(r"\{(\w+)\}", replacement, text)
