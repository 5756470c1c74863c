"""The indexes that stored plans ask for, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgauge.operators.usage import plans_with_missing_index

# The elements and attributes of a plan that describe a missing index.
GROUP_SCHEMA = (
    "_Impact double, MissingIndex array<struct<_Database string, _Schema string, _Table string, "
    "ColumnGroup array<struct<_Usage string, Column array<struct<_Name string, _ColumnId int>>>>>>"
)
_GROUP = r"(?s)<MissingIndexGroup[\s>].*?</MissingIndexGroup>"
# Neither comments nor quoted character data hold elements.
_NO_ELEMENTS = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"
SUGGESTION = ("database", "schema", "table", "equality_columns", "inequality_columns", "included_columns")


def plan_suggestions(hot: DataFrame, plans: DataFrame) -> DataFrame:
    """One row for each missing index of each hot plan: where, which columns, and the expected gain in percent.

    Plans that are not hot are not parsed, text that is not XML is dropped.  A plan can hold several
    groups, at any depth, and a group several indexes; ``suggestion`` numbers them within the plan.  Column lists are
    comma-joined in the order of the plan, NULL where there is none.
    """
    found = plans_with_missing_index(hot, plans)
    bare = F.regexp_replace("query_plan", _NO_ELEMENTS, "")
    groups = found.select(
        "server",
        "plan_handle",
        "object_id",
        "statement_executions",
        F.posexplode(F.regexp_extract_all(bare, F.lit(_GROUP), F.lit(0))).alias("at", "group_xml"),
    )
    parsed = groups.withColumn("g", F.from_xml("group_xml", GROUP_SCHEMA)).drop("group_xml")
    each = parsed.select("*", F.posexplode("g.MissingIndex").alias("within", "m"))
    return each.select(
        "server",
        "plan_handle",
        "object_id",
        "statement_executions",
        (F.col("at") * 1000 + F.col("within")).cast("bigint").alias("suggestion"),
        F.col("g._Impact").alias("impact"),
        F.col("m._Database").alias("database"),
        F.col("m._Schema").alias("schema"),
        F.col("m._Table").alias("table"),
        _columns("EQUALITY").alias("equality_columns"),
        _columns("INEQUALITY").alias("inequality_columns"),
        _columns("INCLUDE").alias("included_columns"),
    )


def _columns(usage: str) -> Column:
    groups = F.filter("m.ColumnGroup", lambda group: group["_Usage"] == usage)
    names = F.flatten(F.transform(groups, lambda group: group["Column"]["_Name"]))
    return F.when(F.size(names) > 0, F.array_join(names, ","))


def suggested_indexes(suggestions: DataFrame) -> DataFrame:
    """Equal suggestions of all plans together: how many plans and executions ask, and the weighted gain.

    Counts and sums only, so an index that very many plans ask for is combined before the shuffle.
    """
    return suggestions.groupBy("server", *SUGGESTION).agg(
        F.count_distinct("plan_handle").alias("plans"),
        F.sum("statement_executions").alias("executions"),
        F.sum(F.col("impact") * F.col("statement_executions")).alias("est_impact"),
    )
