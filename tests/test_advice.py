"""Indexes that plans ask for, as rows."""

from __future__ import annotations

from opsgauge.operators.advice import plan_suggestions, suggested_indexes
from tests.helpers import rows


def _index(table, *groups, database="[db]"):
    columns = "".join(
        f'<ColumnGroup Usage="{usage}">' + "".join(f'<Column Name="{c}" ColumnId="1"/>' for c in names) + "</ColumnGroup>"
        for usage, names in groups
    )
    return f'<MissingIndex Database="{database}" Schema="[s]" Table="{table}">{columns}</MissingIndex>'


def _group(impact, *indexes):
    return f'<MissingIndexGroup Impact="{impact}">{"".join(indexes)}</MissingIndexGroup>'


def _plan(*groups):
    return f'<ShowPlanXML xmlns="x"><A><B><MissingIndexes>{"".join(groups)}</MissingIndexes></B></A></ShowPlanXML>'


BOTH = (("EQUALITY", ["[a]", "[b]"]), ("INEQUALITY", ["[c]"]), ("INCLUDE", ["[d]", "[e]"]))
PLANS = {
    1: _plan(_group(90.5, _index("[t]", *BOTH)), _group(10, _index("[u]", ("INCLUDE", ["[z]"])), _index("[v]"))),
    2: _plan(_group(20.25, _index("[t]", *BOTH))),
    3: "<ShowPlanXML><MissingIndex Database='d'>",
    4: _plan(_group(1, _index("[cold]", *BOTH))),
    5: "<P><!-- " + _group(5, _index("[no]", *BOTH)) + " --><![CDATA[" + _group(5, _index("[no]")) + "]]>"
    + _group(7, _index("[yes]", ("EQUALITY", ["[q&amp;r]"]))) + "</P>",
    6: "<P>&lt;MissingIndexGroup&gt; MissingIndex</P>",
    7: None,
}


def _suggestions(spark):
    plans = spark.createDataFrame(
        [("s", 1, handle, handle, text) for handle, text in PLANS.items()],
        "server string, database_id int, object_id long, plan_handle long, query_plan string",
    )
    hot = spark.createDataFrame([("s", h, h * 10) for h in PLANS if h != 4], "server string, plan_handle long, statement_executions long")
    return plan_suggestions(hot, plans)


def test_every_index_of_hot_plans(spark):
    got = _suggestions(spark).drop("server", "object_id", "database", "schema")
    assert rows(got) == sorted(
        [
            (1, 10, 0, 90.5, "[t]", "[a],[b]", "[c]", "[d],[e]"),
            (1, 10, 1000, 10.0, "[u]", None, None, "[z]"),
            (1, 10, 1001, 10.0, "[v]", None, None, None),
            (2, 20, 0, 20.25, "[t]", "[a],[b]", "[c]", "[d],[e]"),
            (5, 50, 0, 7.0, "[yes]", "[q&r]", None, None),
        ],
        key=repr,
    )


def test_equal_suggestions_are_summed(spark):
    got = suggested_indexes(_suggestions(spark)).where("table = '[t]'").first()
    assert (got.plans, got.executions, got.est_impact) == (2, 30, 90.5 * 10 + 20.25 * 20)
    assert suggested_indexes(_suggestions(spark).where("false")).count() == 0
