from __future__ import annotations

import glob

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsgauge.functions.text import quote_name
from opsgauge.operators import splitting
from opsgauge.operators.export import export_delimited, export_path, render_inserts, sanitize_for_export
from opsgauge.operators.splitting import filter_by_list, register_split_functions, split_rows
from opsgauge.operators.translation import generate_ddl, translate_types
from opsgauge.session import working_path
from opsgauge.sources.catalog import CATALOG_SCHEMA
from tests.helpers import executed, one, plan_text, rows

SPLITS = [
    ("  aaa  bbb  ccc ", " ", ["aaa", "bbb", "ccc"]),
    (",aaa,bbb,,,ccc,", ",", ["aaa", "bbb", "ccc"]),
    (" a , b ", ",", ["a ", " b"]),
    (None, ",", []),
    ("", ",", []),
    (",,", ",", []),
    ("a.b", ".", ["a", "b"]),
    (r"a\Eb", r"\E", ["a", "b"]),
    ("a||b|c", "||", ["a", "b|c"]),
    ("x" * 9000 + "," + "y" * 200, ",", ["x" * 9000, "y" * 200]),
]


@pytest.mark.parametrize("text, delimiter, expected", SPLITS)
def test_split_golden(spark, text, delimiter, expected):
    df = spark.createDataFrame([(7, text)], "id int, s string")
    assert [r.stringValue for r in split_rows(df, "s", delimiter).collect()] == expected
    placed = split_rows(df, "s", delimiter, ["id"], with_pos=True).orderBy("pos").collect()
    assert [tuple(r) for r in placed] == [(7, at, part) for at, part in enumerate(expected, start=1)]


def test_split_in_sql(spark, sf):
    register_split_functions(spark)
    for text, delimiter, expected in SPLITS:
        got = spark.sql("SELECT * FROM split_rows(:text, :delimiter)", {"text": text, "delimiter": delimiter})
        assert [r.stringValue for r in got.collect()] == expected
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    documents.createOrReplaceTempView("split_documents")
    got = spark.sql("SELECT doc_id, explode(parts) FROM (SELECT doc_id, split_kept(text, ',') AS parts FROM split_documents)")
    assert rows(got) == rows(split_rows(documents, "text", ",", ["doc_id"]))
    assert "Exchange" not in executed(got) and "Join" not in executed(got)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="abc é\\.", min_size=1).filter(lambda s: s.strip(" ")), min_size=1, max_size=8))
def test_split_undoes_join(spark, parts):
    joined = "|".join(parts)
    df = spark.createDataFrame([(joined,)], "s string")
    expected = joined.strip(" ").split("|")
    assert [r.stringValue for r in split_rows(df, "s", "|").collect()] == expected


def test_split_reads_only_what_it_keeps_and_stays_in_generated_code(spark, sf):
    df = split_rows(spark.read.parquet(f"{sf}/documents.parquet"), "text", ",", ["doc_id"])
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_text(df)
    assert "Exchange" not in executed(df)
    assert "*(1) Generate" in executed(df)


def test_filter_by_list(spark, monkeypatch):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (" b",)], "n string")
    assert rows(filter_by_list(df, "n", None)) == rows(df)
    assert rows(filter_by_list(df, "n", "a,b ,a,,zz")) == [("a",), ("b",)]
    assert rows(filter_by_list(df, "n", "a, b")) == [(" b",), ("a",)]
    assert rows(filter_by_list(df, "n", " , ")) == []
    monkeypatch.setattr(splitting, "MAX_FILTER_VALUES", 1)
    assert rows(filter_by_list(df, "n", "a,b,a")) == [("a",), ("b",)]


def test_filter_by_list_reaches_the_scan(spark, sf):
    df = filter_by_list(spark.read.parquet(f"{sf}/supplier.parquet"), "s_name", "x,y")
    assert "PushedFilters: [In(s_name, [x,y])]" in plan_text(df)


def test_quote_name(spark):
    assert one(spark.range(1), quote_name(F.lit("a]b"))) == "[a]]b]"


def _texts(spark):
    values = ["", "   ", "a|b", "a\tb", "a\nb", "a\rb", "ok", " ok ", "50%", None]
    return spark.createDataFrame([(at, v, v) for at, v in enumerate(values)], "id int, free string, must string")


def test_sanitize_golden(spark):
    got = sanitize_for_export(_texts(spark), not_null=["must"], widths={"must": 3}).orderBy("id").collect()
    assert [r.free for r in got] == [None] * 6 + ["ok", " ok ", "50%", None]
    assert [r.must for r in got] == ["~~~"] * 6 + ["ok", " ok ", "50%", None]
    assert [r.id for r in got] == list(range(10))


def test_sanitize_takes_the_delimiter_literally(spark):
    got = sanitize_for_export(_texts(spark), delimiter="%").orderBy("id").collect()
    assert got[2].free == "a|b" and got[8].free is None


def test_sanitize_needs_a_width_to_fill(spark):
    with pytest.raises(ValueError):
        sanitize_for_export(_texts(spark), not_null=["must"])
    with pytest.raises(ValueError):
        sanitize_for_export(_texts(spark), use_null=False)


def test_export_writes_every_row_on_one_line(spark):
    path = working_path(spark, "export")
    clean = sanitize_for_export(_texts(spark), not_null=["must"], widths={"must": 3})
    dated = clean.withColumn("at", F.expr("TIMESTAMP_NTZ '2024-01-05 09:30:15.25'")).withColumn("flag", F.lit(True))
    export_delimited(dated, path)
    lines = [line for name in glob.glob(f"{path}/part-*") for line in open(name, newline="").read().split("\n")[:-1]]
    assert len(lines) == 10
    assert all(line.count("|") == 4 for line in lines)
    assert '7| ok | ok |2024-01-05 09:30:15.250|1' in lines
    assert "0||~~~|2024-01-05 09:30:15.250|1" in lines


def test_export_top(spark):
    path = working_path(spark, "export")
    export_delimited(spark.range(100), path, top=3, order_by=[F.desc("id")])
    assert rows(spark.read.text(path)) == [("97",), ("98",), ("99",)]


def test_export_path():
    assert export_path("db.dbo.t", "/data/out/") == "/data/out/db_dbo_t.dat"


def test_render_golden(spark):
    df = spark.createDataFrame([(1, "O'Neil", None)], "id int, name string, extra string")
    assert render_inserts(df, "tgt.t").first().sql_statement == (
        """INSERT INTO tgt.t ("id","name","extra") VALUES (1,'O''Neil',NULL);"""
    )


def test_render_types_and_long_names(spark):
    df = spark.sql(
        "SELECT true AS flag, DATE '2024-01-05' AS d, TIMESTAMP_NTZ '2024-01-05 09:30:15.123456' AS t, "
        f"CAST(1.5 AS DECIMAL(9,2)) AS {'n' * 40}, CAST(NULL AS DATE) AS e"
    )
    values = "VALUES (1,'2024-01-05','2024-01-05T09:30:15.123',1.50,NULL);"
    for limit, length in ((None, 40), (30, 30)):
        statement = render_inserts(df, "x", max_identifier=limit).first().sql_statement
        assert statement == f"""INSERT INTO x ("flag","d","t","{"n" * length}","e") {values}"""
    with pytest.raises(ValueError, match="first 2 characters"):
        render_inserts(spark.sql("SELECT 1 AS abc, 2 AS abd"), "x", max_identifier=2)


def test_render_top(spark):
    assert render_inserts(spark.range(1500), "x").count() == 1500
    assert render_inserts(spark.range(1500), "x", top=1000).count() == 1000
    assert render_inserts(spark.range(9), "x", 1, [F.desc("id")]).first().sql_statement.endswith("(8);")
    with pytest.raises(ValueError):
        render_inserts(spark.sql("SELECT array(1) AS a"), "x")


COLUMNS = [
    ("s", "d", "dbo.example_table", 1, "id", "int", 4, None, None, False),
    ("s", "d", "dbo.example_table", 2, "name", "nvarchar", 100, None, None, True),
    ("s", "d", "dbo.example_table", 3, "amount", "money", None, None, None, False),
    ("s", "d", "dbo.example_table", 4, "ts", "datetime", None, None, None, True),
]


def test_ddl_golden(spark):
    result = generate_ddl(spark.createDataFrame(COLUMNS, CATALOG_SCHEMA), "tgt").first()
    assert result.ddl_statement == (
        'CREATE TABLE tgt."s.d.dbo.example_table"("id" int NOT NULL,"name" varchar(50) CHARACTER SET UNICODE NOT '
        'CASESPECIFIC NULL,"amount" DECIMAL(18,4) NOT NULL,"ts" TIMESTAMP(3) NULL);'
    )
    assert result.truncate_statement == 'DELETE FROM tgt."s.d.dbo.example_table";'


def test_ddl_names_and_order(spark):
    long = [("s", "d", "nodot_" + "x" * 40, at, f"c{at}_" + "y" * 40, "BIT", None, None, None, True) for at in (10, 9, 2, 1)]
    catalog = spark.createDataFrame(long, CATALOG_SCHEMA)
    made = generate_ddl(catalog, "tgt", max_identifier=5, compat=True).first()
    assert made.target_table == "tgt.tmp_nodot_" + "x" * 20
    assert made.ddl_statement.endswith('("c1_yy" BYTEINT NULL,"c2_yy" BYTEINT NULL,"c9_yy" BYTEINT NULL,"c10_y" BYTEINT NULL);')
    assert generate_ddl(catalog, "tgt", "mine").first().target_table == "tgt.mine"
    with pytest.raises(Exception, match="first 1 characters"):
        generate_ddl(catalog, "tgt", max_identifier=1).collect()


def test_ddl_targets_differ(spark):
    tables = [("s.a", "b", "t"), ("s", "a.b", "t"), ("s", "b", "dbo." + "x" * 40 + "1"), ("s", "b", "dbo." + "x" * 40 + "2")]
    rows = [(*table, 1, "c", "bit", None, None, None, True) for table in tables]
    catalog = spark.createDataFrame(rows, CATALOG_SCHEMA)
    made = generate_ddl(catalog, "tgt").collect()
    assert len({row.target_table for row in made}) == 4 and {row.same_target for row in made} == {1}
    assert sorted(row.same_target for row in generate_ddl(catalog, "tgt", compat=True).collect()) == [2, 2, 2, 2]
    with pytest.raises(ValueError, match="more than one table"):
        generate_ddl(catalog, "tgt", "mine")


def test_types_without_loss(spark):
    kinds = [("nvarchar", -1, None, None), ("varchar", -1, None, None), ("decimal", None, 9, 2), ("sql_variant", None, None, None)]
    frame = spark.createDataFrame(
        [("s", "d", "t", at, "c", kind, length, p, sc, True) for at, (kind, length, p, sc) in enumerate(kinds)], CATALOG_SCHEMA
    )
    assert [r.target_type for r in translate_types(frame).orderBy("column_id").collect()] == [
        "CLOB CHARACTER SET UNICODE", "CLOB", "decimal(9,2)", "sql_variant",
    ]
    assert [r.target_type for r in translate_types(frame, compat=True).orderBy("column_id").collect()] == [
        "varchar(0) CHARACTER SET UNICODE NOT CASESPECIFIC", "varchar(-1)", "decimal", "sql_variant",
    ]
