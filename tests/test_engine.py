import duckdb
import pytest
from pyspark.sql import types as T

from sluice import package_queries, queries  # noqa: F401  the first adds to the second
from sluice.compare import compare
from sluice.errors import ExpressionError
from sluice.functions import Expressions
from sluice.functions.parse import parse
from sluice.plans import Flow, Package, plan, run
from sluice.plans.control import call_order
from sluice.plans.run import context
from sluice.sources import Tables, spark_sql, strip_order

SF = "/root/testdata/sf0.001"


def _rows(rows):
    text = lambda v: "NULL" if v is None else f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)
    return sorted(tuple(text(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == columns
    at = [have.index(c) for c in columns]
    assert _rows(df.select(*columns).collect()) == _rows([tuple(r[i] for i in at) for r in cursor.fetchall()])


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(7, 2, "ab", None, True)], "a int, b int, s string, n int, t boolean")


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("[a] / [b]", 3), ("-[a] / [b]", -3), ("[a] % -[b]", 1), ('[s] + "c"', "abc"), ("[n] > 1 ? 1 : 2", 2), ("[n] > 1", 0), ("ISNULL([n])", 1), ("!ISNULL([n]) || [a] == 7", 1),
        ("1 + 2 * 3 - 4", 3), ("(1 + 2) * 3", 9), ("[t] ? 5 : 6", 5), ("(DT_STR,3,1252)\"abcdef\"", "abc"), ("(DT_I4)12.7", 12), ("(DT_I4)-12.7", -12), ("NULL(DT_I4)", None),
        ('"a\\tb\\x0041"', "a\tbA"), ('SUBSTRING("abcdef", 0, 3)', "ab"), ('FINDSTRING("banana", "an", 1)', 2), ('DATEDIFF("yy", (DT_DBTIMESTAMP)"2025-12-31", (DT_DBTIMESTAMP)"2026-01-01")', 1),
        ("6 & 3 | 8 ^ 1", 11), ("~[a]", -8), ('REPLACENULL([n], 4)', 4), ('TRUE && "5" > 3', 1),
    ],
)
def test_expression(one, text, value):
    assert one.select(Expressions(one.schema).value(text)).first()[0] == value


@pytest.mark.parametrize("text", ["[a] +", "#{x}", "FOO([a])", "LEN()", '"open', "[nope]", 'DATEPART("zz", [a])', "(1"])
def test_bad_expression(one, text):
    with pytest.raises(ExpressionError):
        Expressions(one.schema).value(text)


def test_parse_precedence():
    assert parse("1 || 2 && 3 == 4")[1] == "||"
    assert parse("(DT_I4)1 + 2")[0] == "bin"


def test_source_sql():
    assert strip_order("SELECT a FROM t ORDER BY a;") == ("SELECT a FROM t", True)
    assert strip_order("SELECT row_number() OVER (ORDER BY a) FROM t") == ("SELECT row_number() OVER (ORDER BY a) FROM t", False)
    assert spark_sql("SELECT TOP 3 [a b], N'x[y]' FROM [dbo].[t]") == "SELECT `a b`, 'x[y]' FROM `t` LIMIT 3"


def _ctx(spark, tables=None, **more):
    return context(spark, Tables(spark, None, tables or {}), **more)


def test_lookup_modes(spark):
    orders = spark.createDataFrame([(1, 101), (4, 999), (7, None)], "id int, k int")
    ref = spark.createDataFrame([(101, "x"), (101, "y")], "c int, name string")
    flow = Flow().add("s", "source", table="o").add("l", "lookup", "s", table="r", keys={"k": "c"}, take={"name": "name"}, order=["name"])
    got = lambda compat, port: sorted(plan(flow, _ctx(spark, {"o": orders, "r": ref}, compat=compat, strict=True)).df(port).collect(), key=str)
    assert [tuple(r) for r in got("reference", "l.match")] == [(1, 101, "x"), (1, 101, "y"), (4, 999, None), (7, None, None)]
    assert [tuple(r) for r in got("ssis", "l.match")] == [(1, 101, "x")]
    assert [tuple(r) for r in got("ssis", "l.nomatch")] == [(4, 999), (7, None)]


def test_split_null_and_row_count(spark, tmp_path):
    t = spark.createDataFrame([(1, 90), (2, 10), (3, None)], "id int, score int")
    flow = Flow().add("s", "source", table="t").add("n", "row_count", "s", variable="seen").add("c", "conditional_split", "n", conditions={"high": "[score] >= 80"})
    flow.add("a", "destination", "c.high", mapping={"id": "id"}, path=str(tmp_path / "a")).add("b", "destination", "c.default", mapping={"id": "id"}, path=str(tmp_path / "b"))
    result = run(flow, _ctx(spark, {"t": t}, strict=True))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [2]
    assert result.count("seen") == 3
    assert sorted(r.id for r in plan(flow, _ctx(spark, {"t": t}, compat="ssis")).df("b").collect()) == [2, 3]


def test_warnings_and_isolation(spark):
    t = spark.createDataFrame([(1,)], "id int")
    flow = Flow().add("s", "source", table="t").add("d", "derived_column", "s", expressions={"x": "NOPE([id])"}).add("lost", "source").add("after", "sort", "lost", keys=[("id", True)])
    ctx = _ctx(spark, {"t": t})
    result = plan(flow, ctx)
    assert result.df("d").first().x is None
    assert any("NOPE" in w for w in ctx.warnings) and any("not fully connected" in w for w in ctx.warnings)


def test_call_order():
    p = Package("main", calls={"c": "c.dtsx", "a": "a.dtsx", "b": "b.dtsx"}, precedence=[("a", "b", "success"), ("b", "c", "completion"), ("c", "a", "failure")])
    assert call_order(p, []) == ["a", "b", "c"]


def test_compare(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 2.00001), (1, 1.0), (2, None)], "k int, v double")
    assert compare(a, b, {"v": ("near", 1e-3)}).equal
    assert compare(a, b).missing == 1
    assert compare(a, b.where("k = 1")).extra == 2
    assert not compare(a, b, {"v": ("near", 1e-9)}).equal


def test_package_file(spark, tmp_path):
    from sluice.sources.dtsx import read_package

    (tmp_path / "p.dtsx").write_text("""<DTS:Executable xmlns:DTS="www.microsoft.com/SqlServer/Dts" DTS:ObjectName="P"><DTS:Variables><DTS:Variable DTS:Namespace="User" DTS:ObjectName="Min"><DTS:VariableValue DTS:DataType="3">5</DTS:VariableValue></DTS:Variable></DTS:Variables>
<DTS:Executables><DTS:Executable DTS:ExecutableType="Microsoft.Pipeline" DTS:ObjectName="F"><DTS:ObjectData><pipeline><components>
<component refId="S" name="Src" componentClassID="Microsoft.OLEDBSource"><properties><property name="OpenRowset">[dbo].[t]</property></properties><outputs><output refId="S.o" name="Out"><outputColumns><outputColumn lineageId="S.id" name="id"/><outputColumn lineageId="S.v" name="v"/></outputColumns></output></outputs></component>
<component refId="D" name="Der" componentClassID="Microsoft.DerivedColumn"><inputs><input refId="D.i" name="In"/></inputs><outputs><output refId="D.o" name="Out"><outputColumns><outputColumn lineageId="D.w" name="w" dataType="i4"><properties><property name="FriendlyExpression">[v] * 2</property></properties></outputColumn></outputColumns></output></outputs></component>
<component refId="T" name="Dst" componentClassID="Microsoft.OLEDBDestination"><properties><property name="OpenRowset">[x]</property></properties><inputs><input refId="T.i" name="In"><inputColumns><inputColumn lineageId="D.w" externalMetadataColumnId="E.w"/></inputColumns><externalMetadataColumns><externalMetadataColumn refId="E.w" name="doubled"/></externalMetadataColumns></input></inputs></component>
</components><paths><path startId="S.o" endId="D.i"/><path startId="D.o" endId="T.i"/></paths></pipeline></DTS:ObjectData></DTS:Executable></DTS:Executables></DTS:Executable>""")
    package = read_package(tmp_path / "p.dtsx")
    assert package.variables[("User", "Min")][0] == "5"
    t = spark.createDataFrame([(1, 4)], T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.IntegerType())]))
    result = plan(package.flows[0], context(spark, Tables(spark, None, {"t": t}), package, strict=True))
    assert [r.asDict() for r in result.df("Dst").collect()] == [{"doubled": 8}]


SAMPLES = package_queries.SAMPLES


def test_lookup_that_must_match_fails(spark):
    left, ref = spark.createDataFrame([(1, 1), (2, 9)], "id int, k int"), spark.createDataFrame([(1, "x")], "c int, name string")
    flow = Flow().add("s", "source", table="o").add("l", "lookup", "s", table="r", keys={"k": "c"}, take={"name": "name"}, on_missing="fail")
    with pytest.raises(Exception, match="no match"):
        plan(flow, _ctx(spark, {"o": left, "r": ref}, compat="ssis", strict=True)).df("l.match").collect()


def test_split_whose_branches_meet_reads_its_source_once(spark):
    df = queries.QUERIES["etl_full"](spark, SF)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("orders.parquet") + text.count("Relation") == 2 and text.count("Join") == 1


def test_split_union_falls_back_for_other_columns(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, s string")
    flow = Flow().add("s", "source", table="t").add("c", "conditional_split", "s", conditions={"one": "[id] == 1"})
    flow.add("d", "derived_column", "c.one", expressions={"s": "[id] * 2"}).add("e", "derived_column", "c.default", expressions={"s": "[id] * 3", "x": "[id]"}).add("u", "union_all", "d", "e")
    assert sorted(tuple(r) for r in plan(flow, _ctx(spark, {"t": t}, strict=True)).df("u").collect()) == [(1, 2), (2, 6), (3, 9)]
    flow = Flow().add("s", "source", table="t").add("c", "conditional_split", "s", conditions={"one": '[s] == "a"'})
    flow.add("d", "derived_column", "c.one", expressions={"x": '"A"'}).add("e", "derived_column", "c.default", expressions={"x": '"B"'}).add("u", "union_all", "d", "e")
    for compat, want in (("reference", [(1, "a", "A"), (2, "b", "B")]), ("ssis", [(1, "a", "A"), (2, "b", "B"), (3, None, "B")])):
        assert sorted(tuple(r) for r in plan(flow, _ctx(spark, {"t": t}, compat=compat, strict=True)).df("u").collect()) == want


def test_append_to_a_catalog_table(spark, tmp_path):
    spark.sql(f"create database if not exists lake location '{tmp_path}/lake'")
    spark.sql("drop table if exists lake.kept")
    t = spark.createDataFrame([(1, "a")], "id int, s string")
    flow = Flow().add("s", "source", table="t").add("o", "destination", "s", mapping={"id": "id", "s": "s"}, table="[dbo].[kept]", database="lake")
    tables = Tables(spark, None, {"t": t}, qualify=True)
    for _ in range(2):
        run(flow, context(spark, tables, strict=True))
    assert tables.read("[kept]", "lake").count() == 2 == Tables(spark, None, namespace="lake").read("kept").count()
    spark.sql("drop database lake cascade")


def test_names_under_a_database():
    from sluice.sources import qualified

    assert [qualified(x, "db") for x in ("t", "[s].[t]", "a.s.t")] == ["db.dbo.t", "db.s.t", "a.s.t"] and qualified("[s].[t]", "") == "s.t"


def test_constraints_by_name_and_statements(spark, tmp_path):
    from sluice.plans.control import run_package
    from sluice.sources.dtsx import read_package

    text = (SAMPLES / "tree" / "main.dtsx").read_text()
    (tmp_path / "p.dtsx").write_text(text.replace("</DTS:Executables>\n<DTS:Prec", '<DTS:Executable DTS:refId="Package\\Sql" DTS:ExecutableType="Microsoft.ExecuteSQLTask" DTS:ObjectName="Sql"><DTS:ObjectData><SqlTaskData SqlStatementSource="CREATE OR REPLACE TEMP VIEW made AS SELECT 1 AS one"/></DTS:ObjectData></DTS:Executable></DTS:Executables>\n<DTS:Prec'))
    package = read_package(tmp_path / "p.dtsx")
    assert [w for _, _, w in package.precedence] == ["success", "failure"] and package.precedence[0][1].endswith("second")
    assert package.statements and package.calls["Package\\Box\\second"] == "Second%20Load.dtsx"
    run_package(spark, package, Tables(spark), tmp_path, compat="ssis")
    assert spark.table("made").count() == 1


def test_tree_with_a_broken_package(spark, tmp_path, capsys):
    import shutil

    from sluice.__main__ import main
    from sluice.plans.control import plan_tree, read_manifest, step_job
    from sluice.errors import PackageError

    shutil.copytree(SAMPLES / "tree", tmp_path / "in")
    (tmp_path / "in" / "plain" / "broken.dtsx").write_text("<not valid")
    args = ["run-tree", str(tmp_path / "in"), "--tables", SF, "--manifest", str(tmp_path / "m.json")]
    assert main([*args, "--plan-only"]) == 1 and "broken.dtsx" in capsys.readouterr().err
    manifest = read_manifest((tmp_path / "m.json").read_text())
    assert {e["job"] for e in manifest["entries"]} >= {"main", "first", "plain_a"} and manifest["failed"]
    assert step_job({"entries": [{"package": "x/a.dtsx", "job": "1"}, {"package": "y/a.dtsx", "job": "2"}]}, "a.dtsx") == (None, ["1", "2"])
    assert main(["resolve-step", str(tmp_path / "m.json"), "/F first.dtsx"]) == 0 and main(["resolve-step", str(tmp_path / "m.json"), "/F none.dtsx"]) == 1
    alone = plan_tree(SAMPLES / "tree", orchestrate=False)
    assert not alone.entries and not any(alone.jobs.values())
    assert main(args, spark) == 1
    for text in ("{", "[]", '{"version": 2, "entries": []}', '{"version": 1, "entries": [{"package": "../a.dtsx", "job": "a"}]}'):
        with pytest.raises(PackageError):
            read_manifest(text)


def test_jdbc_names(spark):
    """Names and options of a JDBC source, without a server."""
    with pytest.raises(Exception, match="(?i)driver|jdbc|suitable"):
        Tables(spark, jdbc={"url": "jdbc:none:x"}, qualify=True).read("[t]", "db")
