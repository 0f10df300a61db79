"""Registered queries of package files, files and tables written and read again, orders, fallbacks and jobs.

The packages are in ``samples``.  Orders are compared by a position column.
"""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import Expressions, register_function
from .plans import Flow, Package, plan
from .plans.control import plan_tree, run_package, run_tree, step_job, step_package
from .plans.run import OPERATORS, Context, Rel, Result, context, run
from .queries import ORACLE_SQL, QUERIES, derived, query
from .sources import Tables, scratch_dir
from .sources.dtsx import read_package, read_project

SAMPLES = Path(__file__).resolve().parent / "samples"


def register(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _context(spark: SparkSession, sf_dir: str, package: Package | None = None, **more) -> Context:
    return context(spark, Tables(spark, sf_dir), package, **more)


def packaged(name: str, file: str, sql: str, read: str, compat: str = "reference", strict: bool = True) -> None:
    """A query of the first flow of a sample package."""

    @register(name, sql)
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        package = read_package(SAMPLES / file)
        return plan(package.flows[0], _context(spark, sf_dir, package, compat=compat, strict=strict)).df(read)


def numbered(df: DataFrame) -> DataFrame:
    """With the position of each row in the order that a sink gives (small results only: one task counts)."""
    at = df.withColumn("__at", F.monotonically_increasing_id())
    return at.withColumn("position", F.row_number().over(Window.orderBy("__at"))).drop("__at")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Package files
packaged("pkg_legacy_identifiers", "legacy.dtsx", "SELECT n_name AS name, CAST(n_nationkey * 2 AS INTEGER) AS twice FROM nation", "Target")
packaged("pkg_aggregate_hints", "aggregate.dtsx", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders GROUP BY 1, 2", "Aggregate")
packaged("pkg_lookup_one_output", "lookup.dtsx", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", "Target")
_MERGED = "SELECT row_number() OVER (ORDER BY k) AS position, k FROM (SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation)"
_CODES = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS code FROM customer"
packaged("pkg_error_rows", "errors.dtsx", f"SELECT * FROM ({_CODES}) WHERE c_custkey % 3 = 0", "Bad", "ssis")
packaged("pkg_good_rows", "errors.dtsx", "SELECT c_custkey, CAST(c_custkey AS INTEGER) AS number FROM customer WHERE c_custkey % 3 <> 0", "Good", "ssis")


@register("pkg_merge_order", _MERGED)
def _merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    package = read_package(SAMPLES / "merge.dtsx")
    return numbered(plan(package.flows[0], _context(spark, sf_dir, package, compat="ssis", strict=True)).df("Target"))


@register("pkg_project_scope", "SELECT n_nationkey, n_name, 'Sales' AS project, 'Lake' AS catalog, 1 AS hidden FROM nation WHERE n_regionkey = 2")
def _project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project parameters, the shared connection of the project, and names under its database."""
    package, project = read_package(SAMPLES / "project" / "load.dtsx"), read_project(SAMPLES / "project")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tables = Tables(spark, None, {"lake.dbo.nation": nation}, qualify=True)
    out = plan(package.flows[0], context(spark, tables, package, strict=True)).df("Target")
    catalog = package.flows[0].nodes["Nations"].options["database"]
    hidden = int(project.packages == ["load.dtsx"] and ("$Project", "Password") in package.sensitive)
    return out.withColumns({"project": F.lit(project.name), "catalog": F.lit(catalog), "hidden": F.lit(hidden)})


@register("pkg_flat_files", "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice FROM orders WHERE o_orderkey < 4000")
def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package writes a flat file, another reads it with the types of its connection."""
    tables = Tables(spark, sf_dir, files=scratch_dir(spark, "flat"))
    run_package(spark, read_package(SAMPLES / "flat_write.dtsx"), tables, strict=True)
    package = read_package(SAMPLES / "flat_read.dtsx")
    return plan(package.flows[0], context(spark, tables, package, strict=True)).df("Target")


# Sources and destinations
@register("src_flat_file", "SELECT r_regionkey, r_name FROM region")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    ctx = _context(spark, sf_dir, strict=True)
    both = {"sep": ";", "path": path}
    run(Flow().add("s", "source", table="region", columns=["r_regionkey", "r_name"]).add("o", "destination", "s", mapping={"r_regionkey": "r_regionkey", "r_name": "r_name"}, format="csv", **both), ctx)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ctx.tables.read("region").select("r_regionkey", "r_name").schema)
    return plan(Flow().add("f", "flat_source", schema=schema, **both), ctx).df("f")


@register("dest_append", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, ctx = scratch_dir(spark, "append"), _context(spark, sf_dir, strict=True)
    flow = Flow().add("s", "source", table="supplier").add("o", "destination", "s", mapping={"s_suppkey": "s_suppkey", "s_name": "s_name"}, path=path)
    run(flow, ctx)
    run(flow, ctx)
    return spark.read.parquet(path)


@register("dest_several", "SELECT 'high' AS sink, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_totalprice >= 200000 UNION ALL SELECT 'rest', count(*), max(o_totalprice) FROM orders WHERE o_totalprice < 200000 UNION ALL SELECT 'seen', count(*), NULL FROM orders")
def _several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sinks of one split, written by two actions, and the row count before it."""
    path, ctx = scratch_dir(spark, "sinks"), _context(spark, sf_dir, strict=True)
    flow = Flow().add("s", "source", table="orders", columns=["o_orderkey", "o_totalprice"]).add("n", "row_count", "s", variable="seen").add("c", "conditional_split", "n", conditions={"high": "[o_totalprice] >= 200000"})
    flow.add("a", "destination", "c.high", path=f"{path}/high").add("b", "destination", "c.default", path=f"{path}/rest")
    seen = run(flow, ctx).count("seen")
    sinks = [spark.read.parquet(f"{path}/{k}").agg(F.lit(k).alias("sink"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most")) for k in ("high", "rest")]
    return sinks[0].unionByName(sinks[1]).unionByName(_rows(spark, [("seen", seen, None)], "sink string, n long, most double"))


@register("src_unresolved", "SELECT r_regionkey FROM region")
def _unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source without SQL or table, and what depends on it, are left out; the other branch is a preview without a destination."""
    flow = Flow().add("lost", "source").add("after", "sort", "lost", keys=[("x", True)]).add("s", "source", table="region", columns=["r_regionkey"])
    ctx = _context(spark, sf_dir)
    result = plan(flow, ctx)
    if len(ctx.warnings) != 3:
        raise AssertionError(ctx.warnings)
    return result.preview()


# Orders
_ORDERED = "SELECT row_number() OVER (ORDER BY event_type DESC, event_id) AS position, event_id, event_type FROM events"


@register("sort_order", _ORDERED)
def _sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(QUERIES["sort_sink"](spark, sf_dir))


@register("sort_order_mapped", "SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey DESC) AS position, c_mktsegment AS segment, c_custkey AS id FROM customer")
def _sort_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a sort goes on through a multicast to a destination that renames its columns."""
    flow = Flow().add("s", "source", table="customer", columns=["c_custkey", "c_mktsegment"]).add("t", "sort", "s", keys=[("c_mktsegment", True), ("c_custkey", False)])
    flow.add("m", "multicast", "t", ports=["one"]).add("o", "destination", "m.one", mapping={"c_mktsegment": "segment", "c_custkey": "id"})
    return numbered(plan(flow, _context(spark, sf_dir, strict=True)).df("o"))


query("sort_distinct_ssis", "SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2",
      lambda f: f.add("s", "source", table="orders", columns=["o_orderstatus", "o_orderkey", "o_orderpriority"]).add("t", "sort", "s", keys=[("o_orderstatus", True), ("o_orderpriority", True)], distinct=True), "t", "ssis")

# Joins
_PAIR = lambda how, keys: lambda f: (f.add("a", "source", sql="SELECT ps AS k, x AS m, 'a' AS side_a FROM (SELECT c_nationkey AS ps, c_custkey % 4 AS x FROM customer WHERE c_custkey <= 60)")
                                     .add("b", "source", sql="SELECT n_nationkey AS k, n_regionkey AS m, n_name FROM nation").add("j", "merge_join", named={"Left": "a", "Right": "b"}, how=how, **keys))
_A = "(SELECT c_nationkey AS k, c_custkey % 4 AS m, 'a' AS side_a FROM customer WHERE c_custkey <= 60) a"
_B = "(SELECT n_nationkey AS k, n_regionkey AS m, n_name FROM nation) b"
query("mergejoin_n_keys", f"SELECT a.k, a.m, side_a, n_name FROM {_A} JOIN {_B} ON a.k = b.k", _PAIR("inner", {"n_keys": 1}), "j")
query("mergejoin_all_keys", f"SELECT a.k, a.m, side_a, n_name FROM {_A} LEFT JOIN {_B} ON a.k = b.k AND a.m = b.m", _PAIR(1, {}), "j")
query("mergejoin_missing_column", f"SELECT side_a, n_name, CAST(NULL AS VARCHAR) AS nowhere FROM {_A} JOIN {_B} ON a.k = b.k AND a.m = b.m", _PAIR("inner", {"columns": ["side_a", "n_name", "nowhere"]}), "j")
_NOKEY = lambda how: lambda f: f.add("a", "source", sql="SELECT r_name FROM region WHERE r_regionkey > 9").add("b", "source", table="nation", columns=["n_name"]).add("j", "merge_join", "a", "b", how=how)
query("mergejoin_full_no_keys", "SELECT NULL AS r_name, n_name FROM nation", _NOKEY("full"), "j")
query("mergejoin_left_no_keys", "SELECT r_name, n_name FROM region LEFT JOIN nation ON true WHERE r_regionkey > 9", _NOKEY("left"), "j")
query("lookup_no_keys", "SELECT o_orderkey FROM orders", lambda f: f.add("s", "source", table="orders", columns=["o_orderkey"]).add("l", "lookup", "s", table="customer", take={"x": "c_name"}), "l.match")
query("lookup_all_found", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
      lambda f: f.add("s", "source", table="customer", columns=["c_custkey", "c_nationkey"]).add("l", "lookup", "s", table="nation", keys={"c_nationkey": "n_nationkey"}, take={"n_name": "n_name"}, on_missing="fail", small=True).add("o", "destination", "l.match", mapping={"c_custkey": "c_custkey", "n_name": "n_name"}), "o", "ssis")
query("lookup_first_of_many", "SELECT o_orderkey, l_quantity AS qty FROM orders JOIN (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem) ON o_orderkey = l_orderkey WHERE r = 1",
      lambda f: f.add("s", "source", table="orders", columns=["o_orderkey"]).add("l", "lookup", "s", table="lineitem", keys={"o_orderkey": "l_orderkey"}, take={"qty": "l_quantity"}, order=["l_linenumber"]), "l.match", "ssis")

# Aggregates
query("agg_nothing", "SELECT n_nationkey FROM nation", lambda f: f.add("s", "source", table="nation", columns=["n_nationkey"]).add("a", "aggregate", "s"), "a")
query("agg_unknown_type", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2", lambda f: f.add("s", "source", table="orders").add("a", "aggregate", "s", by=[("o_orderstatus", "s")], values={"p": ("median", "o_orderpriority"), "n": ("count_all", None)}), "a")
query("agg_only_groups", "SELECT DISTINCT o_orderstatus FROM orders", lambda f: f.add("s", "source", table="orders").add("a", "aggregate", "s", by=["o_orderstatus"]), "a")


# Fallbacks
def _lenient(name: str, sql: str, build: Callable[[Flow], Flow], read: str, warned: str) -> None:
    """A flow with a fault that must be warned of and leave the rest as it is."""

    @register(name, sql)
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = _context(spark, sf_dir)
        result = plan(build(Flow(name)), ctx)
        if not any(warned in w for w in ctx.warnings):
            raise AssertionError(ctx.warnings)
        return result.df(read)


_lenient("split_bad_condition", "SELECT n_nationkey FROM nation WHERE n_nationkey <= 3", lambda f: f.add("s", "source", table="nation", columns=["n_nationkey"]).add("c", "conditional_split", "s", conditions={"bad": "NOPE([n_nationkey])", "big": "[n_nationkey] > 3"}), "c.default", "the condition is false")
_lenient("derived_bad_expression", "SELECT r_regionkey, CAST(NULL AS INTEGER) AS x, r_regionkey + 1 AS y FROM region", lambda f: f.add("s", "source", table="region", columns=["r_regionkey"]).add("d", "derived_column", "s", expressions={"x": ("NOPE(1)", "i4"), "y": "[r_regionkey] + 1"}), "d", "the column is null")
_lenient("isolated_failure", "SELECT r_regionkey FROM region", lambda f: f.add("s", "source", table="region", columns=["r_regionkey"]).add("x", "sort", "s", keys=[("nowhere", True)]).add("after", "sort", "x", keys=[("r_regionkey", True)]), "s", "not fully connected")
_lenient("unknown_kind", "SELECT r_regionkey FROM region", lambda f: f.add("s", "source", table="region", columns=["r_regionkey"]).add("x", "something_new", "s"), "s", "no operator for kind")
_lenient("unmapped_destination", "SELECT r_regionkey, r_name FROM region", lambda f: f.add("s", "source", table="region", columns=["r_regionkey", "r_name"]).add("o", "destination", "s"), "o", "all are written by name")

# Expressions
derived("derived_now", "region", "r_regionkey", {"g_today": 'DATEDIFF("dd", GETDATE(), GETDATE())', "g_utc": 'ABS(DATEDIFF("hh", GETUTCDATE(), GETDATE())) < 15 ? 1 : 0', "g_year": "YEAR(GETDATE()) > 2020 && YEAR(GETUTCDATE()) > 2020 ? 1 : 0"},
        "SELECT r_regionkey, 0 AS g_today, 1 AS g_utc, 1 AS g_year FROM region")
derived("derived_isnumeric", "customer", "c_custkey", {"i_name": "ISNUMERIC([c_name])", "i_key": "ISNUMERIC((DT_WSTR,20)[c_custkey])", "i_mix": 'ISNUMERIC([c_custkey] % 2 == 0 ? "12.5" : "1x")', "i_null": 'ISNUMERIC([c_custkey] > 5 ? NULL(DT_WSTR,3) : "7")'},
        "SELECT c_custkey, 0 AS i_name, 1 AS i_key, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS i_mix, CASE WHEN c_custkey > 5 THEN 0 ELSE 1 END AS i_null FROM customer")
derived("derived_precedence", "part", "p_partkey", {
    "x_mul": "1 + 2 * [p_size] - 4", "x_par": "(1 + 2) * [p_size]", "x_bit": "[p_size] & 3 | 8 ^ 1", "x_neg": "-[p_size] + ~[p_size]", "x_cmp": "[p_size] + 1 > 20 && [p_size] * 2 <= 90 || [p_size] == 1 ? 1 : 0", "x_cast": "(DT_I4)12.7 + [p_size]",
    "x_nest": '[p_size] > 40 ? "a" : [p_size] > 20 ? "b" : "c"', "x_not": "!([p_size] > 25) ? 1 : 0", "x_esc": '"a\\tb\\x0041" + "q"'},
    "SELECT p_partkey, 1 + 2 * p_size - 4 AS x_mul, 3 * p_size AS x_par, xor((p_size & 3), 0) | xor(8, 1) AS x_bit, -p_size + ~p_size AS x_neg, CASE WHEN p_size + 1 > 20 AND p_size * 2 <= 90 OR p_size = 1 THEN 1 ELSE 0 END AS x_cmp, 12 + p_size AS x_cast, "
    "CASE WHEN p_size > 40 THEN 'a' WHEN p_size > 20 THEN 'b' ELSE 'c' END AS x_nest, CASE WHEN NOT p_size > 25 THEN 1 ELSE 0 END AS x_not, 'a' || chr(9) || 'bAq' AS x_esc FROM part")
derived("derived_null_call", "region", "r_regionkey", {"u_none": "ISNULL(NULL(DT_I4)) ? 1 : 0", "u_text": ("NULL(DT_WSTR,5)", "wstr", 5)}, "SELECT r_regionkey, 1 AS u_none, CAST(NULL AS VARCHAR) AS u_text FROM region")


@register("expression_errors", "SELECT * FROM (VALUES ('[a] +'), ('#{x}'), ('FOO([a])'), ('LEN()'), ('\"open'), ('[nope]'), ('DATEPART(\"zz\", [a])'), ('(1')) t(text)")
def _expression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that do not compile, of a list that also holds good ones."""
    from .errors import ExpressionError

    schema = spark.createDataFrame([], "a int").schema
    bad = []
    for text in ("[a] +", "#{x}", "FOO([a])", "LEN()", '"open', "[nope]", 'DATEPART("zz", [a])', "(1", "[a] + 1", "ISNULL([a])", "(DT_I4)[a]"):
        try:
            Expressions(schema).value(text)
        except ExpressionError:
            bad.append((text,))
    return _rows(spark, bad, "text string")


# Audit, extensions
@register("audit_identifiers", "SELECT 'row' AS per, count(*) AS n, count(*) AS runs, 1 AS starts, 1 AS hosts FROM nation UNION ALL SELECT 'run', count(*), 1, 1, 1 FROM nation")
def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers are new for each row in reference mode and for each run in ssis mode."""
    flow = Flow().add("s", "source", table="nation", columns=["n_name"]).add("a", "audit", "s", columns={"id": "execution_id", "at": "start_time", "host": "machine"})
    out = []
    for per, compat in (("row", "reference"), ("run", "ssis")):
        df = plan(flow, _context(spark, sf_dir, compat=compat, strict=True)).df("a")
        out.append(df.agg(F.lit(per).alias("per"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("runs"), F.count_distinct("at").cast("int").alias("starts"), F.count_distinct("host").cast("int").alias("hosts")))
    return out[0].unionByName(out[1])


@register("extension", "SELECT s_suppkey, s_acctbal * 3 AS trebled FROM supplier WHERE s_suppkey % 2 = 1")
def _extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator and a function that a user adds."""
    register_function("TREBLE", lambda x: x * 3, "float")
    OPERATORS["every_second"] = lambda ctx, node, ins: {"out": Rel(ins[0][1].df.where(f"{node.options['key']} % 2 = 1"))}
    flow = Flow().add("s", "source", table="supplier", columns=["s_suppkey", "s_acctbal"]).add("h", "every_second", "s", key="s_suppkey").add("d", "derived_column", "h", expressions={"trebled": "TREBLE([s_acctbal])"})
    return plan(flow.add("o", "destination", "d", mapping={"s_suppkey": "s_suppkey", "trebled": "trebled"}), _context(spark, sf_dir, strict=True)).df("o")


# Packages that call packages, and jobs
@register("call_order", "SELECT * FROM (VALUES (1, 'first out', (SELECT count(*) FROM region)), (2, 'second out', (SELECT count(*) FROM nation))) t(position, sink, n)")
def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package calls two others, named in other cases and encoded; the one in a container waits for the other."""
    results: list[Result] = run_package(spark, read_package(SAMPLES / "tree" / "main.dtsx"), Tables(spark, sf_dir), SAMPLES / "tree")
    return _rows(spark, [(k, sink, r.df(sink).count()) for k, r in enumerate(results, 1) for sink in r.sinks], "position int, sink string, n long")


@register("call_cycle", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(position, task)")
def _cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that wait for each other run as declared."""
    from .plans.control import _ordered

    package = Package("p", calls={"a": "a.dtsx", "b": "b.dtsx"}, precedence=[("a", "b", "success"), ("b", "a", "completion")])
    return _rows(spark, [(k, t) for k, t in enumerate(_ordered(package, []), 1)], "position int, task string")


@register("tree_jobs", "SELECT * FROM (VALUES ('main', 1, 'first'), ('main', 2, 'second_load'), ('mixed_main_orchestrator', 1, 'mixed_part'), ('plain_main', 1, 'plain_a'), ('plain_main', 2, 'plain_b_load'), ('plain_main', 3, 'plain_b_load_2')) t(job, position, called)")
def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs call which, for a folder with a main package, one with flows of its own in it, and one without."""
    jobs = plan_tree(SAMPLES / "tree").jobs
    return _rows(spark, [(job, k, c) for job, calls in jobs.items() for k, c in enumerate(calls, 1)], "job string, position int, called string")


@register("tree_run", "SELECT 'first' AS job, count(*) AS n FROM region UNION ALL SELECT 'second_load', count(*) FROM nation UNION ALL SELECT 'mixed_main', count(*) FROM region UNION ALL SELECT 'mixed_part', count(*) FROM nation UNION ALL SELECT 'plain_a', count(*) FROM nation UNION ALL SELECT 'plain_b_load', count(*) FROM region UNION ALL SELECT 'plain_b_load_2', count(*) FROM region")
def _tree_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = run_tree(spark, plan_tree(SAMPLES / "tree"), Tables(spark, sf_dir))
    return _rows(spark, [(job, sum(r.df(s).count() for r in results for s in r.sinks)) for job, results in done.items() if results], "job string, n long")


_STEPS = (
    r'dtexec /FILE "C:\etl\first.dtsx" /CHECKPOINTING OFF', r'/F "D:\x\mixed\part" /REPORTING E', r"/ISSERVER \SSISDB\sales\PART.DTSX", r"/SQ plain\a", "/SQUASH first.dtsx", "/FILE %HOME%/first.dtsx",
    "/FILE first.dtsx /CONFIGFILE c.xml", "/FILE main.dtsx", "/SQL other.dtsx",
)


@register("job_steps", "SELECT * FROM (VALUES (1, 'first', ''), (2, 'mixed_part', ''), (3, 'mixed_part', ''), (4, 'plain_a', ''), (5, NULL, 'no package'), (6, NULL, 'environment variable'), (7, NULL, 'configuration file'), (8, 'main', ''), (9, NULL, '')) t(step, job, reason)")
def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs that commands of scheduled steps run, by the manifest of a tree."""
    manifest, rows = json.loads(plan_tree(SAMPLES / "tree").manifest()), []
    for k, command in enumerate(_STEPS, 1):
        path, reason = step_package(command)
        rows.append((k, step_job(manifest, path)[0] if path else None, reason))
    return _rows(spark, rows, "step int, job string, reason string")


@register("command_line", "SELECT * FROM (VALUES ('inspect', 0), ('run', 0), ('run-tree', 0), ('missing', 2), ('not a folder', 2)) t(command, code)")
def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .__main__ import main

    calls = {"inspect": ["inspect", f"{SAMPLES}/legacy.dtsx"], "run": ["run", f"{SAMPLES}/tree/main.dtsx", "--tables", sf_dir], "run-tree": ["run-tree", f"{SAMPLES}/tree", "--tables", sf_dir], "missing": ["run", f"{SAMPLES}/none.dtsx"], "not a folder": ["run-tree", f"{SAMPLES}/none"]}
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        codes = [(k, main(argv, spark)) for k, argv in calls.items()]
    return _rows(spark, codes, "command string, code int")
