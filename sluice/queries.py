"""The registered queries: one for each operator and feature, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import Flow, Package, plan
from .plans.run import context
from .sources import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, build: Callable[[Flow], Flow], read: str = "out", compat: str = "reference", package: Package | None = None, tables: Callable[[SparkSession, str], dict[str, DataFrame]] | None = None) -> None:
    """Register a flow; ``read`` names the port or sink whose rows are the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = context(spark, Tables(spark, sf_dir, tables(spark, sf_dir) if tables else {}), package, compat, strict=True)
        return plan(build(Flow(name)), ctx).df(read)

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def derived(name: str, table: str, keys: str, expressions: dict, sql: str, compat: str = "reference") -> None:
    query(name, sql, lambda f: f.add("s", "source", table=table).add("d", "derived_column", "s", expressions=expressions).add("o", "destination", "d", mapping={c: c for c in [*keys.split(), *expressions]}), "o", compat)


query("src_table", "SELECT o_orderkey AS order_id, o_custkey AS cust_id, o_totalprice AS total FROM orders",
      lambda f: f.add("s", "source", table="[dbo].[orders]", columns=["o_orderkey", "o_custkey", "o_totalprice"]).add("o", "destination", "s", mapping={"o_orderkey": "order_id", "o_custkey": "cust_id", "o_totalprice": "total"}), "o")
query("src_sql_command", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30",
      lambda f: f.add("s", "source", sql="SELECT [l_orderkey], [l_linenumber], [l_quantity] FROM [dbo].[lineitem] WHERE [l_returnflag] = N'R' AND [l_quantity] > 30 ORDER BY [l_quantity] DESC;", columns=["l_orderkey", "l_linenumber", "l_quantity"]), "s")
query("src_sql_variable", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
      lambda f: f.add("s", "source", variable=("User", "Sql")), "s", package=Package("p", variables={("User", "Sql"): ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", "18")}))

derived("derived_arith", "lineitem", "l_orderkey l_linenumber", {
    "a_sum": "[l_linenumber] + 3", "a_div": "[l_linenumber] / 2", "a_mod": "-[l_linenumber] % 3", "a_mul": "([l_linenumber] - 5) * 2", "a_neg": "-[l_linenumber]",
    "a_net": ("(DT_NUMERIC,18,4)[l_extendedprice] * (1 - (DT_NUMERIC,18,4)[l_discount])", "numeric", None, 18, 4)},
    "SELECT l_orderkey, l_linenumber, l_linenumber + 3 AS a_sum, CAST(trunc(l_linenumber / 2) AS BIGINT) AS a_div, (-l_linenumber) % 3 AS a_mod, (l_linenumber - 5) * 2 AS a_mul, -l_linenumber AS a_neg, "
    "CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS a_net FROM lineitem")
derived("derived_string", "customer", "c_custkey", {
    "s_cat": '[c_name] + "/" + [c_mktsegment]', "s_up": "UPPER(TRIM([c_name]))", "s_low": "LOWER([c_mktsegment])", "s_sub": "SUBSTRING([c_name], 3, 5)", "s_sub0": "SUBSTRING([c_name], 0, 3)",
    "s_left": "LEFT([c_name], 4) + RIGHT([c_name], 3)", "s_len": "LEN([c_name])", "s_rep": 'REPLACE([c_mktsegment], "BUILD", "MAK")', "s_rev": "REVERSE([c_mktsegment])",
    "s_find": 'FINDSTRING([c_name], "0", 1)', "s_code": "CODEPOINT([c_name])", "s_twice": 'REPLICATE("ab", 2) + LTRIM("  x") + RTRIM("y  ")'},
    "SELECT c_custkey, c_name || '/' || c_mktsegment AS s_cat, upper(trim(c_name)) AS s_up, lower(c_mktsegment) AS s_low, substr(c_name, 3, 5) AS s_sub, substr(c_name, 1, 2) AS s_sub0, left(c_name, 4) || right(c_name, 3) AS s_left, "
    "CAST(length(c_name) AS INTEGER) AS s_len, replace(c_mktsegment, 'BUILD', 'MAK') AS s_rep, reverse(c_mktsegment) AS s_rev, CAST(instr(c_name, '0') AS INTEGER) AS s_find, unicode(c_name) AS s_code, 'ababxy' AS s_twice FROM customer")
derived("derived_find_kth", "customer", "c_custkey", {"k2": 'FINDSTRING([c_name], "0", 2)'},
        "SELECT c_custkey, CAST(CASE WHEN instr(c_name, '0') = 0 OR instr(substr(c_name, instr(c_name, '0') + 1), '0') = 0 THEN 0 ELSE instr(c_name, '0') + instr(substr(c_name, instr(c_name, '0') + 1), '0') END AS INTEGER) AS k2 FROM customer", "ssis")
derived("derived_null", "orders", "o_orderkey", {
    "n_is": '[o_orderstatus] == "F" ? NULL(DT_I4) : 1', "n_val": 'ISNULL([o_orderstatus] == "F" ? NULL(DT_WSTR,5) : [o_orderstatus])', "n_rep": 'REPLACENULL([o_orderstatus] == "F" ? NULL(DT_WSTR,5) : [o_orderstatus], "none")',
    "n_pred": '([o_orderstatus] == "F" ? NULL(DT_I4) : 2) > 1'},
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 1 END AS n_is, CASE WHEN nullif(o_orderstatus, 'F') IS NULL THEN 1 ELSE 0 END AS n_val, coalesce(nullif(o_orderstatus, 'F'), 'none') AS n_rep, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS n_pred FROM orders")
derived("derived_ternary", "orders", "o_orderkey", {
    "t_size": '[o_totalprice] > 200000 ? "big" : [o_totalprice] > 100000 ? "mid" : "small"', "t_and": '[o_totalprice] > 1000 && !([o_orderstatus] == "O") || FALSE', "t_cmp": '([o_orderpriority] >= "3") == TRUE'},
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS t_size, CASE WHEN o_totalprice > 1000 AND NOT (o_orderstatus = 'O') THEN 1 ELSE 0 END AS t_and, CASE WHEN o_orderpriority >= '3' THEN 1 ELSE 0 END AS t_cmp FROM orders")
derived("derived_bitwise", "part", "p_partkey", {"b_and": "[p_size] & 12", "b_or": "[p_size] | 3", "b_xor": "[p_size] ^ 5", "b_not": "~[p_size]"},
        "SELECT p_partkey, p_size & 12 AS b_and, p_size | 3 AS b_or, xor(p_size, 5) AS b_xor, ~p_size AS b_not FROM part")
derived("derived_math", "part", "p_partkey", {
    "m_abs": "ABS(10 - [p_size])", "m_sq": "SQUARE([p_size])", "m_pow": "POWER([p_size], 2)", "m_sqrt": ("SQRT([p_size] * 1.0)", "r8"), "m_ceil": ("CEILING([p_retailprice])", "i8"), "m_floor": ("FLOOR([p_retailprice])", "i8"),
    "m_sign": ("SIGN(20 - [p_size])", "i4"), "m_round": ("ROUND((DT_NUMERIC,18,4)[p_retailprice], 1)", "numeric", None, 18, 1), "m_num": "ISNUMERIC([p_brand])", "m_ln": ("ROUND(LN([p_size]) + LOG([p_size]) + EXP(0), 6)", "r8")},
    "SELECT p_partkey, abs(10 - p_size) AS m_abs, CAST(p_size AS DOUBLE) * p_size AS m_sq, pow(p_size, 2) AS m_pow, sqrt(p_size) AS m_sqrt, CAST(ceil(p_retailprice) AS BIGINT) AS m_ceil, CAST(floor(p_retailprice) AS BIGINT) AS m_floor, "
    "CAST(sign(20 - p_size) AS INTEGER) AS m_sign, CAST(round(CAST(p_retailprice AS DECIMAL(18,4)), 1) AS DECIMAL(18,1)) AS m_round, 0 AS m_num, round(ln(p_size) + log10(p_size) + 1, 6) AS m_ln FROM part")
_PARTS = {"year": "yyyy", "quarter": "qq", "month": "mm", "day": "dd", "dayofyear": "dy", "hour": "hh", "minute": "mi", "second": "ss", "millisecond": "ms"}
derived("derived_datepart", "events", "event_id", {f"p_{k}": f'DATEPART("{v}", [ts])' for k, v in _PARTS.items()} | {"p_weekday": 'DATEPART("dw", [ts])', "p_week": 'DATEPART("wk", [ts])', "p_y": "YEAR([ts]) * 10000 + MONTH([ts]) * 100 + DAY([ts])"},
        "SELECT event_id, " + ", ".join(f"CAST({'millisecond(ts) % 1000' if k == 'millisecond' else f'{k}(ts)'} AS INTEGER) AS p_{k}" for k in _PARTS) +
        ", CAST(dayofweek(ts) + 1 AS INTEGER) AS p_weekday, CAST((dayofyear(ts) + dayofweek(date_trunc('year', ts)) - 1) // 7 + 1 AS INTEGER) AS p_week, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INTEGER) AS p_y FROM events")
derived("derived_dateadd", "events", "event_id", {"a_m": 'DATEADD("mm", 1, [ts])', "a_d": 'DATEADD("dd", -3, [ts])', "a_h": 'DATEADD("hh", 5, [ts])', "a_y": 'DATEADD("yy", 1, [ts])', "a_q": 'DATEADD("qq", 1, [ts])', "a_w": 'DATEADD("wk", 2, [ts])'},
        "SELECT event_id, ts + INTERVAL 1 MONTH AS a_m, ts - INTERVAL 3 DAY AS a_d, ts + INTERVAL 5 HOUR AS a_h, ts + INTERVAL 1 YEAR AS a_y, ts + INTERVAL 3 MONTH AS a_q, ts + INTERVAL 14 DAY AS a_w FROM events")
_DIFFS = {"year": "yy", "quarter": "qq", "month": "mm", "day": "dd", "hour": "hh", "minute": "mi", "second": "ss"}
derived("derived_datediff", "orders", "o_orderkey", {f"d_{k}": f'DATEDIFF("{v}", [o_orderdate], (DT_DBTIMESTAMP)"1998-01-01 00:00:00")' for k, v in _DIFFS.items()} | {"d_week": 'DATEDIFF("wk", [o_orderdate], (DT_DBTIMESTAMP)"1998-01-01 00:00:00")'},
        "SELECT o_orderkey, " + ", ".join(f"CAST(date_diff('{k}', o_orderdate, TIMESTAMP '1998-01-01') AS INTEGER) AS d_{k}" for k in _DIFFS) +
        ", CAST(floor(date_diff('day', DATE '1899-12-31', DATE '1998-01-01') / 7) - floor(date_diff('day', DATE '1899-12-31', CAST(o_orderdate AS DATE)) / 7) AS INTEGER) AS d_week FROM orders")
query("data_convert", "SELECT p_partkey, CAST(trunc(p_retailprice) AS INTEGER) AS as_int, CAST(p_size AS VARCHAR) AS as_text, left(p_name, 5) AS cut, CAST(p_retailprice AS DECIMAL(18,2)) AS as_dec, CAST(p_size AS DOUBLE) AS as_dbl FROM part",
      lambda f: f.add("s", "source", table="part").add("c", "data_conversion", "s", conversions={"as_int": ("p_retailprice", "i4"), "as_text": ("p_size", "wstr", 20), "cut": ("p_name", "str", 5), "as_dec": ("p_retailprice", "numeric", None, 18, 2), "as_dbl": ("p_size", "r8")})
      .add("o", "destination", "c", mapping={c: c for c in ("p_partkey", "as_int", "as_text", "cut", "as_dec", "as_dbl")}), "o")
query("copy_column", "SELECT r_regionkey, r_name, r_name AS copy_name FROM region", lambda f: f.add("s", "source", table="region").add("c", "copy_column", "s", copies={"copy_name": "r_name"}), "c")
query("replace_column", "SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey + 1 AS n_regionkey FROM nation",
      lambda f: f.add("s", "source", table="nation").add("d", "derived_column", "s", expressions={"N_NAME": "LOWER([n_name])", "n_regionkey": "[n_regionkey] + 1"}), "d")

_SPLIT = lambda f: f.add("s", "source", table="orders", columns=["o_orderkey", "o_totalprice"]).add("c", "conditional_split", "s", conditions={"high": "[o_totalprice] >= 200000", "mid": "[o_totalprice] >= 100000 && [o_totalprice] < 200000"})
query("split_high", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000", _SPLIT, "c.high")
query("split_mid", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice >= 200000) AND o_totalprice >= 100000 AND o_totalprice < 200000", _SPLIT, "c.mid")
query("split_default", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 100000", _SPLIT, "c.default")
_HOLES = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price FROM orders"
_SPLIT_NULL = lambda f: f.add("s", "source", sql=_HOLES).add("c", "conditional_split", "s", conditions={"high": "[price] >= 100000"})
query("split_null_reference", "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice < 100000", _SPLIT_NULL, "c.default")
query("split_null_default", f"SELECT * FROM ({_HOLES}) WHERE price IS NULL OR price < 100000", _SPLIT_NULL, "c.default", "ssis")

_CUST = {"keys": {"o_custkey": "c_custkey"}, "take": {"segment": "c_mktsegment"}, "sql": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0"}
_LOOK = lambda f: f.add("s", "source", table="orders", columns=["o_orderkey", "o_custkey"]).add("l", "lookup", "s", **_CUST)
query("lookup_match", "SELECT o_orderkey, o_custkey, c_mktsegment AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey", _LOOK, "l.match")
query("lookup_match_ssis", "SELECT o_orderkey, o_custkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0", _LOOK, "l.match", "ssis")
query("lookup_nomatch", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", _LOOK, "l.nomatch")
_DUP = lambda f: f.add("s", "source", table="customer", columns=["c_custkey", "c_nationkey"]).add("l", "lookup", "s", table="supplier", keys={"c_nationkey": "s_nationkey"}, take={"s_suppkey": "s_suppkey"}, order=["s_suppkey"])
query("lookup_dup_keys", "SELECT c_custkey, c_nationkey, s_suppkey FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey", _DUP, "l.match")
query("lookup_first_match", "SELECT c_custkey, c_nationkey, m AS s_suppkey FROM customer JOIN (SELECT s_nationkey, min(s_suppkey) AS m FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey", _DUP, "l.match", "ssis")
query("lookup_composite", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS qty FROM lineitem a LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'A') b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
      lambda f: f.add("s", "source", table="lineitem", columns=["l_orderkey", "l_linenumber"]).add("l", "lookup", "s", sql="SELECT * FROM lineitem WHERE l_returnflag = 'A'", keys={"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"}, take={"qty": "l_quantity"}), "l.match")


def _join(how: str, right: str, columns: list) -> Callable[[Flow], Flow]:
    return lambda f: (f.add("a", "source", sql="SELECT c_custkey, c_nationkey AS k FROM customer").add("b", "source", sql=right)
                      .add("j", "merge_join", named={"Left Input": "a", "Right Input": "b"}, how=how, columns=columns))


_FEW = "SELECT n_nationkey + 5 AS k, n_name FROM nation"
query("mergejoin_inner", f"SELECT c_custkey, c_nationkey AS k, n_name FROM customer JOIN ({_FEW}) ON c_nationkey = k", _join("inner", _FEW, ["c_custkey", "k", "n_name"]), "j")
query("mergejoin_left", f"SELECT c_custkey, c_nationkey AS k, n_name FROM customer LEFT JOIN ({_FEW}) ON c_nationkey = k", _join("left", _FEW, ["c_custkey", "k", "n_name"]), "j")
query("mergejoin_full", f"SELECT c_custkey, c_nationkey AS k, n_name FROM customer FULL JOIN ({_FEW}) n ON c_nationkey = n.k", _join("full", _FEW, ["c_custkey", "k", "n_name"]), "j")
query("mergejoin_cross", "SELECT r_name, n_name FROM region, nation", lambda f: f.add("a", "source", table="region", columns=["r_name"]).add("b", "source", table="nation", columns=["n_name"]).add("j", "merge_join", "a", "b"), "j")

query("agg_all", "SELECT l_returnflag AS flag, count(l_quantity) AS n_qty, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, min(l_quantity) AS least, max(l_quantity) AS most, avg(l_linenumber) AS mean, count(DISTINCT l_suppkey) AS n_supp FROM lineitem GROUP BY 1",
      lambda f: f.add("s", "source", table="lineitem").add("d", "derived_column", "s", expressions={"price": "(DT_NUMERIC,18,2)[l_extendedprice]"})
      .add("a", "aggregate", "d", by=[("l_returnflag", "flag")], values={"n_qty": ("count", "l_quantity"), "n": ("count_all", None), "total": ("sum", "price"), "least": ("min", "l_quantity"), "most": ("max", "l_quantity"), "mean": ("avg", "l_linenumber"), "n_supp": ("count_distinct", "l_suppkey")}), "a")
query("agg_global", "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders", lambda f: f.add("s", "source", table="orders").add("a", "aggregate", "s", values={"n": ("count", None), "most": ("max", "o_totalprice")}), "a")
query("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1", lambda f: f.add("s", "source", table="orders").add("a", "aggregate", "s", by=["o_orderstatus"], values={"n": ("count_distinct", "o_custkey")}), "a")
query("agg_null_group", "SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n FROM orders GROUP BY 1", lambda f: f.add("s", "source", sql="SELECT nullif(o_orderstatus, 'F') AS status FROM orders").add("a", "aggregate", "s", by=["status"], values={"n": ("count_all", None)}), "a")
query("sort_sink", "SELECT event_id, event_type FROM events", lambda f: f.add("s", "source", table="events", columns=["event_id", "event_type"]).add("t", "sort", "s", keys=[("event_type", False), ("event_id", True)]).add("o", "destination", "t", mapping={"event_id": "event_id", "event_type": "event_type"}), "o")
query("sort_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", lambda f: f.add("s", "source", table="orders", columns=["o_orderstatus", "o_orderpriority"]).add("t", "sort", "s", keys=[("o_orderstatus", True)], distinct=True), "t")
query("union_all", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer",
      lambda f: f.add("a", "source", sql="SELECT s_suppkey AS id, s_name AS name FROM supplier").add("b", "source", sql="SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer").add("u", "union_all", "a", "b"), "u")
query("union_missing_col", "SELECT s_suppkey AS id, s_acctbal AS bal FROM supplier UNION ALL SELECT c_custkey, NULL FROM customer",
      lambda f: f.add("a", "source", sql="SELECT s_suppkey AS id, s_acctbal AS bal FROM supplier").add("b", "source", sql="SELECT c_custkey AS ID FROM customer").add("u", "union_all", "a", "b", columns=["id", "bal"]), "u")
query("merge_union", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", lambda f: f.add("a", "source", sql="SELECT n_nationkey AS k FROM nation").add("b", "source", sql="SELECT r_regionkey AS k FROM region").add("u", "merge", "a", "b"), "u")
_MULTI = lambda f: f.add("s", "source", table="events", columns=["event_id", "event_type", "value"]).add("m", "multicast", "s", ports=["one", "two"]).add("c", "conditional_split", "m.one", conditions={"big": "[value] > 50"}).add("a", "aggregate", "m.two", by=["event_type"], values={"n": ("count_all", None)})
query("multicast_one", "SELECT event_id, event_type, value FROM events WHERE value > 50", _MULTI, "c.big")
query("multicast_two", "SELECT event_type, count(*) AS n FROM events GROUP BY 1", _MULTI, "a")
query("rowcount_passthrough", "SELECT event_id, value FROM events", lambda f: f.add("s", "source", table="events", columns=["event_id", "value"]).add("r", "row_count", "s", variable="User::Rows"), "r")
query("audit_static", "SELECT r_name, 'audit_package' AS pkg, 'Data Flow Task' AS task FROM region", lambda f: f.add("s", "source", table="region", columns=["r_name"]).add("a", "audit", "s", columns={"pkg": "package_name", "task": "task_name"}), "a", package=Package("audit_package"))
query("audit_run", None, lambda f: f.add("s", "source", table="region", columns=["r_name"]).add("a", "audit", "s", columns={"id": "execution_id", "at": "start_time", "host": "machine", "who": "user"}), "a")
query("fallback_passthrough", "SELECT n_nationkey, n_name FROM nation", lambda f: f.add("s", "source", table="nation", columns=["n_nationkey", "n_name"]).add("x", "oledb_command", "s"), "x")
query("character_map", "SELECT r_regionkey, r_name, upper(r_name) AS up, lower(r_name) AS low FROM region", lambda f: f.add("s", "source", table="region", columns=["r_regionkey", "r_name"]).add("x", "character_map", "s", maps={"up": ("r_name", "upper"), "low": ("r_name", "lower")}), "x")
query("pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1",
      lambda f: f.add("s", "source", table="orders").add("a", "aggregate", "s", by=["o_orderpriority", "o_orderstatus"], values={"n": ("count_all", None)}).add("p", "pivot", "a", by=["o_orderpriority"], on="o_orderstatus", values=["F", "O"], value="n"), "p")
query("unpivot", "SELECT c_custkey, 'c_name' AS what, c_name AS held FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer",
      lambda f: f.add("s", "source", table="customer").add("u", "unpivot", "s", ids=["c_custkey"], values=["c_name", "c_mktsegment"], name_column="what", value_column="held"), "u")
_VARS = Package("vars", variables={("User", "MinThreshold"): ("150000.5", "18"), ("$Project", "Factor"): ("2", "9"), ("User", "Factor"): ("3", "9")})
query("variable_param", "SELECT o_orderkey, 2 AS p, 3 AS u FROM orders WHERE o_totalprice > 150000.5",
      lambda f: f.add("s", "source", table="orders", columns=["o_orderkey", "o_totalprice"]).add("c", "conditional_split", "s", conditions={"yes": "[o_totalprice] > @[User::MinThreshold]"}).add("d", "derived_column", "c.yes", expressions={"p": "@[$Project::Factor]", "u": "@[User::Factor]"}).add("o", "destination", "d", mapping={"o_orderkey": "o_orderkey", "p": "p", "u": "u"}), "o", package=_VARS)


def _etl(f: Flow) -> Flow:
    f.add("orders", "source", table="orders", columns=["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    f.add("derive", "derived_column", "orders", expressions={"net_amount": ("(DT_NUMERIC,18,4)[o_totalprice] * 0.9", "numeric", None, 18, 4), "priority_clean": "UPPER(TRIM([o_orderpriority]))"})
    f.add("customer", "lookup", "derive", table="customer", keys={"o_custkey": "c_custkey"}, take={"tier": "c_mktsegment"})
    f.add("split", "conditional_split", "customer.match", conditions={"high": "[net_amount] >= 200000"}, default="low")
    f.add("tag_high", "derived_column", "split.high", expressions={"segment": '"HIGH"'}).add("tag_low", "derived_column", "split.low", expressions={"segment": '"LOW"'})
    f.add("union", "union_all", "tag_high", "tag_low").add("sort", "sort", "union", keys=[("priority_clean", True), ("net_amount", False)])
    return f.add("out", "destination", "sort", mapping={"o_orderkey": "txn_id", "o_custkey": "cust_id", "net_amount": "net_amount", "priority_clean": "priority_clean", "tier": "tier", "segment": "segment"})


query("etl_full", "SELECT o_orderkey AS txn_id, o_custkey AS cust_id, net_amount, upper(trim(o_orderpriority)) AS priority_clean, c_mktsegment AS tier, CASE WHEN net_amount >= 200000 THEN 'HIGH' ELSE 'LOW' END AS segment FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,4)) * 0.9 AS DECIMAL(18,4)) AS net_amount FROM orders) LEFT JOIN customer ON o_custkey = c_custkey", _etl, "out")
query("sales_etl", "SELECT c_mktsegment AS tier, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1",
      lambda f: f.add("s", "source", table="orders").add("d", "derived_column", "s", expressions={"amount": "(DT_NUMERIC,18,2)[o_totalprice]"}).add("c", "conditional_split", "d", conditions={"keep": "[amount] > @[User::MinThreshold]"})
      .add("l", "lookup", "c.keep", table="customer", keys={"o_custkey": "c_custkey"}, take={"tier": "c_mktsegment"}).add("a", "aggregate", "l.match", by=["tier"], values={"n": ("count_all", None), "total": ("sum", "amount")}).add("t", "sort", "a", keys=[("tier", True)]).add("o", "destination", "t", mapping={"tier": "tier", "n": "n", "total": "total"}), "o",
      package=Package("sales", variables={("User", "MinThreshold"): ("1000", "18")}))
