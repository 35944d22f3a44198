"""A query for each operator over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.frame import Frame, from_dict, from_spark, parse_csv, read_csv
from plumbline.operators.grouping import ranked
from plumbline.types import ColumnType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Frame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return from_spark(df.select(*columns) if columns else df)


def query(oracle: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return put


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Sums and means of floats depend on the order of addition in their last digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


LINE = ("l_orderkey", "l_linenumber", "l_quantity")

# filters

for _name, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">=")):

    def _filter(spark: SparkSession, sf_dir: str, op: str = _op) -> DataFrame:
        return table(spark, sf_dir, "lineitem", *LINE).filter("l_quantity", op, 30.0).to_spark()

    QUERIES[f"filter_{_name}_float"] = _filter
    ORACLES[f"filter_{_name}_float"] = f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sql} 30"

    def _filter_int(spark: SparkSession, sf_dir: str, op: str = _op) -> DataFrame:
        return table(spark, sf_dir, "part", "p_partkey", "p_size").filter("p_size", op, 25).to_spark()

    QUERIES[f"filter_{_name}_int"] = _filter_int
    ORACLES[f"filter_{_name}_int"] = f"SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size {_sql} 25"

    def _filter_text(spark: SparkSession, sf_dir: str, op: str = _op) -> DataFrame:
        return table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").filter("c_mktsegment", op, "BUILDING").to_spark()

    QUERIES[f"filter_{_name}_string"] = _filter_text
    ORACLES[f"filter_{_name}_string"] = f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment {_sql} 'BUILDING'"


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size > 10.5")
def filter_int_vs_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_size").filter("p_size", ">", 10.5).to_spark()


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_tax FROM lineitem WHERE l_tax <> CAST('nan' AS DOUBLE)")
def filter_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_tax").filter("l_tax", "!=", float("nan")).to_spark()


@query("SELECT l_orderkey, l_quantity, l_discount, l_returnflag FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05 AND l_returnflag = 'R'")
def filter_and3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_discount", "l_returnflag")
    return f[(f["l_quantity"] < 24) & (f["l_discount"] >= 0.05) & (f["l_returnflag"] == "R")].to_spark()


# projection


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders")
def select_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").select(["o_orderpriority", 0, -2]).to_spark()


# whole-column reductions

for _func, _sql_f in (("sum", "sum(p_size)"), ("mean", "avg(p_size)"), ("min", "min(p_size)"), ("max", "max(p_size)"), ("count", "count(*)")):

    def _reduction(spark: SparkSession, sf_dir: str, func: str = _func) -> DataFrame:
        f = table(spark, sf_dir, "part", "p_size")
        return from_dict({"p_size": [len(f) if func == "count" else getattr(f["p_size"], func)()]}, spark=spark).to_spark()

    QUERIES[f"{_func}_column"] = _reduction
    ORACLES[f"{_func}_column"] = f"SELECT CAST({_sql_f} AS {'DOUBLE' if _func == 'mean' else 'BIGINT'}) AS p_size FROM part"


@query("SELECT round(sum(o_totalprice), 2) AS o_totalprice FROM orders")
def sum_float_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(from_dict({"o_totalprice": [table(spark, sf_dir, "orders", "o_totalprice")["o_totalprice"].sum()]}, spark=spark).to_spark(), 2, "o_totalprice")


# grouping

for _func, _sql_f in (("sum", "round(sum(l_quantity), 2)"), ("mean", "round(avg(l_quantity), 4)"), ("min", "min(l_quantity)"), ("max", "max(l_quantity)")):

    def _group(spark: SparkSession, sf_dir: str, func: str = _func) -> DataFrame:
        found = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity").groupby("l_returnflag").agg({"l_quantity": func}).to_spark()
        return rounded(found, 2 if func == "sum" else 4, "l_quantity")

    QUERIES[f"group_{_func}"] = _group
    ORACLES[f"group_{_func}"] = f"SELECT l_returnflag, {_sql_f} AS l_quantity FROM lineitem GROUP BY l_returnflag"

    def _shortcut(spark: SparkSession, sf_dir: str, func: str = _func) -> DataFrame:
        f = table(spark, sf_dir, "part", "p_brand", "p_size", "p_retailprice").groupby("p_brand")
        found = getattr(f, func)().to_spark()
        return rounded(found, 4, "p_size", "p_retailprice") if func == "mean" else rounded(found, 2, "p_retailprice")

    QUERIES[f"shortcut_{_func}"] = _shortcut
    _size = "round(avg(p_size), 4)" if _func == "mean" else f"CAST({_func}(p_size) AS BIGINT)"
    _price = "round(avg(p_retailprice), 4)" if _func == "mean" else f"round({_func}(p_retailprice), 2)"
    ORACLES[f"shortcut_{_func}"] = f"SELECT p_brand, {_size} AS p_size, {_price} AS p_retailprice FROM part GROUP BY p_brand"


@query('SELECT l_returnflag, count(*) AS "count" FROM lineitem GROUP BY l_returnflag')
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity").groupby("l_returnflag").agg({"l_quantity": "count"}).to_spark()


@query('SELECT p_type, count(*) AS "count" FROM part GROUP BY p_type')
def shortcut_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_type").groupby("p_type").count().to_spark()


@query("SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY l_suppkey")
def group_numeric_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber").groupby("l_suppkey").agg({"l_linenumber": "sum"}).to_spark()


@query('SELECT l_discount, count(*) AS "count", min(l_tax) AS l_tax FROM lineitem GROUP BY l_discount')
def group_float_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_discount", "l_tax").groupby("l_discount").agg({"l_discount": "count", "l_tax": "min"}).to_spark()


@query("SELECT DISTINCT c_mktsegment FROM customer")
def group_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_mktsegment").groupby("c_mktsegment").agg({}).to_spark()


@query("""SELECT l_suppkey, row_number() OVER (ORDER BY first) AS rank FROM (
    SELECT l_suppkey, min(n) AS first FROM (SELECT l_suppkey, row_number() OVER () AS n FROM lineitem) GROUP BY l_suppkey)""")
def group_first_seen_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "lineitem", "l_suppkey").groupby("l_suppkey").agg({})._open()).renamed()


# order


@query("""SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def sort_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").sort_values("o_orderkey").sort_values("o_totalprice", ascending=False)
    return from_dict_rows(spark, f)


def from_dict_rows(spark: SparkSession, f: Frame) -> DataFrame:
    """The first hundred rows of f with their places: what head() gives, as a table."""
    rows = f.head(100)
    columns = {name: [r[i] for r in rows] for i, name in enumerate(f.columns)}
    return from_dict({**columns, "rank": list(range(1, len(rows) + 1))}, spark=spark).to_spark()


@query("""SELECT c_mktsegment, row_number() OVER (ORDER BY best DESC) AS rank FROM (
    SELECT c_mktsegment, max(c_acctbal) AS best FROM customer GROUP BY c_mktsegment)""")
def sort_then_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal").sort_values("c_acctbal", ascending=False)
    return ranked(f.groupby("c_mktsegment").agg({})._open()).renamed()


@query('SELECT l_returnflag, round(avg(l_extendedprice), 4) AS l_extendedprice, count(*) AS "count" FROM lineitem WHERE l_quantity > 30 GROUP BY l_returnflag')
def filter_then_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice").filter("l_quantity", ">", 30)
    return rounded(f.groupby("l_returnflag").agg({"l_extendedprice": "mean", "l_quantity": "count"}).to_spark(), 4, "l_extendedprice")


@query("SELECT CAST(p_size AS BIGINT) AS p_size, p_name, row_number() OVER (ORDER BY p_size, n) AS rank FROM (SELECT *, row_number() OVER () AS n FROM part)")
def sort_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "part", "p_size", "p_name").sort_values("p_size")._open()).renamed()


@query("SELECT c_mktsegment, c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, n) AS rank FROM (SELECT *, row_number() OVER () AS n FROM customer)")
def sort_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "customer", "c_mktsegment", "c_custkey").sort_values("c_mktsegment", ascending=False)._open()).renamed()


# sources, sinks, statistics


def _folder(spark: SparkSession) -> str:
    """A local path that executors can read, too."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    base = shared.removeprefix("file://") if shared and (shared.startswith("file://") or "://" not in shared) else tempfile.gettempdir()
    os.makedirs(base, exist_ok=True)
    return base


@query("SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.path.join(_folder(spark), f"part-{uuid.uuid4().hex}.csv")
    table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").to_csv(path)
    return read_csv(path, spark=spark).to_spark()


@query("SELECT doc_id, text FROM documents")
def csv_quoted_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.path.join(_folder(spark), f"documents-{uuid.uuid4().hex}.tsv")
    table(spark, sf_dir, "documents", "doc_id", "text").to_csv(path, delimiter="\t")
    return read_csv(path, delimiter="\t", spark=spark).to_spark()


@query("""SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0.5 AS DOUBLE), 'x,y'), (2, -2, 'say "so"'), (3, 1e300, '')) AS t(n, x, s)""")
def parse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_csv('n,x,s\n1,.5,"x,y"\r\n\n2,-2,"say ""so"""\n3,1e300,', spark=spark).to_spark()


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS DOUBLE), 'a'), (9223372036854775807, 2.5, 'é')) AS t(n, x, s)")
def from_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_dict({"n": [1, 2**63 - 1], "x": [1, 2.5], "s": ["a", "é"]}, spark=spark).to_spark()


@query("""SELECT 'p_partkey' AS "column", 'int' AS type, CAST(min(p_partkey) AS DOUBLE) AS min, CAST(max(p_partkey) AS DOUBLE) AS max, round(avg(p_partkey), 4) AS mean, count(DISTINCT p_partkey) AS "distinct" FROM part
    UNION ALL SELECT 'p_brand', 'string', NULL, NULL, NULL, count(DISTINCT p_brand) FROM part
    UNION ALL SELECT 'p_retailprice', 'float', min(p_retailprice), max(p_retailprice), round(avg(p_retailprice), 4), count(DISTINCT p_retailprice) FROM part""")
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_retailprice").statistics()
    number = lambda x: None if x is None else float(x)
    rows = [(s["column"], str(s["type"]), number(s["min"]), number(s["max"]), number(s["mean"]), s["distinct"]) for s in found]
    return rounded(spark.createDataFrame(rows, "column string, type string, min double, max double, mean double, distinct long"), 4, "mean")


# exports of values


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def export_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_dict(table(spark, sf_dir, "nation").to_dict(), spark=spark).to_spark()


@query("SELECT s_name, CAST(row_number() OVER () - 1 AS BIGINT) AS place FROM supplier")
def export_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier", "s_name")["s_name"].to_list()
    return from_dict({"s_name": names, "place": range(len(names))}, spark=spark).to_spark()


@query("""SELECT asked, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM (SELECT *, row_number() OVER () - 1 AS n, count(*) OVER () AS rows FROM nation)
    JOIN (VALUES (CAST(0 AS BIGINT)), (7), (20), (-1), (-25)) AS a(asked) ON n = CASE WHEN asked < 0 THEN rows + asked ELSE asked END""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    asked = [0, 7, 20, -1, -25]
    rows = [f.row(i) for i in asked]
    return from_dict({"asked": asked, "n_nationkey": [r[0] for r in rows], "n_name": [r[1] for r in rows]}, spark=spark).to_spark()


@query("""WITH s AS (SELECT s_acctbal, row_number() OVER () - 1 AS n, count(*) OVER () AS rows FROM supplier)
    SELECT 'at' AS how, s_acctbal FROM s WHERE n = 3 OR n = rows - 2 UNION ALL SELECT 'slice', s_acctbal FROM s WHERE n >= 10 AND n < 40 AND n % 5 = 0
    UNION ALL SELECT 'back', s_acctbal FROM s WHERE n >= rows - 4 AND (rows - 1 - n) % 2 = 0 UNION ALL SELECT 'each', s_acctbal FROM s""")
def column_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "supplier", "s_acctbal")["s_acctbal"]
    found = {"at": [c[3], c[-2]], "slice": c[10:40:5], "back": c[-1:-5:-2], "each": list(c)}
    return from_dict({"how": [how for how, values in found.items() for _ in values], "s_acctbal": [v for values in found.values() for v in values]}, spark=spark).to_spark()


@query("""WITH r AS (SELECT CAST(row_number() OVER () - 1 AS VARCHAR) AS n, CAST(r_regionkey AS VARCHAR) AS k, r_name FROM region), w AS (SELECT greatest(6, max(length(r_name))) AS w FROM r)
    SELECT '   r_regionkey  ' || lpad('r_name', CAST(w AS INTEGER), ' ') AS line FROM w
    UNION ALL SELECT n || '  ' || lpad(k, 11, ' ') || '  ' || lpad(r_name, CAST(w AS INTEGER), ' ') FROM r, w
    UNION ALL SELECT '' UNION ALL SELECT '[5 rows x 2 columns]'""")
def shown_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_dict({"line": repr(table(spark, sf_dir, "region", "r_regionkey", "r_name")).splitlines()}, spark=spark).to_spark()


# what frames and columns say about themselves


@query("""SELECT 'shape' AS what, CAST(count(*) AS VARCHAR) || ' x 3' AS said FROM part UNION ALL SELECT 'len', CAST(count(*) AS VARCHAR) FROM part
    UNION ALL SELECT 'column len', CAST(count(*) AS VARCHAR) FROM part
    UNION ALL SELECT * FROM (VALUES ('columns', 'p_name p_size p_retailprice'), ('dtypes', 'string int float'), ('iter', 'p_name p_size p_retailprice'), ('in', 'True False'), ('column', 'p_size int'), ('spark', 'string bigint double'))""")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part", "p_name", "p_size", "p_retailprice")
    c = f["p_size"]
    said = {
        "shape": "{} x {}".format(*f.shape), "len": str(len(f)), "columns": " ".join(f.columns), "dtypes": " ".join(map(str, f.dtypes)), "iter": " ".join(f), "in": f"{'p_size' in f} {'size' in f}",
        "column": f"{c.name} {c.dtype}", "column len": str(len(c)), "spark": " ".join(field.dataType.simpleString() for field in f.to_spark().schema),
    }
    return from_dict({"what": list(said), "said": list(said.values())}, spark=spark).to_spark()


def raised(spark: SparkSession, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """(what, raised): the exception of each case, `nothing` if there is none."""
    said = []
    for case in cases.values():
        try:
            case()
            said.append("nothing")
        except Exception as e:  # noqa: BLE001
            said.append(type(e).__name__)
    return from_dict({"what": list(cases), "raised": said}, spark=spark).to_spark()


@query("""SELECT * FROM (VALUES ('or', 'TypeError'), ('bool', 'TypeError'), ('two frames', 'ValueError'), ('another frame', 'ValueError'), ('text and number', 'TypeError'), ('bad operator', 'ValueError'),
    ('boolean', 'TypeError'), ('both', 'nothing')) AS t(what, raised)""")
def condition_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, g = (table(spark, sf_dir, "part", "p_size", "p_name") for _ in range(2))
    small, large = f["p_size"] < 10, f["p_size"] > 40
    return raised(spark, {
        "or": lambda: small | large, "bool": lambda: bool(small), "two frames": lambda: small & (g["p_size"] > 3), "another frame": lambda: g[small], "text and number": lambda: f[f["p_name"] > 3],
        "bad operator": lambda: f.filter("p_size", "=", 3), "boolean": lambda: f.filter("p_size", "==", True), "both": lambda: f[small & large],
    })


@query("SELECT * FROM (VALUES ('Condition(p_size > 10)'), ('Condition(p_size > 10 & p_name != ''x'')'), ('Column(''r_regionkey'', int, [0, 1, 2, 3, 4], 5 rows)'), ('GroupBy(''r_name'', 5 rows)')) AS t(said)")
def shown_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r = table(spark, sf_dir, "part", "p_size", "p_name"), table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return from_dict({"said": [repr(x) for x in (f["p_size"] > 10, (f["p_size"] > 10) & (f["p_name"] != "x"), r["r_regionkey"], r.groupby("r_name"))]}, spark=spark).to_spark()


# errors and life


@query("""SELECT * FROM (VALUES ('no file', 'FileNotFoundError'), ('a folder', 'IsADirectoryError'), ('open quote', 'ParseError'), ('after a quote', 'ParseError'), ('ragged', 'ParseError'), ('no header', 'ParseError'),
    ('delimiter', 'ValueError'), ('name', 'KeyError'), ('place', 'IndexError'), ('row', 'IndexError'), ('sum of text', 'TypeError'), ('min of nothing', 'ValueError'), ('overflow', 'OverflowError'), ('aggregate', 'ValueError'),
    ('key', 'ValueError'), ('mixed', 'TypeError'), ('none', 'TypeError'), ('wide', 'OverflowError'), ('endless', 'ValueError'), ('uneven', 'ValueError'), ('not that type', 'ValueError')) AS t(what, raised)""")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    big = from_dict({"n": [2**63 - 1, 1]}, spark=spark)
    read, text = (lambda path: read_csv(path, spark=spark)), (lambda *a, **k: parse_csv(*a, spark=spark, **k))
    made = lambda **columns: from_dict(columns, spark=spark)
    return raised(spark, {
        "no file": lambda: read(os.path.join(_folder(spark), "no such file")), "a folder": lambda: read(_folder(spark)), "open quote": lambda: text('a\n"x'), "after a quote": lambda: text('a\n"x"y'), "ragged": lambda: text("a,b\n1"),
        "no header": lambda: text("\n\r\n"), "delimiter": lambda: text("a", delimiter='"'), "name": lambda: f["x"], "place": lambda: f[2], "row": lambda: f.row(25), "sum of text": lambda: f["n_name"].sum(),
        "min of nothing": lambda: f.filter("n_nationkey", "<", 0)["n_nationkey"].min(), "overflow": lambda: big["n"].sum(), "aggregate": lambda: f.groupby("n_name").agg({"n_nationkey": "median"}),
        "key": lambda: f.groupby("n_name").agg({"n_name": "min"}), "mixed": lambda: made(a=[1, "x"]), "none": lambda: made(a=[None]), "wide": lambda: made(a=[2**63]), "endless": lambda: made(a=[float("inf")]),
        "uneven": lambda: made(a=[1], b=[1, 2]), "not that type": lambda: text("a\n1.5", types=[ColumnType.INT]),
    })


@query("""SELECT * FROM (VALUES ('closed', 'ValueError'), ('closed again', 'nothing'), ('after with', 'ValueError'), ('column of a closed frame', 'ValueError'), ('derived', 'nothing'), ('column alone', 'nothing')) AS t(what, raised)""")
def frame_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, within, source = (table(spark, sf_dir, "nation", "n_nationkey", "n_name") for _ in range(3))
    column, derived = closed["n_nationkey"], source.groupby("n_name").agg({"n_nationkey": "sum"})
    closed.close()
    source.close()
    with within:
        pass
    # the frame of this column has no other name
    alone = table(spark, sf_dir, "nation", "n_name")["n_name"]
    return raised(spark, {"closed": lambda: closed.head(), "closed again": closed.close, "after with": lambda: within.head(), "column of a closed frame": column.to_list, "derived": derived.head, "column alone": alone.to_list})


@query("SELECT * FROM (VALUES (CAST(1 AS DOUBLE), '07', CAST(5 AS BIGINT)), (2, 'x', -6)) AS t(a, b, c)")
def forced_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_csv("a,b,c\n1,07,5\n2,x,-6\n", types=[ColumnType.FLOAT, ColumnType.STRING, ColumnType.INT], spark=spark).to_spark()


# command line


@query("""SELECT * FROM (VALUES ('head', CAST(0 AS BIGINT), '     a  b' || chr(10) || '0    1  x' || chr(10) || '1  -20  y' || chr(10) || '... (1 more rows)' || chr(10) || chr(10) || '[3 rows x 2 columns]'),
    ('none', 0, '   a  b' || chr(10) || '... (3 more rows)' || chr(10) || chr(10) || '[3 rows x 2 columns]'),
    ('stats', 0, 'column  type    min  max    mean  distinct' || chr(10) || '------  ------  ---  ---  ------  --------' || chr(10) || 'a       int     -20    3  -5.333         3' || chr(10) || 'b       string                           2'),
    ('no file', 1, ''), ('no command', 2, ''), ('version', 0, 'plumbline'), ('sizes', 0, '0 B 999 B 1.0 KB 1.5 KB 2.0 MB 3.0 GB')) AS t(what, code, said)""")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    import io
    from contextlib import redirect_stderr, redirect_stdout

    from plumbline import cli

    path = os.path.join(_folder(spark), f"cli-{uuid.uuid4().hex}.tsv")
    with open(path, "w") as f:
        f.write("a\tb\n1\tx\n-20\ty\n3\tx\n")
    calls = {"head": ["head", path, "-n", "2", "-d", "tab"], "none": ["head", path, "-n", "-3", "-d", "\\t"], "stats": ["stats", path, "-d", "tab"], "no file": ["stats", path + "x"], "no command": [], "version": ["--version"]}
    rows = []
    for what, call in calls.items():
        out = io.StringIO()
        with redirect_stdout(out), redirect_stderr(io.StringIO()):
            try:
                code = cli.main(call)
            except SystemExit as e:
                code = e.code
        said = out.getvalue().rstrip("\n")
        # the file's name and the time it took are not to compare, nor is the version's number
        rows.append((what, code, said.split("\n\n", 1)[1] if what == "stats" else said.split(" ")[0] if what == "version" else said))
    os.remove(path)
    rows.append(("sizes", 0, " ".join(map(cli.bytes_text, (0, 999, 1000, 1500, 2_000_000, 3_000_000_000)))))
    return from_dict(dict(zip(("what", "code", "said"), map(list, zip(*rows, strict=True)), strict=True)), spark=spark).to_spark()
