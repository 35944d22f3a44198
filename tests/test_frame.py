import math
import random

import pytest
from pyspark.sql import functions as F

import plumbline as p
from plumbline import ColumnType

INT, FLOAT, STRING = ColumnType
OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.fixture(scope="module")
def trips(spark):
    return p.from_dict({"town": ["paris", "rome", "paris", "oslo", "rome"], "n": [3, 1, 2, 1, 5], "x": [0.5, -1.0, 2.5, 2.5, 0.25]})


def test_access(trips):
    assert trips.columns == ("town", "n", "x") and trips.dtypes == (STRING, INT, FLOAT) and trips.shape == (5, 3) and len(trips) == 5
    assert list(trips) == ["town", "n", "x"] and "n" in trips and "q" not in trips
    c = trips["n"]
    assert c.name == "n" and c.dtype is INT and len(c) == 5 and list(c) == [3, 1, 2, 1, 5] and c[-1] == 5 and c[1:3] == [1, 2] and c[::-2] == [5, 2, 3]
    assert trips[-1].name == "x" and trips[0].to_list()[3] == "oslo"
    assert repr(c) == "Column('n', int, [3, 1, 2, 1, 5], 5 rows)" and str(INT) == "int" and int(STRING) == 2
    for bad, error in (("q", KeyError), (3, IndexError), (-4, IndexError), (True, TypeError), (1.0, TypeError)):
        with pytest.raises(error):
            trips[bad]
    for bad in (5, -6):
        with pytest.raises(IndexError):
            c[bad]
    with pytest.raises(TypeError):
        hash(c)


def test_select(trips):
    f = trips[["x", 0]]
    assert f.columns == ("x", "town") and f.row(1) == (-1.0, "rome")
    assert trips.select([]).shape == (5, 0) and trips.select([]).head(2) == [(), ()] and trips.select([]).to_csv() == "\n" * 6
    for bad, error in ((["n", 1], ValueError), (["q"], KeyError), ([9], IndexError), ("n", TypeError)):
        with pytest.raises(error):
            trips.select(bad)


def test_rows(trips):
    assert trips.head(2) == [("paris", 3, 0.5), ("rome", 1, -1.0)] and trips.head(-1) == [] and len(trips.head(99)) == 5
    assert trips.row(0) == trips.row(-5) and trips.row(3) == ("oslo", 1, 2.5)
    for bad in (5, -6):
        with pytest.raises(IndexError):
            trips.row(bad)


@pytest.mark.parametrize("op", OPS)
def test_filters(spark, op):
    rng = random.Random(1)
    data = {"i": [rng.randint(-3, 3) for _ in range(40)], "f": [rng.choice([-1.5, -0.0, 0.0, 0.5, 2.0]) for _ in range(40)], "s": [rng.choice(["", "B", "a", "b", "é", "￮", "😀"]) for _ in range(40)]}
    f = p.from_dict(data)
    rows = list(zip(*data.values(), strict=True))
    for name, at, value in (("i", 0, 1), ("i", 0, 0.5), ("f", 1, 0), ("f", 1, 0.5), ("s", 2, "a"), ("s", 2, "￮"), ("i", 0, math.inf)):
        key = (lambda v: v.encode()) if at == 2 else (lambda v: v)
        assert f.filter(name, op, value).head(99) == [r for r in rows if OPS[op](key(r[at]), key(value))]
    for name in ("i", "f"):
        assert len(f.filter(name, op, math.nan)) == (40 if op == "!=" else 0)


def test_filter_errors(trips):
    for args, error in ((("n", "=", 1), ValueError), (("q", "==", 1), KeyError), (("n", "==", "1"), TypeError), (("town", "<", 1), TypeError), (("n", "==", True), TypeError), (("n", "==", None), TypeError), (("n", "<", 2**63), OverflowError)):
        with pytest.raises(error):
            trips.filter(*args)
    with pytest.raises(TypeError):
        trips[(trips["n"] > 99) & (trips["town"] == 1)]


def test_large_ints_compare_exactly(spark):
    f = p.from_dict({"n": [2**53, 2**53 + 1]})
    assert f.filter("n", "==", 2**53 + 1)["n"].to_list() == [2**53 + 1]
    assert len(f.filter("n", "==", float(2**53))) == 2


def test_conditions(trips):
    c = (trips["n"] > 1) & (trips["x"] < 2.5) & (trips["town"] != "oslo")
    assert trips[c].head() == [("paris", 3, 0.5), ("rome", 5, 0.25)] and repr(c) == "Condition(n > 1 & x < 2.5 & town != 'oslo')"
    assert len(trips[trips["n"] == 1]) == 2 and len(trips[trips["n"] != 1]) == 3 and len(trips[trips["n"] >= 3]) == 2 and len(trips[trips["n"] <= 1]) == 2
    with pytest.raises(TypeError):
        c | c
    with pytest.raises(TypeError):
        bool(c)
    with pytest.raises(TypeError):
        c & 1
    other = p.from_dict({"n": [1]})
    with pytest.raises(ValueError):
        c & (other["n"] == 1)
    with pytest.raises(ValueError):
        other[c]


def test_filter_reaches_the_scan(spark, capsys):
    f = p.from_spark(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_quantity", "l_tax", "l_returnflag"))
    f[(f["l_quantity"] > 30) & (f["l_returnflag"] == "R")][["l_tax"]].to_spark().explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,30.0)" in plan and "EqualTo(l_returnflag,R)" in plan and "l_orderkey" not in plan and "Exchange" not in plan


def test_reductions(trips):
    assert trips["n"].sum() == 12 and isinstance(trips["n"].sum(), int) and trips["n"].mean() == 2.4 and trips["n"].min() == 1 and trips["n"].max() == 5
    assert trips["x"].sum() == 4.75 and trips["x"].min() == -1.0
    empty = trips.filter("n", ">", 99)
    assert empty["n"].sum() == 0 and empty["x"].sum() == 0.0 and isinstance(empty["x"].sum(), float) and empty.dtypes == trips.dtypes
    for func in ("mean", "min", "max"):
        with pytest.raises(ValueError):
            getattr(empty["n"], func)()
    for func in ("sum", "mean", "min", "max"):
        with pytest.raises(TypeError):
            getattr(trips["town"], func)()
        with pytest.raises(TypeError):
            getattr(p.parse_csv("a\n")["a"], func)()


def test_overflow(spark):
    f = p.from_dict({"k": ["a", "a", "b"], "n": [2**63 - 1, 1, 5]})
    with pytest.raises(OverflowError):
        f["n"].sum()
    with pytest.raises(OverflowError):
        f.groupby("k").agg({"n": "sum"})
    assert f["n"].mean() == pytest.approx((2**63 + 5) / 3) and f.groupby("k").mean()["n"][1] == 5.0
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(OverflowError):
            f["n"].sum()
        assert f.filter("n", "<", 9)["n"].sum() == 6
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_groups(trips):
    g = trips.groupby("town")
    f = g.agg({"n": "sum", "x": "mean"})
    assert f.columns == ("town", "n", "x") and f.dtypes == (STRING, INT, FLOAT) and f.head() == [("paris", 5, 1.5), ("rome", 6, -0.375), ("oslo", 1, 2.5)]
    assert g.key == "town" and repr(g) == "GroupBy('town', 5 rows)"
    assert g.min().head() == [("paris", 2, 0.5), ("rome", 1, -1.0), ("oslo", 1, 2.5)] and g.max()["x"].to_list() == [2.5, 0.25, 2.5]
    assert g.sum().to_dict() == {"town": ["paris", "rome", "oslo"], "n": [5, 6, 1], "x": [3.0, -0.75, 2.5]} and g.mean().dtypes == (STRING, FLOAT, FLOAT)
    assert g.count().to_dict() == {"town": ["paris", "rome", "oslo"], "count": [2, 2, 1]} and g.agg({}).to_dict() == {"town": ["paris", "rome", "oslo"]}
    assert trips.groupby(1).agg({"n": "count", "town": "count"}).head() == [(3, 1, 1), (1, 2, 2), (2, 1, 1), (5, 1, 1)]
    assert g.agg({"n": "sum", 1: "max"}).columns == ("town", "n", "n")
    empty = trips.filter("n", ">", 99).groupby("town").agg({"n": "sum", "x": "mean"})
    assert empty.shape == (0, 3) and empty.dtypes == (STRING, INT, FLOAT)
    for bad, error in (({"n": "median"}, ValueError), ({"q": "sum"}, KeyError), ({"town": "min"}, ValueError)):
        with pytest.raises(error):
            g.agg(bad)
    with pytest.raises(TypeError):
        trips.groupby("n").agg({"town": "max"})
    with pytest.raises(KeyError):
        trips.groupby("q")


def test_zeros_are_one_key(spark):
    f = p.from_dict({"x": [-0.0, 1.0, 0.0, -0.0], "n": [1, 2, 3, 4]})
    g = f.groupby("x").agg({"n": "sum"})
    assert g.head() == [(0.0, 8), (1.0, 2)] and math.copysign(1, g["x"][0]) == -1
    assert f.sort_values("x")["n"].to_list() == [1, 3, 4, 2] and f.sort_values("x", ascending=False)["n"].to_list() == [2, 1, 3, 4]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_same_at_any_partitioning(spark, parts):
    """Order, groups and sums do not depend on how rows are dealt out."""
    rng = random.Random(5)
    rows = [(rng.randint(-20, 20), rng.choice("abcdef"), rng.randint(-(2**40), 2**40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, s string, v long, i long").repartitionByRange(parts, "i").sortWithinPartitions("i")
    f = p.from_spark(df)
    seen = list(dict.fromkeys(r[0] for r in rows))
    g = f.groupby("k").agg({"v": "sum", "i": "min"})
    assert g["k"].to_list() == seen and g["v"].to_list() == [sum(r[2] for r in rows if r[0] == k) for k in seen]
    for up in (True, False):
        want = sorted(rows, key=lambda r: r[0], reverse=not up)
        assert f.sort_values("k", ascending=up)["i"].to_list() == [r[3] for r in (want if up else sorted(rows, key=lambda r: -r[0]))]
    two = f.sort_values("v").sort_values("s", ascending=False)
    assert two["i"].to_list() == [r[3] for r in sorted(sorted(rows, key=lambda r: r[2]), key=lambda r: r[1], reverse=True)] or two["i"].to_list() == [r[3] for r in sorted(rows, key=lambda r: (-ord(r[1]), r[2]))]
    assert two.filter("k", ">", 0).head(5) == [r for r in sorted(rows, key=lambda r: (-ord(r[1]), r[2])) if r[0] > 0][:5]
    first = list(dict.fromkeys(r[0] for r in sorted(rows, key=lambda r: (-ord(r[1]), r[2]))))
    assert two.groupby("k").agg({})["k"].to_list() == first
    assert two[["i"]].row(-1) == (sorted(rows, key=lambda r: (-ord(r[1]), r[2]))[-1][3],)


def test_close(spark):
    f = p.from_dict({"a": [1, 2], "k": ["x", "y"]})
    derived, column = f.filter("a", ">", 1), f["a"]
    column.to_list()
    with f:
        pass
    f.close()
    assert repr(f) == "<Frame (closed)>" and derived.to_dict() == {"a": [2], "k": ["y"]}
    for act in (lambda: f["a"], f.to_dict, f.head, column.to_list, column.sum, f.to_csv, lambda: f.groupby("a"), lambda: f.sort_values("a"), lambda: f.row(0), lambda: column[0]):
        with pytest.raises(ValueError):
            act()


def test_repr(trips, spark):
    assert repr(trips).splitlines()[:2] == ["    town  n     x", "0  paris  3   0.5"] and repr(trips).endswith("[5 rows x 3 columns]")
    long = p.from_dict({"a": list(range(25)), "s": ["x\ty\n"] * 25})
    assert "... (15 more rows)" in repr(long) and "x\\ty\\n" in repr(long) and repr(p.from_dict({})) == "<Frame: 0 rows x 0 columns>"


def test_from_spark(spark):
    df = spark.range(3).select(F.col("id").cast("short").alias("a"), F.col("id").cast("float").alias("b"), F.lit("x").alias("a"))
    f = p.from_spark(df)
    assert f.columns == ("a", "b", "a") and f.dtypes == (INT, FLOAT, STRING) and f.head(1) == [(0, 0.0, 0)]
    with pytest.raises(TypeError):
        p.from_spark(spark.range(1).select(F.current_date().alias("d")))
    for bad in ("CAST(NULL AS INT)", "CAST('nan' AS DOUBLE)", "CAST('-inf' AS DOUBLE)"):
        with pytest.raises(ValueError):
            p.from_spark(spark.sql(f"SELECT {bad} AS v"), check=True)
    assert p.from_spark(spark.range(2), check=True).shape == (2, 1)


def shown_plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_rows_of_a_scan_leave_unsorted(spark, capsys):
    """Without pending keys nothing is sorted, head reads no more than it needs, and filters reach the scan."""
    f = p.from_spark(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_quantity"))
    some = f[f["l_quantity"] > 30]
    first = shown_plan(some._open().first(5), capsys)
    assert "TakeOrdered" not in first and "Limit" in first and "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,30.0)]" in first
    whole = shown_plan(some._open().ordered(), capsys)
    assert "Sort" not in whole and "Exchange" not in whole
    assert "TakeOrdered" in shown_plan(some.sort_values("l_quantity")._open().first(5), capsys)
    assert "Sort" in shown_plan(some.groupby("l_quantity").agg({})._open().ordered(), capsys)


def test_ranks(spark):
    from plumbline.operators.grouping import ranked

    values = [(k * 7919) % 1000 for k in range(5000)]
    f = p.from_dict({"n": values}, spark=spark)
    spread = p.from_spark(f.to_spark().repartition(6))
    got = sorted((r["rank"], r["n"]) for r in ranked(spread.sort_values("n", ascending=False)._open()).renamed().collect())
    assert [r for r, _ in got] == list(range(1, 5001)) and [n for _, n in got] == sorted(values, reverse=True)


def test_kinds_of_values():
    from plumbline.sources.memory import Kind, joined, kind_of

    kinds = {True: Kind.NONE, 1: Kind.WHOLE}
    assert kind_of(True) is Kind.NONE and kind_of(kinds) is Kind.NONE and kind_of(2**63) is Kind.WIDE and kind_of(-(2**63)) is Kind.WHOLE and kind_of(float("nan")) is Kind.ENDLESS and kind_of("") is Kind.TEXT
    assert str(joined([])) == "string" and str(joined([Kind.WHOLE])) == "int" and str(joined([Kind.WHOLE, Kind.REAL])) == "float" and str(joined([Kind.WIDE, Kind.REAL])) == "float"
    for met, error in (([Kind.WIDE, Kind.WHOLE], OverflowError), ([Kind.REAL, Kind.ENDLESS], ValueError), ([Kind.TEXT, Kind.WHOLE], TypeError), ([Kind.NONE], TypeError)):
        with pytest.raises(error):
            joined(met)


def test_order_of_several_files(spark, tmp_path):
    """By path, then by place, however files are packed into tasks."""
    where = tmp_path / "a b%é"
    want = []
    for name, size in (("b", 5), ("a", 3000), ("c", 1), ("d", 700)):
        rows = [(name, k) for k in range(size)]
        spark.createDataFrame(rows, "s string, k long").coalesce(1).write.parquet(f"file://{where}/p={name}")
        want += rows
    want.sort()
    for settings in ({"spark.sql.files.maxPartitionBytes": "128m"}, {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "0"}):
        for key, value in settings.items():
            spark.conf.set(key, value)
        try:
            f = p.from_spark(spark.read.parquet(f"file://{where}").select("s", "k"))
            assert f.head(4000) == want and f.row(-1) == ("d", 699) and f.groupby("s").count().to_dict() == {"s": ["a", "b", "c", "d"], "count": [3000, 5, 1, 700]}
            assert f.sort_values("k").head(4) == [("a", 0), ("b", 0), ("c", 0), ("d", 0)]
        finally:
            for key in settings:
                spark.conf.unset(key)


def test_folder_of_parts(spark, tmp_path):
    f = p.from_spark(p.from_dict({"n": range(500), 'a "b"': [f"x\n{k}, y" for k in range(500)]}, spark=spark).to_spark().repartition(5)).sort_values("n")
    f.to_csv_parts(f"file://{tmp_path}/parts")
    files = sorted((tmp_path / "parts").glob("part-*"))
    assert len(files) >= 2 and b"".join(x.read_bytes() for x in files) == f.to_csv().encode()
    (tmp_path / "one.csv").write_bytes(b"".join(x.read_bytes() for x in files))
    assert p.read_csv(tmp_path / "one.csv", spark=spark).to_dict() == f.to_dict()
