import math
import random

import pytest

import plumbline as p
from plumbline import ColumnType, ParseError

INT, FLOAT, STRING = ColumnType


def write(tmp_path, data: bytes | str):
    path = tmp_path / "in.csv"
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return path


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("name,age,score\nAnn,30,1.5\nBo,41,2\n", {"name": ["Ann", "Bo"], "age": [30, 41], "score": [1.5, 2.0]}),
        ("a,b\r\n1,x\r\n\r\n\n2,y", {"a": [1, 2], "b": ["x", "y"]}),
        ("a,b\n1,x\ry\n2,z\r", {"a": [1, 2], "b": ["x\ry", "z\r"]}),
        ("\n\na\n1\n \n", {"a": ["1", " "]}),
        ('n,"q,1"\n"Lee, Jo",2\n"a\nb",3\n"say ""so""",4\n', {"n": ["Lee, Jo", "a\nb", 'say "so"'], "q,1": [2, 3, 4]}),
        ("a\n", {"a": []}),
        ("a,b\n,1\nx,2\n", {"a": ["", "x"], "b": [1, 2]}),
        ("x\n1\n\r", {"x": ["1", "\r"]}),
        ("é,ü\nñ,1\n", {"é": ["ñ"], "ü": [1]}),
        ("﻿a,b\n1,2\n", {"﻿a": [1], "b": [2]}),
        ('v\n"12\n"\n', {"v": ["12\n"]}),
    ],
)
def test_file_and_text_agree(spark, tmp_path, text, want):
    assert p.read_csv(write(tmp_path, text)).to_dict() == want
    assert p.parse_csv(text).to_dict() == want
    assert p.parse_csv(text.encode()).to_dict() == want


@pytest.mark.parametrize(
    ("text", "said"),
    [('a\n"x', "never closed"), ('a\n"x"y\n', "after a closing quote"), ("a,b\n1\n", "different field count"), ("a\n1,2\n", "different field count"), ("", "no header"), ("\n\r\n", "no header"), ('"a"\r', "after a closing quote"), ('a,b\n1\n"', "different field count")],
)
def test_malformed(spark, tmp_path, text, said):
    with pytest.raises(ParseError, match=said) as e:
        p.read_csv(path := write(tmp_path, text))
    assert str(path) in str(e.value) and isinstance(e.value, ValueError)
    with pytest.raises(ParseError, match=said):
        p.parse_csv(text)


def test_paths(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        p.read_csv(tmp_path / "none.csv")
    with pytest.raises(IsADirectoryError):
        p.read_csv(tmp_path)
    path = write(tmp_path, "a\n1\n")
    assert p.read_csv(f"file://{path}").to_dict() == {"a": [1]}
    with pytest.raises(FileNotFoundError):
        p.read_csv(f"file://{tmp_path}/none.csv")
    with pytest.raises(IsADirectoryError):
        p.read_csv(f"file://{tmp_path}")


def test_invalid_utf8(spark, tmp_path):
    for data in (b"a\n\xff\xfe\n", b'a\n"\xff"\n', b"\xff\n1\n"):
        with pytest.raises(UnicodeDecodeError):
            p.read_csv(write(tmp_path, data))
    with pytest.raises(UnicodeDecodeError):
        p.parse_csv(b"a\n\xff\n")


@pytest.mark.parametrize("mark", list(r";|\.^$*+?([{") + ["\t", " ", "\0"])
def test_delimiters(spark, tmp_path, mark):
    text = f"a{mark}b\n1{mark}x,y\n"
    assert p.read_csv(write(tmp_path, text), delimiter=mark).to_dict() == {"a": [1], "b": ["x,y"]}
    f = p.from_dict({"a": [1, 2], "b": [f"x{mark}y", '"'], "c": [0.5, 2.0]})
    if mark not in ".":
        assert p.parse_csv(f.to_csv(delimiter=mark), delimiter=mark).to_dict() == f.to_dict()


@pytest.mark.parametrize("mark", [",,", "", "é", '"', "\n"])
def test_refused_delimiters(spark, tmp_path, mark):
    with pytest.raises(ValueError):
        p.read_csv(write(tmp_path, "a\n"), delimiter=mark)
    with pytest.raises(ValueError):
        p.parse_csv("a\n", delimiter=mark)
    with pytest.raises(ValueError):
        p.from_dict({"a": [1]}).to_csv(delimiter=mark)


CELLS = {
    INT: ["0", "42", "-7", "+7", "007", str(2**63 - 1), str(-(2**63))],
    FLOAT: ["1.5", "-0.25", "1e9", ".5", "1.", "+.5", "-0.0", "1e-999", str(2**63)],
    STRING: ["", "abc", "12abc", " 1", "1 ", "0x10", "1_000", "nan", "inf", "Infinity", "1e999", "1d", "1f", "-", "1e", "true", "2024-01-01", "１２", "12\r"],
}


def test_inference(spark):
    cells = [(kind, c) for kind, group in CELLS.items() for c in group]
    text = ",".join(f"c{i}" for i in range(len(cells))) + "\n" + ",".join(c for _, c in cells) + "\n"
    # a CR in the last cell would be a line end
    got = p.parse_csv(text.replace("12\r\n", '"12\r"\n')).dtypes
    assert list(got) == [kind for kind, _ in cells]


def test_widening(spark):
    f = p.parse_csv("a,b,c,d\n1,1,1,1\n2,2.5,x,\n")
    assert f.dtypes == (INT, FLOAT, STRING, STRING)
    assert f.to_dict() == {"a": [1, 2], "b": [1.0, 2.5], "c": ["1", "x"], "d": ["1", ""]}
    assert p.parse_csv("a,b\n").dtypes == (STRING, STRING)


def test_names_repeat_or_are_empty(spark):
    f = p.parse_csv("a,a,\n1,2,3\n")
    assert f.columns == ("a", "a", "") and f.head() == [(1, 1, 3)] and f[1].to_list() == [2]
    assert f.to_dict() == {"a": [1], "": [3]} and f.to_csv() == "a,a,\n1,2,3\n"


def test_large_split_file_keeps_order(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = [f"{i},n{i % 97},{i / 8}" for i in range(20_000)]
        f = p.read_csv(write(tmp_path, "id,name,score\n" + "\n".join(rows) + "\n"))
        assert f["id"].to_list() == list(range(20_000)) and f["id"].sum() == sum(range(20_000))
        assert f.row(-1) == (19_999, "n17", 19_999 / 8) and f.groupby("name").count()["name"][:3] == ["n0", "n1", "n2"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_written_text(spark, tmp_path):
    f = p.from_dict({"s": ["a,b", 'q"q', "l\nm", "c\rd", "", "é"], "n": [1, -2, 3, 4, 5, 2**63 - 1], "x": [88.0, -0.0, 0.1, 1e300, 1e-5, 123456789.25]})
    want = 's,n,x\n"a,b",1,88.0\n"q""q",-2,-0.0\n"l\nm",3,0.1\n"c\rd",4,1e300\n,5,1e-5\né,9223372036854775807,123456789.25\n'
    assert f.to_csv() == want
    assert f.to_csv(tmp_path / "o.csv") is None and (tmp_path / "o.csv").read_bytes() == want.encode()
    back = p.read_csv(tmp_path / "o.csv")
    assert back.to_dict() == f.to_dict() and back.dtypes == f.dtypes
    assert math.copysign(1, back["x"][1]) == -1
    assert p.from_dict({"": ["", "x"]}).to_csv() == '""\n""\nx\n'
    assert p.parse_csv('""\n""\n1\n').to_dict() == {"": ["", "1"]}
    assert p.from_dict({"a": []}).to_csv() == "a\n"
    # numbers are never quoted, so that a delimiter that occurs in them makes unreadable text
    assert p.from_dict({"a": [1.5], "b": [2]}).to_csv(delimiter=".") == "a.b\n1.5.2\n"


def test_floats_round_trip(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(500)] + [5e-324, 1.7976931348623157e308, 1e16, 9999999999999998.0, 1e-4, 0.00009999]
    f = p.from_dict({"x": values})
    assert p.parse_csv(f.to_csv())["x"].to_list() == values
    assert "1e16\n" in p.from_dict({"x": [1e16]}).to_csv() and "0.0001\n" in p.from_dict({"x": [1e-4]}).to_csv()


def test_from_dict(spark):
    f = p.from_dict({"i": range(3), "f": (1, 2.5, 3), "s": ["x", "", "é"], "e": ["", "", ""]})
    assert f.dtypes == (INT, FLOAT, STRING, STRING) and f.shape == (3, 4)
    assert p.from_dict({}).shape == (0, 0) and p.from_dict({"a": []}).dtypes == (STRING,)
    assert p.from_dict({"a": [-(2**63), 2**63 - 1]})["a"].to_list() == [-(2**63), 2**63 - 1]
    for bad, error in [({"a": [None]}, TypeError), ({"a": [True]}, TypeError), ({"a": [1, "x"]}, TypeError), ({"a": [b"x"]}, TypeError), ({"a": [[1]]}, TypeError), ({"a": "xyz"}, TypeError), ({1: [1]}, TypeError), ({"a": [float("nan")]}, ValueError), ({"a": [1.0, float("inf")]}, ValueError), ({"a": [2**63]}, OverflowError), ({"a": [1], "b": [1, 2]}, ValueError)]:
        with pytest.raises(error):
            p.from_dict(bad)


@pytest.mark.parametrize("seed", range(2))
def test_quoted_fields_across_splits(spark, tmp_path, seed):
    """Records with line breaks that lie in one split, cross two, or cover several."""
    rng = random.Random(seed)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000" if seed % 2 else "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        cells = [[str(i), "".join(rng.choice('ab,"\n\r é') for _ in range(rng.choice([3, 20, 60, 1500 if seed % 2 else 5])))] for i in range(25)]
        f = p.from_dict({"i": [int(c[0]) for c in cells], "s": [c[1] for c in cells]})
        text = f.to_csv()
        got = p.read_csv(write(tmp_path, text))
        assert got.to_dict() == f.to_dict() and got.dtypes == (INT, STRING)
        assert p.read_csv(write(tmp_path, text.rstrip("\n"))).to_dict() == f.to_dict()
        assert p.read_csv(write(tmp_path, "﻿" + text)).columns == ("﻿i", "s")
        with pytest.raises(ParseError, match="never closed"):
            p.read_csv(write(tmp_path, text + '99,"open\n' + "x\n" * 300))
        with pytest.raises(ParseError, match="different field count"):
            p.read_csv(write(tmp_path, text + "99\n" + '98,"x"y\n' + "1,x\n" * 90))
        with pytest.raises(ParseError, match="after a closing"):
            p.read_csv(write(tmp_path, text + '98,"x"y\n' + "99\n" + "1,x\n" * 90))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_replacement_character_is_text(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("a\ufffdb,c\n1,\ufffd\n".encode())
    f = p.read_csv(str(path), spark=spark)
    assert f.columns == ("a\ufffdb", "c") and f.to_dict() == {"a\ufffdb": [1], "c": ["\ufffd"]}
    path.write_bytes(b"a\xff,c\n1,2\n")
    with pytest.raises(UnicodeDecodeError):
        p.read_csv(str(path), spark=spark)


@pytest.mark.parametrize("split", ["128m", "64"])
def test_quote_that_stays_open(spark, tmp_path, split):
    """The rest of the file is not gathered; an earlier fault comes first."""
    path = tmp_path / "a.csv"
    lines = [f"{k},x{k}" for k in range(200)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for middle, what in (('7,"open', "never closed"), ('7\n8,"open', "field count"), ('7,"a"b\n8,"open', "after a closing"), ('7,"a\nb"\n8,"open', "never closed")):
            path.write_text("\n".join(["n,s", *lines[:90], middle, *lines[90:]]) + "\n")
            with pytest.raises(ParseError, match=what):
                p.read_csv(str(path), spark=spark)
        path.write_text('"open\n1,2\n')
        with pytest.raises(ParseError, match="never closed"):
            p.read_csv(str(path), spark=spark)
        path.write_text("\n".join(["n,s", *lines[:90], '90,"a\nb"', *lines[91:]]))
        f = p.read_csv(str(path), spark=spark)
        assert f["n"].to_list() == list(range(200)) and f["s"][90] == "a\nb" and f.head(2) == [(0, "x0"), (1, "x1")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_types_asked_for(spark, tmp_path):
    from plumbline import ColumnType

    path = tmp_path / "a.csv"
    for text in ("a,b\n1,007\n2,8\n", 'a,b\n1,"007"\n2,8\n'):
        path.write_text(text)
        f = p.read_csv(str(path), types=[ColumnType.FLOAT, ColumnType.STRING], spark=spark)
        assert f.to_dict() == {"a": [1.0, 2.0], "b": ["007", "8"]}
        for wrong in ([ColumnType.INT], [ColumnType.INT] * 3):
            with pytest.raises(ValueError):
                p.read_csv(str(path), types=wrong, spark=spark)
    with pytest.raises(ValueError):
        p.parse_csv("a\nx\n", types=[ColumnType.FLOAT], spark=spark)


def sent_to_driver(spark, action):
    """The bytes of all task results of an action."""
    context = spark.sparkContext
    inner, group = context._jsc.sc(), f"sent-{random.random()}"
    context.setJobGroup(group, "counted")
    try:
        action()
    finally:
        context._jsc.clearJobGroup()
    inner.listenerBus().waitUntilEmpty()
    stages = {s for job in context.statusTracker().getJobIdsForGroup(group) for s in context.statusTracker().getJobInfo(job).stageIds}
    store, kinds = inner.statusStore(), context._jvm.java.util.ArrayList
    tasks = [store.stageData(s, False, kinds(), False, context._gateway.new_array(context._jvm.double, 0)) for s in stages]
    return sum(attempts.apply(k).resultSize() for attempts in tasks for k in range(attempts.length()))


@pytest.mark.parametrize("times", [1, 4])
def test_a_written_file_does_not_pass_through_the_driver(spark, tmp_path, times):
    """One file of several partitions, two blocks and more each: the driver gets sizes, whose number doesn't follow the rows'."""
    rows = spark.range(0, 2000 * times, 1, 4).selectExpr("id AS n", """concat('a\t"', id, '"\n', repeat(sha2(string(id), 256), 10), 'é') AS s""")
    f = p.from_spark(rows.repartition(4)).sort_values("n")
    path = tmp_path / "a [1]{b}*" / "o.tsv"
    path.parent.mkdir()
    path.write_text("longer than nothing" * 200_000)
    assert sent_to_driver(spark, lambda: f.to_csv(path, delimiter="\t")) < 200_000 < 1_200_000 * times < path.stat().st_size
    assert path.read_text(newline="") == f.to_csv(delimiter="\t") and [x.name for x in path.parent.iterdir()] == ["o.tsv"]


def test_a_file_is_written_from_itself(spark, tmp_path):
    path = write(tmp_path, "n,s\n1,a\n2,\"b\nc\"\n3,d\n")
    p.read_csv(path).sort_values("n", ascending=False).to_csv(path)
    assert p.read_csv(path).to_dict() == {"n": [3, 2, 1], "s": ["d", "b\nc", "a"]}
    for wrong, error in ((tmp_path, IsADirectoryError), (tmp_path / "none" / "x", FileNotFoundError)):
        with pytest.raises(error):
            p.from_dict({"n": [1]}).to_csv(wrong)


def test_which_files_tasks_see(tmp_path):
    """On a cluster, files in the shared folder only; devices never."""
    from types import SimpleNamespace as N

    from plumbline.sources.files import seen_by_tasks

    def session(master, folder):
        return N(sparkContext=N(master=master), conf={"spark.checkpoint.dir": folder})

    shared = tmp_path / "shared"
    shared.mkdir()
    (tmp_path / "link").symlink_to(shared)
    for folder in (f"file://{shared}", f"file:{shared}", str(shared), f"{tmp_path}/link/"):
        cluster = session("local-cluster[3,2,1000]", folder)
        assert seen_by_tasks(cluster, f"{shared}/x") and seen_by_tasks(cluster, f"{tmp_path}/link/x")
        assert not any(seen_by_tasks(cluster, str(x)) for x in (tmp_path / "x", tmp_path / "shared2", shared, "/dev/null"))
    assert not seen_by_tasks(session("spark://a:7077", f"hdfs://a{shared}"), f"{shared}/x")
    assert seen_by_tasks(session("local[4]", f"hdfs://a{shared}"), f"{tmp_path}/x") and not seen_by_tasks(session("local[4]", str(shared)), "/dev/null")
