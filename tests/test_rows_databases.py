"""Row numbers over shuffled rows, matched repeats, databases, metadata in YAML, and hooks."""

import datetime
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from veriplumb import cli
from veriplumb.functions.regexes import matches, unnamed
from veriplumb.functions.rows import settled, with_row_numbers
from veriplumb.operators import compare as cmp
from veriplumb.operators import rexinfer
from veriplumb.operators.custom import Calculator, Detector, discover_with, verify_with
from veriplumb.operators.detect import detect_df
from veriplumb.operators.discover import discover_df
from veriplumb.operators.profile import ColumnProfile, all_booleans, profile
from veriplumb.operators.rexinfer import Fragment, align, aligned_view, extract, infer, joined
from veriplumb.operators.verify import verify_df, violating_values
from veriplumb.reftest import captured
from veriplumb.sources import csvw, readers, writers


@pytest.fixture(scope="module")
def two_orders(spark, tmp_path_factory):
    """200,000 rows in two file orders over many partitions."""
    root = tmp_path_factory.mktemp("rows")
    df = spark.range(200_000).select("id", F.concat(F.lit("x"), "id").alias("s"), (F.col("id") * 1.5).alias("r"))
    df.repartition(7).write.parquet(str(root / "a"))
    df.repartition(13, "s").write.parquet(str(root / "b"))
    return spark.read.parquet(str(root / "a")), spark.read.parquet(str(root / "b"))


def test_sorted_comparison_of_many_partitions(two_orders):
    a, b = two_orders
    assert not cmp.compare(a, b, sortby=["id"])
    c = b.withColumn("r", F.when(F.col("id") % 1000 == 3, 0.0).otherwise(F.col("r")))
    d = cmp.compare(a, c, sortby=["id"])
    assert (d.n_values, d.n_rows, d.n_actual, len(d.sample), d.by_column) == (200, 200, 200_000, 10, {"r": 200})
    ties = lambda x: x.select((F.col("id") % 10).alias("k"), "s")
    assert not cmp.compare(ties(a), ties(b), sortby=["k"])


def test_gapless_numbers_of_shuffled_rows(two_orders):
    a, _ = two_orders
    for df in (a, a.orderBy("id"), a.repartition(5, "s"), a.groupBy("s").agg(F.max("id").alias("id"))):
        got = with_row_numbers(df, "n").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
        assert tuple(got) == (1, 200_000, 200_000)
    assert settled(a) and not settled(a.orderBy("id"))
    v = detect_df(a.orderBy(F.desc("id")), {"fields": {"id": {"max": 199_989}}})
    assert sorted(r["RowNumber"] for r in v.detected().collect()) == list(range(1, 11)) and v.detection.n_failing == 10


def test_repeated_keys_are_matched(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "b", 2.0), (2, "c", None), (None, "n", 0.0), (None, "m", 0.0)], "k int, s string, r double")
    assert not cmp.compare(x, x.orderBy(F.desc("s")), key="k")
    y = x.withColumn("s", F.when(F.col("s") == "a", "aa").otherwise(F.col("s")))
    d = cmp.compare(y, x, key="k")
    assert (d.n_values, d.by_column) == (1, {"s": 1}) and cmp.compare(x.limit(5), x, key="k").n_actual == 5


def test_user_columns_keep_their_names(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "i int, __value int")
    v = detect_df(df, {"fields": {"i": {"no_duplicates": True}}}, in_place=True)
    assert sorted(tuple(r) for r in v.detected().collect()) == [(1, 5, False, 1), (1, 6, False, 1), (2, 7, True, 0)]


def test_output_is_tested_before_work(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "i int")
    (tmp_path / "file").write_text("x")
    for bad in ("x.doc", str(tmp_path / "file" / "y.csv")):
        with pytest.raises((ValueError, PermissionError)):
            detect_df(df, {"fields": {"i": {"max": 0}}}, outpath=bad)
    v = detect_df(df, {"fields": {"i": {"max": 0}}}, outpath=str(tmp_path / "new" / "y.parquet"))
    assert (v.detection.n_failing, v.detection.n_passing) == (1, 0) and "Records failing: 1" in str(v)


def test_written_detection_is_counted_once_more_if_cut_away(spark, tmp_path):
    df = spark.range(10)
    v = detect_df(df, {"fields": {"id": {"max": 4}}}, outpath=str(tmp_path / "a.parquet"), key="id")
    assert (v.detection.n_passing, v.detection.n_failing) == (5, 5) and spark.read.parquet(str(tmp_path / "a.parquet")).count() == 5


def test_booleans_in_text(spark):
    df = spark.createDataFrame([("True", "x"), ("false", "true"), (None, None)], "a string, b string")
    v = verify_df(df, {"fields": {"a": {"type": "bool"}, "b": {"type": ["bool", "int"]}}})
    assert v.results == {"a": {"type": True}, "b": {"type": False}}
    assert not verify_df(df, {"fields": {"a": {"type": "bool"}}}, type_checking="strict").results["a"]["type"]
    assert all_booleans(df, "a") and not all_booleans(df, "b") and all_booleans(df.select(F.lit(True).alias("c")), "c") and not all_booleans(df.select(F.lit(1).alias("c")), "c")


def test_values_that_break_constraints(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c1",), (None,)], "s string")
    rows = lambda c: sorted(map(tuple, violating_values(df, "s", c).collect()))
    assert rows(("rex", ["^[a-z]$"])) == [("c1", 1)] and rows(("allowed_values", ["a"])) == [("b", 2), ("c1", 1)]
    assert rows(("rex", None)) == [] and len(rows(("rex", []))) == 3
    with pytest.raises(ValueError):
        violating_values(df, "s", ("min", 1))


def test_no_estimates_where_none_are_needed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    p, _ = profile(df, distinct=["i"], values=False)
    assert p["i"].n_distinct == 2 and p["s"].n_distinct is None
    assert discover_df(df, kinds=("min", "rex"), inc_rex=True).to_dict()["fields"] == {"i": {"min": 1}, "s": {"rex": ["^[a-z]$"]}}


@pytest.mark.parametrize("pattern", ["(?P<n>a)b", r"(?P<a_b>a)(b)(?P=a_b)?", r"\(?P?<x>", "[(?P<x>]a", r"(?P<x>\(\?P<y>)|ab"])
def test_named_groups_go_to_java(spark, pattern):
    strings = ["ab", "aba", "(", "(P<x>", "Pa", "(?P<y>", ""]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    got = {r[0]: r[1] for r in df.select("s", matches(df["s"], pattern)).collect()}
    assert got == {s: re.match(pattern, s, re.DOTALL) is not None for s in strings}
    assert "(?P" not in unnamed("(?P<n>a)b")


def test_line_breaks_and_doubled_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,s\n1,"two\nlines"\n2,"say ""hi"", then"\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_text_table(spark, str(tmp_path / "a.csv")).collect()] == [("1", "two\nlines"), ("2", 'say "hi", then')]
    (tmp_path / "b.csv").write_text('k,s\n1,"a \\" b"\n2,""\n', encoding="utf-8")
    assert readers.quoting(spark, str(tmp_path / "b.csv")) == (False, False)
    assert [tuple(r) for r in readers.read_text_table(spark, str(tmp_path / "b.csv")).collect()] == [("1", 'a " b'), ("2", None)]
    big = tmp_path / "big.csv"
    big.write_text("k,s\n" + "\n".join(f"{i},v{i}" for i in range(200_000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        assert readers.read_text_table(spark, str(big)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_standard_input_and_output(spark, monkeypatch, capsys):
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO('i,s\n1,"a, ""q"""\n2,b\n'))
    df = readers.load(spark, "-")
    assert sorted(map(tuple, df.collect())) == [(1, 'a, "q"'), (2, "b")]
    writers.save(df.orderBy("i").withColumnRenamed("s", 's "x", y'), "-")
    assert capsys.readouterr().out == 'i,"s ""x"", y"\n1,"a, ""q"""\n2,b\n'


SCRIPT = "CREATE TABLE t (i INTEGER, r REAL, b BOOLEAN, d DATE, s VARCHAR(9));\nINSERT INTO t VALUES (1, 1.5, {t}, '2020-01-02', 'a');\nINSERT INTO t VALUES (2, NULL, {f}, NULL, 'b;c');\n"


def test_sqlite(spark, tmp_path, capsys):
    (tmp_path / "s.sql").write_text(SCRIPT.format(t=1, f=0))
    db = str(tmp_path / "x.db")
    assert readers.run_script(spark, "sqlite", str(tmp_path / "s.sql"), db=db) == 3
    df = readers.load(spark, "sqlite:t", db=db)
    assert dict(df.dtypes) == {"i": "bigint", "r": "double", "b": "boolean", "d": "date", "s": "string"}
    assert sorted(map(tuple, df.collect())) == [(1, 1.5, True, datetime.date(2020, 1, 2), "a"), (2, None, False, None, "b;c")]
    assert readers.check_table_exists(spark, "sqlite:t", db=db) and not readers.check_table_exists(spark, "sqlite:u", db=db)
    assert cli.main(["discover", "sqlite:t", str(tmp_path / "t.constraints"), "--db", db]) == 0
    (tmp_path / "c.json").write_text(json.dumps({"dbtype": "sqlite", "db": db}))
    assert cli.main(["verify", "sqlite:t", str(tmp_path / "t.constraints"), "--conn", str(tmp_path / "c.json")]) == 0
    assert "Constraints failing: 0" in capsys.readouterr().out


def test_jdbc(spark, tmp_path):
    """The JDBC path, with the database that Spark itself brings along."""
    (tmp_path / "s.sql").write_text(SCRIPT.format(t="TRUE", f="FALSE").replace("INTEGER", "BIGINT"))
    db = f"{tmp_path}/x;create=true"
    assert readers.run_script(spark, "derby", str(tmp_path / "s.sql"), db=db) == 3
    df = readers.load(spark, "derby:t", db=db)
    assert sorted(tuple(r)[4] for r in df.collect()) == ["a", "b;c"] and verify_df(df, {"fields": {"I": {"min": 1}}}).passes == 1
    assert readers.check_table_exists(spark, "derby:t", db=db) and not readers.check_table_exists(spark, "derby:gone", db=db)
    with pytest.raises(ValueError):
        readers.check_table_exists(spark, "oracle:t")


def test_yaml_metadata(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i;d;s\n1;31/01/2020;-\n", encoding="utf-8")
    (tmp_path / "t.schema.yaml").write_text("path: t.csv\ndialect: {delimiter: ';'}\nschema:\n  missingValues: ['-']\n  fields:\n  - {name: i, type: integer, constraints: {required: true}}\n  - {name: d, type: date, format: '%d/%m/%Y'}\n  - {name: s, type: string}\n")
    assert csvw.find_metadata(str(tmp_path / "t.csv")).endswith(".schema.yaml")
    df = readers.load(spark, str(tmp_path / "t.schema.yaml"))
    assert [tuple(r) for r in df.collect()] == [(1, datetime.date(2020, 1, 31), None)]
    md = csvw.load_metadata(str(tmp_path / "t.schema.yaml"))
    assert md.report() == "i: int, required\nd: date (d/M/yyyy)\ns: string\n" and csvw.strptime_as_spark("%Y-%m-%dT%H:%M:%S") == "yyyy-M-d'T'H:mm:ss"
    odd = csvw.frictionless({"fields": [{"name": " ", "type": "date", "format": "%H"}], "dialect": {"delimiter": "||"}})
    assert len(odd.errors) == 2 and len(odd.warnings) == 1 and "error: " in odd.report()


def test_alignment():
    f = lambda t: Fragment(t, 1, 1, True)
    v = lambda t: Fragment(t, 1, None, False)
    patterns = [[v("x"), f("-"), v("y"), f("!")], [v("a"), f("-"), f("!")], [v("z"), f("-"), v("u"), v("w"), f("!")]]
    columns = align(patterns)
    assert [c.fixed for c in columns] == [False, True, False, True] and joined(columns) == sorted(patterns, key=len)
    assert aligned_view(columns) == "|1|2|3 4|5|\n a -     !\n x - y   !\n z - u w !"
    assert aligned_view(align([[f("a"), f("b")], [f("c"), f("b")]])) == "|1|2|\n a b\n c b"
    assert joined(align([[], [f("a")]])) == [[], [f("a")]] and align([]) == [] and joined([]) == []


def test_all_strings_have_an_expression_beyond_the_limit(spark, monkeypatch):
    strings = ["a-1", "b-2", "c-3", "x.y", "p/q/r", "", "u v w x", "k+l"]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    monkeypatch.setattr(rexinfer, "MAX_SHAPES", 2)
    found = infer(df, "s")
    assert found.warnings and found.n_strings == len(strings) == sum(found.frequencies)
    assert all(any(re.match(p, s, re.DOTALL) for p in found.rex) for s in strings)
    constraints = discover_df(df, inc_rex=True)
    assert verify_df(df, constraints).failures == 0


def test_states_merged_by_executors(spark, monkeypatch):
    strings = [f"{'ab'[i % 2] * (i % 5)}-{i}" for i in range(400)]
    df = spark.createDataFrame([(s,) for s in strings], "s string").repartition(6)
    monkeypatch.setattr(rexinfer, "FEW_STATES", 0)
    for options in ({}, {"variable": True}):
        found = infer(df, "s", **options)
        assert sum(found.frequencies) == 400 and (options or found.rex == extract(strings))


class Shelf(Calculator, Detector):
    def __init__(self, columns):
        self.columns = columns

    def types(self):
        return {n: "int" if isinstance(v[0], int) else "string" for n, v in self.columns.items()}

    def profile(self, name):
        v = [x for x in self.columns[name] if x is not None]
        text = isinstance(v[0], str)
        return ColumnProfile(name, self.types()[name], len(self.columns[name]), len(v), min(v), max(v), min(map(len, v)) if text else None, max(map(len, v)) if text else None, n_distinct=len(set(v)))

    def violations(self, name, constraint):
        return sum(x is not None and not any(re.match(p, x) for p in constraint.value) for x in self.columns[name])

    def detect(self, failing):
        return [(n, c.kind) for n, c in failing]


def test_own_stores():
    shelf = Shelf({"i": [1, 2, None], "s": ["a", "bb", "c"]})
    assert discover_with(shelf).to_dict()["fields"]["i"] == {"type": "int", "min": 1, "max": 2, "sign": "positive", "max_nulls": 1, "no_duplicates": True}
    v = verify_with(shelf, {"fields": {"i": {"max": 1}, "s": {"rex": ["^.$"], "min_length": 1}, "gone": {"type": "int"}}})
    assert v.results == {"gone": {"type": False}, "i": {"max": False}, "s": {"min_length": True, "rex": False}}
    assert v.detection == [("i", "max"), ("s", "rex")]


def test_extension_gives_a_frame(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "own_frames.py").write_text("def frame(spark, path):\n    return spark.createDataFrame([(1,), (2,)], 'i int') if path.startswith('own:') else None\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("VERIPLUMB_EXTENSIONS", "own_frames")
    assert cli.main(["discover", "own:x", "-"]) == 0 and '"max": 2' in capsys.readouterr().out


def test_captured_output():
    with captured() as out:
        print("one")
    assert str(out) == "one\n"
    with pytest.raises(ValueError), captured("stdin"):
        pass


def test_many_files_are_warned_of(tmp_path, caplog):
    from veriplumb.gentest import changed_files

    for i in range(5):
        (tmp_path / f"f{i}").write_text("x")
    assert len(changed_files(str(tmp_path), 0, 3)) == 3 and "not looked at" in caplog.text
    assert len(changed_files(str(tmp_path), 0, None)) == 5 and os.path.isdir(tmp_path)
