import datetime
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriplumb import gentest
from veriplumb.functions.dates import convert_dates, infer_date_format, parse_date
from veriplumb.functions.rows import with_row_numbers
from veriplumb.operators import compare as cmp
from veriplumb.operators import textdiff
from veriplumb.reftest import ReferenceTest, ReferenceTestCase, TaggedLoader, apply_flags, tag
from veriplumb.sources import csvw, readers, writers


def test_cells(spark):
    a = spark.createDataFrame([(1, 0, 1.0001, "x"), (2, 1, float("nan"), None), (3, None, 2.0, "y"), (5, 1, 1.0, "z")], "k int, v int, r double, s string")
    b = spark.createDataFrame([(1, 0, 1.0002, "x"), (2, None, None, None), (3, 2, 2.0, "Y"), (4, 1, 1.0, "z")], "k int, v int, r double, s string")
    d = cmp.compare(a, b, key="k")
    assert (d.n_actual, d.n_expected, d.n_values, d.n_rows, d.by_column) == (4, 4, 4, 3, {"v": 2, "r": 1, "s": 1})
    assert cmp.compare(a, b, key="k", precision=3).by_column == {"v": 2, "s": 1}
    assert "4 values differ" in str(d) and len(d.sample) == 3
    counts = {r["k"]: r["n_diffs"] for r in cmp.diff_counts(cmp.cell_masks(a, b, ["k"]), ["k"]).collect()}
    assert counts == {1: 1, 2: 1, 3: 2, 4: 3, 5: 3}
    assert not cmp.compare(a, a, key="k") and not cmp.compare(a, a)
    assert not cmp.compare(a, a.orderBy(F.desc("k")), sortby=["k"]) and cmp.compare(a, a.orderBy(F.desc("k"))).n_values
    assert not cmp.compare(a, b, key="k", condition=F.col("k") > 9) and not cmp.compare(a, b, key="k", check_data=["k"]).n_values


def test_schemas(spark):
    a, b = spark.createDataFrame([(1, "x", 2.0)], "i int, s string, f float"), spark.createDataFrame([("x", 1, 2.0, True)], "s string, i long, f double, b boolean")
    d = cmp.schema_diff(a, b)
    assert (d.missing, d.extra, set(d.types), d.order) == (["b"], [], {"i", "f"}, (["i", "s", "f"], ["s", "i", "f"]))
    assert not cmp.schema_diff(a, b, type_matching="medium").types and cmp.schema_diff(b, a).extra == ["b"]
    free = cmp.all_fields_except(["b", "i"])
    d = cmp.schema_diff(a, b, check_types=free, check_order=False, check_data=free, type_matching="medium")
    assert not d


@pytest.mark.parametrize(("a", "b", "level"), [(T.IntegerType(), T.IntegerType(), "strict"), (T.IntegerType(), T.LongType(), "medium"), (T.FloatType(), T.DecimalType(5, 2), "medium"), (T.BooleanType(), T.DoubleType(), "permissive"), (T.DateType(), T.TimestampType(), "medium"), (T.StringType(), T.LongType(), None), (T.DateType(), T.StringType(), None), (T.BinaryType(), T.StringType(), None)])
def test_type_levels(a, b, level):
    order = ["strict", "medium", "permissive"]
    for i, said in enumerate(order):
        assert cmp.types_match(a, b, said) == (level is not None and order.index(level) <= i)


def test_row_numbers(spark):
    df = spark.range(100, numPartitions=7).filter("id % 3 = 0")
    assert [tuple(r) for r in with_row_numbers(df, "n").orderBy("id").collect()] == [(3 * i, i + 1) for i in range(34)]
    assert with_row_numbers(spark.range(0), "n").count() == 0


def test_texts():
    t = textdiff.compare_texts
    assert not t("a\nb\n", "a\nb") and t("a\nb", "a\nc").reconstruction() == ["(b|c)"]
    assert not t("a \n b", "a\nb", lstrip=True, rstrip=True) and t("a", "a\nb").n_diffs == 2
    assert not t("x\nskip 1", "skip 2\nx", remove_lines=["skip"]) and not t("v 1.2", "v 3.4", ignore_substrings=["v 3"])
    assert t("v 3.4", "v 1.2", ignore_substrings=["v 3"]) and not t("took 12s ok", "took 9s ok", ignore_patterns=[r"\d+s"])
    assert t("took 12s ok", "took 9s no", ignore_patterns=[r"\d+s"]) and not t("on 1 at 22", "on 333 at 4", ignore_patterns=[r"\d+"])
    assert not t("b\na", "a\nb", max_permutation_cases=2) and t("b\na", "a\nb", max_permutation_cases=1)
    assert not t("A", "a", preprocess=lambda lines: [x.lower() for x in lines]) and textdiff.marked("prefix1suffix", "prefix22suffix") == "prefix(1|22)suffix"


def test_files(spark, tmp_path):
    for n, data in (("a", b"ab\0c"), ("b", b"ab\0d"), ("x.txt", b"one\ntwo\n"), ("y.txt", b"one\nTWO\nthree\n")):
        (tmp_path / n).write_bytes(data)
    assert "offset 3" in textdiff.compare_binary(str(tmp_path / "a"), str(tmp_path / "b")).messages[0]
    rows = sorted(map(tuple, textdiff.compare_huge(spark, str(tmp_path / "x.txt"), str(tmp_path / "y.txt")).collect()))
    assert rows == [(2, "two", "TWO"), (3, None, "three")]


def test_huge_texts_of_several_files(spark, tmp_path):
    """Lines are numbered in the order of files, whatever their sizes, and of the bytes of a file that tasks share."""
    lines = [f"line {i}" for i in range(900)]
    for name, cuts in (("a", (0, 10, 400, 420, 900)), ("b", (0, 500, 510, 515, 900))):
        (tmp_path / name).mkdir()
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            (tmp_path / name / f"part-{k + 99_998:05d}-x.txt").write_text("".join(f"{x}\n" for x in ("X" + s if name == "a" and s == "line 777" else s for s in lines[i:j])))
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert [tuple(r) for r in textdiff.compare_huge(spark, *paths).collect()] == [(778, "Xline 777", "line 777")]
            assert textdiff.compare_huge(spark, *paths, remove_lines=["77"]).isEmpty()
            texts = [spark.read.text(p) for p in paths]
            assert cmp.compare(*texts).n_rows == 1
            got = with_row_numbers(texts[0].sortWithinPartitions("value"), "n").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
            assert tuple(got) == (1, 900, 900)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (["2020-01-31", "1999-12-01", None], "yyyy-M-d"), (["2020-01-31T01:02:03"], "yyyy-M-d'T'H:mm:ss"), (["31/01/2020", "01/02/2020"], "d/M/yyyy"), (["01/31/2020", "02/01/2020"], "M/d/yyyy"),
        (["01/02/2020"], None), (["13/01/20"], "d/M/yy"), (["2020-01-01", "x"], None), ([None], None), (["31/01/2020 10:11"], "d/M/yyyy H:mm"), (["31/01/2020", "01/31/2020"], None), (["2020-01-01", "2020/01/01"], None),
    ],
)
def test_date_formats(spark, texts, want):
    assert infer_date_format(spark.createDataFrame([(t,) for t in texts], "t string"), "t") == want


def test_date_values(spark):
    assert parse_date("2020-01-02") == datetime.datetime(2020, 1, 2) and parse_date("2020/1/2 3:04:05.5") == datetime.datetime(2020, 1, 2, 3, 4, 5, 500000)
    assert parse_date("no") == "no" and parse_date("2020-13-01") == "2020-13-01" and parse_date(None) is None
    df = spark.createDataFrame([("31/12/2020", "31/12/2020", "31/12/2020 01:02:03.5"), (None, "31/02/2020", None)], "a string, b string, c string")
    out = convert_dates(df)
    assert dict(out.dtypes) == {"a": "date", "b": "string", "c": "timestamp"}


def test_typed_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text('i,r,b,s,z,d,n\n1,1.5,true,"a,b",00,2020-01-02,\n2,NaN,False,NULL,01,2021-03-04,\n', encoding="utf-8")
    df = readers.load(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"i": "bigint", "r": "double", "b": "boolean", "s": "string", "z": "string", "d": "date", "n": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, "a,b", "00", datetime.date(2020, 1, 2), None), (2, None, False, None, "01", datetime.date(2021, 3, 4), None)]
    with pytest.raises(ValueError):
        readers.load(spark, "nowhere.xyz")


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, True, "x|y"), (2, None, 'q"')], "i long, b boolean, s string")
    for ext in ("csv", "psv", "tsv", "parquet"):
        for single in (False, True):
            path = str(tmp_path / f"t{single}.{ext}")
            writers.save(df, path, single_file=single)
            assert os.path.isfile(path) == single
            back = readers.load(spark, path) if ext == "parquet" else readers.typed(readers.read_text_table(spark, path, writers.SEPARATORS[ext], escape='"'))
            assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        writers.save(df, "x.doc")


def test_whole_floats(spark):
    df = spark.createDataFrame([(1.0, 1.5, None), (float("nan"), 2.0, None)], "a double, b double, c double")
    assert dict(readers.upgrade_integral_floats(df).dtypes) == {"a": "bigint", "b": "double", "c": "bigint"}


METADATA = {
    "@context": "http://www.w3.org/ns/csvw", "url": "t.csv", "dialect": {"delimiter": "|", "header": True},
    "tableSchema": {"columns": [{"name": "i", "datatype": "integer"}, {"name": "r", "datatype": "decimal"}, {"name": "b", "datatype": {"base": "boolean", "format": "Y|N"}}, {"name": "d", "datatype": {"base": "date", "format": "dd/MM/yyyy"}}, {"name": "t", "titles": "Time", "datatype": {"base": "datetime", "format": "yyyy-MM-ddTHH:mm:ss"}}, {"name": "s", "null": "-"}, {"name": "v", "virtual": True}]},
}


def test_csvw(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i|r|b|d|Time|s\n1|2.5|Y|31/01/2020|2020-01-02T03:04:05|-\nx|NULL|N|bad||é\n", encoding="utf-8")
    (tmp_path / "t.csv-metadata.json").write_text(json.dumps(METADATA), encoding="utf-8")
    df, md = readers.read_csv_with_metadata(spark, str(tmp_path / "t.csv"), find=True, return_metadata=True)
    assert dict(df.dtypes) == {"i": "bigint", "r": "double", "b": "boolean", "d": "date", "t": "timestamp_ntz", "s": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, 2.5, True, datetime.date(2020, 1, 31), datetime.datetime(2020, 1, 2, 3, 4, 5), None), (None, None, False, None, None, "é")]
    assert md.url == "t.csv" and json.loads(md.to_json())["dialect"]["delimiter"] == "|"
    assert readers.load(spark, str(tmp_path / "t.csv-metadata.json")).count() == 2
    two = {"@context": "http://www.w3.org/ns/csvw", "tables": [{"url": "a.csv", "tableSchema": {"columns": [{"titles": ["x"]}, {"name": "x"}]}}, {"url": "b.csv"}]}
    assert csvw.parse(two).errors and csvw.parse(two, table_number=1).warnings and csvw.parse(two, table_name="b.csv").url == "b.csv"
    with pytest.raises(ValueError):
        csvw.parse(two, table_number=2)
    assert csvw.metadata_kind("x-metadata.json") == "csvw" and csvw.metadata_kind("datapackage.json") == "frictionless"
    assert csvw.frictionless({"fields": [{"name": "a", "type": "integer"}]}).fields[0].type == "int"


def test_connections(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"dbtype": "postgres", "db": "x", "user": "u"}))
    assert readers.connection(str(tmp_path / "c.json"), host="h") == {"driver": "org.postgresql.Driver", "url": "jdbc:postgresql://h:5432/x", "user": "u"}
    assert readers.parse_table_name("mysql:a.b") == ("mysql", "a.b") and readers.parse_table_name("t") == (None, "t")
    with pytest.raises(ValueError):
        readers.connection(dbtype="oracle")


def test_assertions(spark, tmp_path):
    ref = ReferenceTest()
    ref.set_data_location(str(tmp_path))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string").coalesce(1)
    type(ref).regenerate = {None: True}
    ref.verbose = False
    ref.assertDataFrameCorrect(df, "t.parquet")
    ref.assertStringCorrect("hello\n", "t.txt")
    type(ref).regenerate = {}
    ref.assertDataFrameCorrect(df, "t.parquet")
    ref.assertStringCorrect("hello\n", "t.txt")
    ref.assertTextFileCorrect(str(tmp_path / "t.txt"), "t.txt")
    ref.assertBinaryFileCorrect(str(tmp_path / "t.txt"), "t.txt")
    ref.assertOnDiskDataFramesCorrect([str(tmp_path / "t.parquet")], ["t.parquet"])
    for wrong in (lambda: ref.assertDataFrameCorrect(df.withColumn("i", F.col("i") + 1), "t.parquet"), lambda: ref.assertStringCorrect("bye\n", "t.txt"), lambda: ref.assertDataFramesEqual(df, df.drop("s")), lambda: ref.assertTextFilesCorrect([], ["t.txt"])):
        with pytest.raises(AssertionError):
            wrong()


def test_flags_and_tags():
    assert apply_flags(["x", "-1", "--wquiet", "a"]) == {"tagged": True, "list": False, "argv": ["x", "a"]}
    apply_flags(["-w", "csv,txt"])
    assert ReferenceTest().should_regenerate("csv") and not ReferenceTest().should_regenerate("parquet")
    ReferenceTest.regenerate, ReferenceTest.verbose = {}, True

    class Some(ReferenceTestCase):
        @tag
        def test_a(self):
            pass

        def test_b(self):
            pass

    assert TaggedLoader(tagged=True).getTestCaseNames(Some) == ["test_a"] and len(TaggedLoader().getTestCaseNames(Some)) == 2


def test_generated_test_passes(tmp_path):
    script = gentest.generate("echo fixed; python3 -c 'import os; print(\"pid\", os.getpid())'; echo out > made.txt", str(tmp_path / "test_it.py"), folder=str(tmp_path))
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, script], capture_output=True, text=True, env=env, timeout=120)
    assert done.returncode == 0, done.stderr
    (tmp_path / "ref" / "test_it" / "STDOUT").write_text("other\n")
    assert subprocess.run([sys.executable, script], capture_output=True, text=True, env=env, timeout=120).returncode != 0


def test_command_line(spark, tmp_path, capsys):
    from veriplumb import cli

    (tmp_path / "t.csv").write_text("i,s\n1,a1\n2,b2\n3,c3\n")
    assert cli.main(["discover", str(tmp_path / "t.csv"), str(tmp_path / "t.constraints"), "-r"]) == 0
    (tmp_path / "u.csv").write_text("i,s\n1,a1\n9,bb\n")
    assert cli.main(["verify", str(tmp_path / "t.csv")]) == 0 and "Constraints failing: 0" in capsys.readouterr().out
    assert cli.main(["detect", str(tmp_path / "u.csv"), str(tmp_path / "t.constraints"), str(tmp_path / "bad.csv"), "-7"]) == 0
    assert "Records failing: 1" in capsys.readouterr().out and spark.read.csv(str(tmp_path / "bad.csv"), header=True).count() == 1
    assert cli.main(["diff", str(tmp_path / "t.csv"), str(tmp_path / "u.csv"), "--key", "i"]) == 1
    (tmp_path / "lines").write_text("ab\ncd\n")
    assert cli.main(["rex", str(tmp_path / "lines"), "-q"]) == 0 and capsys.readouterr().out.endswith('"^[a-z]{2}$"\n')
    assert cli.main(["version"]) == 0


def test_streams(spark, tmp_path):
    from veriplumb.streaming.checks import quarantine, verify_stream

    spark.createDataFrame([(1, "a"), (7, "b")], "i int, s string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("i int, s string").parquet(str(tmp_path / "in"))
    rules, seen = {"fields": {"i": {"max": 5}}}, []
    q = verify_stream(stream(), rules, lambda v, n: seen.append((n, v.failures))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert seen == [(0, 1)]
    q = quarantine(stream(), rules, str(tmp_path / "bad"), str(tmp_path / "good")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    assert [r["i"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [7] and [r["i"] for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [1]
