import datetime
import json

import pytest

from veriplumb.operators.detect import detect_df, observed
from veriplumb.operators.discover import discover_df, sign_of
from veriplumb.operators.model import Constraint, DatasetConstraints, FieldConstraints, InvalidConstraint
from veriplumb.operators.profile import ColumnProfile, profile, profile_table, unique_values
from veriplumb.operators.verify import fuzzy_bound, holds, repaired, verify_df

NAN = float("nan")


def frame(spark):
    d = datetime.date
    rows = [(1, 1.0, "a", True, d(2020, 1, 1), None), (2, 2.5, "bb", True, d(2020, 1, 2), None), (3, NAN, "bb", False, d(2021, 1, 1), None), (4, None, None, None, None, None)]
    return spark.createDataFrame(rows, "i int, r double, s string, b boolean, d date, n string")


def prof(kind="int", **k):
    return ColumnProfile("x", kind, **({"n": 3, "n_nonnull": 3, "min": 1, "max": 3} | k))


@pytest.mark.parametrize(
    ("kind", "value", "precision", "low", "high", "epsilon", "want"),
    [
        ("min", 1, None, 1, 3, 0, True), ("min", 2, None, 1, 3, 0, False), ("min", 1, "open", 1, 3, 0, False), ("min", 0, "open", 1, 3, 0, True), ("min", 1, "closed", 1, 3, 0, True),
        ("min", 1.1, "closed", 1, 3, 0.2, False), ("min", 1.1, None, 1, 3, 0.2, True), ("min", -1, None, -1.1, 3, 0.2, True), ("min", -1, None, -1.3, 3, 0.2, False), ("min", 0, None, -0.01, 3, 0.9, False),
        ("max", 3, None, 1, 3, 0, True), ("max", 2, None, 1, 3, 0, False), ("max", 3, "open", 1, 3, 0, False), ("max", 2.9, None, 1, 3, 0.1, True), ("max", -3, None, -9, -2.8, 0.1, True), ("max", -3, None, -9, -2.6, 0.1, False),
    ],
)
def test_bounds(kind, value, precision, low, high, epsilon, want):
    assert holds(Constraint(kind, value, precision), prof("real", min=low, max=high), None, epsilon) is want


def test_dates_are_always_closed():
    d = datetime.datetime(2020, 1, 1)
    assert holds(Constraint("min", d, "open"), prof("date", min=datetime.date(2020, 1, 1), max=d))


def test_null_values_missing_columns_and_incompatible_types():
    for kind in ("type", "min", "max", "min_length", "max_length", "sign", "max_nulls", "no_duplicates", "allowed_values", "rex"):
        assert holds(Constraint(kind, None), prof()) is True
        assert holds(Constraint(kind, None), None) is False
    assert holds(Constraint("min", "a"), prof()) is False
    assert holds(Constraint("min_length", 1), prof()) is False
    assert holds(Constraint("transform", "x"), prof()) is None and holds(Constraint("lt", "y"), prof()) is None


@pytest.mark.parametrize(("sign", "low", "high", "want"), [("positive", 1, 2, True), ("positive", 0, 2, False), ("non-negative", 0, 2, True), ("non-negative", -1, 2, False), ("zero", 0, 0, True), ("zero", 0, 1, False), ("non-positive", -1, 0, True), ("non-positive", -1, 1, False), ("negative", -2, -1, True), ("negative", -2, 0, False), ("null", 1, 1, False)])
def test_signs(sign, low, high, want):
    assert holds(Constraint("sign", sign), prof(min=low, max=high)) is want
    empty = prof(n_nonnull=0, min=None, max=None)
    assert holds(Constraint("sign", sign), empty) is True
    if want and sign != "null":
        assert sign_of(low, high) is not None


def test_types_strict_and_sloppy():
    whole = prof("real", non_integral=0)
    assert holds(Constraint("type", "int"), whole) and not holds(Constraint("type", "int"), whole, type_checking="strict")
    assert not holds(Constraint("type", ["int", "string"]), prof("real", non_integral=1)) and holds(Constraint("type", ["real", "string"]), prof("real"))


def test_fuzzy_bounds():
    assert fuzzy_bound(100, 0.01, True) == 99 and fuzzy_bound(-100, 0.01, True) == -101 and fuzzy_bound(100, 0.01, False) == 101 and fuzzy_bound(-100, 0.01, False) == -99
    assert fuzzy_bound("a", 0.5, True) == "a"


@pytest.mark.parametrize(("kind", "value", "precision"), [("type", "float", None), ("sign", "plus", None), ("min_length", -1, None), ("min_length", 1.5, None), ("no_duplicates", 1, None), ("allowed_values", "x", None), ("rex", [1], None), ("min", 1, "tight"), ("max_nulls", True, None), ("max_length", 1, "open"), ("size", 1, None)])
def test_bad_constraints(kind, value, precision):
    with pytest.raises(InvalidConstraint):
        Constraint(kind, value, precision)


def test_json_round_trip(tmp_path, caplog):
    said = {"fields": {"a": {"max": {"value": 3, "precision": "open", "comment": "why"}, "type": "int", "#note": 1, "odd": 2}, "d": {"type": "date", "min": "2020-02-03 04:05:06.5"}, "é": {"allowed_values": ["ü"]}}, "creation_metadata": {"n_records": 3, "local_time": "t"}}
    c = DatasetConstraints.from_dict(said)
    assert "odd" in caplog.text and "#note" not in caplog.text
    text = c.to_json()
    assert text.endswith("}\n") and "ü" in text and not any(x != x.rstrip() for x in text.split("\n"))
    back = json.loads(text)
    assert list(back) == ["creation_metadata", "fields"] and list(back["creation_metadata"]) == ["local_time", "n_records"]
    assert list(back["fields"]["a"]) == ["type", "max"] and back["fields"]["a"]["max"] == {"value": 3, "precision": "open"}
    assert c["d"].value("min") == datetime.datetime(2020, 2, 3, 4, 5, 6, 500000) and back["fields"]["d"]["min"].startswith("2020-02-03 04:05:06.5")
    c.save(tmp_path / "x.json")
    assert DatasetConstraints(path=str(tmp_path / "x.json")).to_json() == text
    c.remove_field("a")
    c.add_field(FieldConstraints("b", [Constraint("max_nulls", 0)]))
    c.sort_fields(["é", "b", "d"])
    assert list(c.fields) == ["é", "b", "d"] and len(c) == 4


def test_profile_treats_nan_as_null(spark):
    p, _ = profile(frame(spark))
    assert (p["r"].n, p["r"].n_nonnull, p["r"].max, p["r"].non_integral) == (4, 2, 2.5, 1)
    assert (p["s"].min_length, p["s"].max_length, p["s"].values, p["s"].n_distinct) == (1, 2, ["a", "bb"], 2)
    assert p["i"].unique and p["n"].n_nonnull == 0 and p["b"].min is False
    rows = {r["field"]: r for r in profile_table(frame(spark)).collect()}
    assert rows["r"]["n_nulls"] == 2 and rows["d"]["max"] == "2021-01-01"
    assert [r["s"] for r in unique_values(frame(spark), "s", include_nulls=True).collect()] == [None, "a", "bb"]


def test_profile_is_one_pass_and_prunes_columns(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "t"))
    from pyspark.sql import functions as F

    from veriplumb.operators.profile import statistics

    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.select("i").agg(*(c.alias(k) for k, c in statistics("i", "int").items()))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<i:int>" in plan and F is not None


def test_discovery(spark):
    c = discover_df(frame(spark)).to_dict()["fields"]
    assert c["i"] == {"type": "int", "min": 1, "max": 4, "sign": "positive", "max_nulls": 0, "no_duplicates": True}
    assert c["r"] == {"type": "real", "min": 1.0, "max": 2.5, "sign": "positive"}
    assert c["s"] == {"type": "string", "min_length": 1, "max_length": 2, "max_nulls": 1, "allowed_values": ["a", "bb"]}
    assert c["b"] == {"type": "bool", "min": False, "max": True, "sign": "non-negative", "max_nulls": 1}
    assert c["d"]["min"] == "2020-01-01" and "no_duplicates" not in c["d"] and c["n"] == {"type": "string"}


def test_discovery_of_nothing(spark):
    assert discover_df(frame(spark).limit(0)).to_dict()["fields"]["i"] == {"type": "int"}
    assert discover_df(frame(spark).limit(0), inc_rex=True).to_dict()["fields"]["s"] == {"type": "string", "rex": []}
    assert discover_df(spark.createDataFrame([([1],)], "a array<int>")) is None


def test_twenty_values_are_listed_and_twenty_one_are_not(spark):
    for n, listed in ((20, True), (21, False)):
        df = spark.createDataFrame([(f"v{i % n:02d}",) for i in range(100)], "s string")
        assert ("allowed_values" in discover_df(df)["s"]) is listed


def test_discovered_constraints_hold(spark):
    for name in ("orders", "customer", "part", "events"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        v = verify_df(df, discover_df(df, inc_rex=name == "part"))
        assert v.failures == 0 and v.passes > 10, str(v)


RULES = {"fields": {"i": {"type": "int", "min": 2, "no_duplicates": True}, "s": {"max_nulls": 0, "allowed_values": ["a"], "rex": ["^a$"]}, "gone": {"type": "int"}}}


def test_verification_report(spark):
    v = verify_df(frame(spark), RULES)
    assert str(v) == "FIELDS:\n\ngone: 1 failure  0 passes  type ✗\n\ni: 1 failure  2 passes  type ✓  min ✗  no_duplicates ✓\n\ns: 3 failures  0 passes  max_nulls ✗  allowed_values ✗  rex ✗\n\nSUMMARY:\n\nConstraints passing: 2\nConstraints failing: 5"
    assert "type OK  min X" in str(verify_df(frame(spark), RULES, ascii=True))
    assert "gone" not in str(verify_df(frame(spark), RULES, report="records"))
    rows = {r["field"]: r.asDict() for r in v.to_df(spark).collect()}
    assert rows["i"] == {"field": "i", "failures": 1, "passes": 2, "type": True, "min": False, "max_nulls": None, "no_duplicates": True, "allowed_values": None, "rex": None}


def test_detection(spark):
    v = detect_df(frame(spark), RULES, key="i", per_constraint=True, write_all=True)
    rows = {r["i"]: r.asDict() for r in v.detected().collect()}
    assert (v.detection.n_passing, v.detection.n_failing) == (0, 4)
    assert rows[1] == {"i": 1, "i_min_ok": False, "s_nonnull_ok": True, "s_values_ok": True, "s_rex_ok": True, "n_failures": 1}
    assert rows[4] == {"i": 4, "i_min_ok": True, "s_nonnull_ok": False, "s_values_ok": None, "s_rex_ok": None, "n_failures": 1}
    assert rows[2]["n_failures"] == 2
    assert detect_df(frame(spark), {"fields": {"i": {"min": 0}}}).detected() is None


def test_duplicates_mark_all_copies_and_no_nulls(spark):
    df = spark.createDataFrame([(1.0, "one"), (2.0, "two"), (3.0, "three"), (2.0, "two"), (None, None), (NAN, None)], "i double, s string")
    v = detect_df(df, {"fields": {"i": {"no_duplicates": True}, "s": {"no_duplicates": True}}}, first_row=0, row_number="Index", per_constraint=True)
    assert sorted(tuple(r) for r in v.detected().collect()) == [(1, False, False, 2), (3, False, False, 2)]


def test_detection_columns(spark):
    rules = {"fields": {"i": {"max": 3}, "s": {"max_nulls": 0}}}
    df = frame(spark).withColumnRenamed("n", "n_failures")
    assert detect_df(df, rules).detected().columns == ["RowNumber", "n_failures_2"]
    assert detect_df(df, rules, output_fields=["r"], key="i").detected().columns == ["i", "r", "n_failures_2"]
    d = detect_df(df, rules, output_fields=[], key="i", interleave=True, per_constraint=True).detected()
    assert d.columns == ["i", "i_max_ok", "r", "s", "s_nonnull_ok", "b", "d", "n_failures", "n_failures_2"]
    assert detect_df(df, rules, in_place=True).detected().count() == 4
    with pytest.raises(ValueError):
        detect_df(df, rules, output_fields=["none"])


def test_detection_is_written(spark, tmp_path):
    rules = {"fields": {"i": {"max": 3}}}
    detect_df(frame(spark), rules, outpath=str(tmp_path / "bad.csv"), per_constraint=True, boolean_ints=True, key="i")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "bad.csv"), header=True).collect()] == [("4", "0", "1")]


def test_flags_of_unfit_types(spark):
    rules = {"fields": {"s": {"min": 3, "sign": "positive"}, "i": {"min_length": 1, "rex": ["a"], "type": "string", "sign": "null"}}}
    rows = detect_df(frame(spark), rules, key="i", per_constraint=True, write_all=True).detected().collect()
    assert all(set(list(r)[1:-1]) == {False} for r in rows) and "s_sign_ok" not in rows[0].asDict()


def test_observation_counts_while_rows_pass(spark):
    df, watch = observed(frame(spark), RULES)
    assert df.count() == 4
    assert watch.get == {"n_records": 4, "i_min_failures": 1, "s_nonnull_failures": 1, "s_values_failures": 2, "s_rex_failures": 2}


def test_repair(spark):
    df = spark.createDataFrame([("1", 7, 1.0, "2020-01-01"), (None, 8, 2.0, None)], "b string, s int, t double, d string")
    c = DatasetConstraints.from_dict({"fields": {"s": {"type": "string"}, "t": {"type": "string"}, "d": {"type": "date"}}})
    fixed = repaired(df, c)
    assert dict(fixed.dtypes) == {"b": "string", "s": "string", "t": "string", "d": "timestamp_ntz"} and fixed.first()["t"] == "1"
    lossy = repaired(spark.createDataFrame([("x",)], "d string"), c)
    assert dict(lossy.dtypes) == {"d": "string"}


def test_dots_and_quotes_in_names(spark):
    df = spark.createDataFrame([(1, "x"), (1, None)], "`a.b` int, `c``d` string")
    c = discover_df(df)
    assert list(c.fields) == ["a.b", "c`d"] and verify_df(df, c).failures == 0
    assert detect_df(df, {"fields": {"a.b": {"no_duplicates": True, "min": 2}}}, per_constraint=True).detection.n_failing == 2
