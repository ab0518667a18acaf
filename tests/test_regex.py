import re

import pytest

from veriplumb.functions.regexes import bracket, matches, matches_any, to_java
from veriplumb.operators.rexinfer import Classes, coverage, extract, first_state, greedy_cover, incremental_coverage, infer, merge


@pytest.mark.parametrize(
    ("strings", "options", "want"),
    [
        (["one", "two", None], {}, ["^[a-z]{3}$"]),
        (["one", "two", "three"], {}, ["^[a-z]{3,5}$"]),
        (["EH3 1LH", "G4 2BP"], {}, ["^[A-Z]{1,2}[0-9] [0-9][A-Z]{2}$"]),
        (["EH3 1LH", "g4 2bp"], {}, ["^[A-Za-z0-9]{2,3} [A-Za-z0-9]{3}$"]),
        (["EH12 3LH", "AL64 1BB"], {"dialect": "perl"}, [r"^[A-Z]{2}\d{2} \d[A-Z]{2}$"]),
        (["12-3", "45-6"], {"dialect": "java"}, [r"^\p{Digit}{2}\-\p{Digit}$"]),
        (["12-3", "45-6"], {"dialect": "posix"}, [r"^[[:digit:]]{2}\-[[:digit:]]$"]),
        (["12-3", "45-6"], {"tag": True}, [r"^([0-9]{2})\-([0-9])$"]),
        (["a_b", "c_d"], {"extra_letters": "_"}, ["^[a-z][A-Z_][a-z]$"]),
        ([" 1", "22 ", ""], {"strip": True, "remove_empties": True}, [r"^\s*[0-9]{1,2}\s*$"]),
        ([""], {}, ["^$"]),
        ([None], {}, []),
        (["x!", "y?", "z."], {}, ["^[a-z][!.?]$"]),
        (["aa", "aaaa"], {}, ["^a{2,4}$"]),
        (["aa", "aaaaaa"], {}, ["^a+$"]),
        (["x" * 3 + " " * k for k in (1, 9)], {}, [r"^xxx +$"]),
        (["éa", "ñb"], {}, [r"^[^\W0-9_][a-z]$"]),
        (["<" * k + ">" for k in range(2, 4)], {}, ["^[<>]{3,4}$"]),
        ([("z1" * 60)[:k] for k in (119, 120)], {}, ["^[a-z0-9]{119,120}$"]),
        (["a-" * 60, "b-" * 55], {}, ["^.+$"]),
    ],
)
def test_extract(strings, options, want):
    assert extract(strings, **options) == want


def test_pruning():
    counted = {"aa_bb": 10, ".123": 5, "a": 1, "b.": 2}
    assert extract(counted) == ["^a$", r"^\.123$", r"^b\.$", "^aa_bb$"]
    assert extract(counted, max_patterns=2) == [r"^\.123$", "^aa_bb$"]
    assert extract(counted, min_strings_per_pattern=2) == [r"^\.123$", r"^b\.$", "^aa_bb$"]
    with pytest.raises(ValueError):
        extract(["a", True])


def test_variable_lengths():
    assert extract(["www.a", "web.b"], variable=True) == [r"^w{1,3}e?b?\.[a-z]$"]


def test_states_merge_in_any_order():
    c = Classes()
    states = [first_state(s, c)[1] for s in ("ab12-x", "c3-yy", "def456-z")]
    a, b = merge(merge(states[0], states[1]), states[2]), merge(states[0], merge(states[1], states[2]))
    assert a == b


def test_greedy_cover():
    freq = {"One": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7}
    patterns = ["^f.+$", "^.{3}$", "^[st].+$"]
    vectors = [([bool(re.match(p, s)) for p in patterns], n, 1) for s, n in freq.items()]
    out = greedy_cover(vectors, patterns)
    assert [(k, c.n, c.n_uniq, c.incr, c.incr_uniq, c.index) for k, c in out.items()] == [("^[st].+$", 18, 4, 18, 4, 2), ("^f.+$", 9, 2, 9, 2, 0), ("^.{3}$", 10, 4, 2, 2, 1)]
    assert list(greedy_cover(vectors, patterns, dedup=True)) == ["^.{3}$", "^[st].+$", "^f.+$"]


def test_column_as_on_the_driver(spark):
    for name, column in (("part", "p_brand"), ("pages", "url"), ("customer", "c_name"), ("orders", "o_orderpriority")):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(column)
        strings = [r[0] for r in df.collect()]
        found, plain = infer(df, column), extract(strings, as_object=True)
        assert (found.rex, found.frequencies, found.n_strings) == (plain.rex, plain.frequencies, len(strings))
        assert sum(found.frequencies) == len(strings)


def test_column_options(spark):
    df = spark.createDataFrame([(" a1 ", "b2"), ("c3", None), ("", "d4")], "x string, y string")
    found = infer(df, ["x", "y"], strip=True, remove_empties=True)
    assert found.rex == [r"^\s*[a-z][0-9]\s*$"] and (found.n_nulls, found.n_stripped, found.n_empties) == (1, 1, 1)
    assert infer(df.limit(0), "x").rex == [] and infer(df, "y", sample=1, seed=3).rex[0] in ("^b2$", "^d4$")
    assert infer(df, "x", dialect="perl", remove_empties=True).rex


def test_coverage(spark):
    df = spark.createDataFrame([("ab",), ("ab",), ("a1",), (None,)], "s string")
    assert [tuple(r) for r in coverage(df, "s", ["^a", "^ab$", "^z"]).collect()] == [("^a", 3), ("^ab$", 2), ("^z", 0)]
    assert [r["n"] for r in coverage(df, "s", ["^a", "^ab$"], dedup=True).collect()] == [2, 1]
    assert list(incremental_coverage(df, "s", ["^ab$", "^a"])) == ["^a", "^ab$"]


PATTERNS = ["^a$", "a.c", r"^[^\W_]+$", r"^\d+$", "[[&a]", "[]a]+", "[^]a]", r"^a\Z", "x|ab", r"\s", r"^[a&&b]+$", r"(?P<n>a)b", r"^(a)(?(1)b|c)$", r"[\]\-^]", "ü"]
STRINGS = ["a", "a\n", "abc", "a\nc", "é1", "12", "٣", "[", "&", "]", "ab", "b", "", " ", " ", "a\r", "x", "ü", "-", "^", "ac"]


def test_java_matches_as_python(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS] + [(None,)], "s string")
    rows = df.select("s", *(matches(df["s"], p).alias(f"p{i}") for i, p in enumerate(PATTERNS))).collect()
    for r in rows:
        for i, p in enumerate(PATTERNS):
            want = None if r["s"] is None else re.match(p, r["s"], re.UNICODE | re.DOTALL) is not None
            assert r[f"p{i}"] == want, (p, r["s"])
    with pytest.raises(ValueError):
        to_java("(?P<x>a)")
    assert [r[0] for r in df.select(matches_any(df["s"], [])).distinct().collect() if r[0] is not None] == [False]


def test_brackets():
    for chars in ("]", "^", "-", "\\", "]^-\\ab", "a-", "^]", "[&"):
        assert all(re.fullmatch(bracket(list(chars)), c) for c in chars) and not re.fullmatch(bracket(list(chars)), "Q")


def test_views_of_expressions():
    from veriplumb.functions.rexview import as_html, as_text, fragments

    assert fragments(r"^ab\-[A-Z]{2}(x)+$") == [("anchor", "^", ""), ("literal", r"ab\-", ""), ("class", "[A-Z]", "{2}"), ("group", "(x)", "+"), ("anchor", "$", "")]
    assert "".join(t + q for _, t, q in fragments(r"^[]<-]*\d?[[:alpha:]]\p{Upper}.$")) == r"^[]<-]*\d?[[:alpha:]]\p{Upper}.$"
    assert "&lt;" in as_html("^<$") and as_text("^a$").count("\n") == 2


def test_check_function():
    from veriplumb.operators.rexinfer import extract_checked

    strings = [f"{'ab'[i % 2]}{i}" for i in range(50)] + ["x-y", "z-w"]

    def check(found, most):
        return {s: 1 for s in [s for s in strings if not any(re.match(p, s) for p in found)][:most]}

    assert extract_checked(check, most=5) == ["^[a-z][0-9]{1,2}$", r"^[a-z]\-[a-z]$"]


def test_package_exports():
    import veriplumb

    assert all(getattr(veriplumb, n) for n in veriplumb.__all__)
