"""Properties on random tables: what is discovered holds, and expressions match what they come from."""

import datetime
import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veriplumb.operators.detect import detect_df
from veriplumb.operators.discover import discover_df
from veriplumb.operators.rexinfer import extract
from veriplumb.operators.verify import verify_df

ROW = st.tuples(
    st.none() | st.integers(-(2**40), 2**40), st.none() | st.floats(allow_subnormal=False), st.none() | st.text(max_size=8), st.none() | st.booleans(),
    st.none() | st.dates(datetime.date(1900, 1, 1), datetime.date(2100, 1, 1)),
)
CHECKED = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@CHECKED
@given(st.lists(ROW, max_size=12))
def test_discovered_constraints_hold(spark, rows):
    df = spark.createDataFrame(rows, "i long, r double, s string, b boolean, d date")
    found = discover_df(df, inc_rex=True)
    result = verify_df(df, found)
    assert result.failures == 0, (rows, str(result))
    again = type(found).from_dict(found.to_dict())
    assert verify_df(df, again).failures == 0


@CHECKED
@given(st.lists(ROW, min_size=1, max_size=12), st.integers(-5, 5))
def test_detection_agrees_with_verification(spark, rows, bound):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, i long, r double, s string, b boolean, d date")
    v = detect_df(df, {"fields": {"i": {"min": bound}, "s": {"max_length": 3, "no_duplicates": True}}}, key="k")
    bad = set()
    texts = [r[2] for r in rows if r[2] is not None]
    for k, r in enumerate(rows):
        if r[0] is not None and r[0] < bound or r[2] is not None and (len(r[2]) > 3 or texts.count(r[2]) > 1):
            bad.add(k)
    assert (v.detection is None and not bad) or {x["k"] for x in v.detected().collect()} == bad
    assert v.failures == sum([any(r[0] is not None and r[0] < bound for r in rows), any(len(t) > 3 for t in texts), len(set(texts)) < len(texts)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=10), st.booleans())
def test_expressions_match_their_strings(strings, variable):
    found = [re.compile(r, re.DOTALL) for r in extract(strings, variable=variable)]
    assert all(any(r.match(s) for r in found) for s in strings), (strings, found)
    assert not math.isnan(len(found))
