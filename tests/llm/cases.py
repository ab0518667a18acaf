"""Documents that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import os

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def documents(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"), (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (3, None, "en", "b"), (4, "", None, "b"), (5, "  \t\n ", "en", None), (6, "one", "en", "a"), (7, "one", None, None), (8, long, "de", "c"),
        (9, long + " end", "de", "c"), (None, "no id here at all", "en", "a"), (None, None, None, None), (6, "one", "en", "a"), (10, "éàü 漢字 😀 mixed \x00 text", "fr", ""),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


def clashing(df):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["row", "node", "sig", "size", "target", "kept", "slot", "shard", "key", "run", "draw", "part", "length", "offset", "score", "lang_pred", "evidence", "path_key", "u", "v", "label", "id", "hash", "copy", "carried", "class", "posterior"]
    return df.withColumns({n: F.lit(7) for n in names if n not in df.columns})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
