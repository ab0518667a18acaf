"""URL filters by association rules, in DataFrame operations only.

Explicit rules decide first: a rule fits its host and all subdomains if the path starts with the rule's; the longest
wins. For the other URLs, FP-growth mines combinations of URL tokens that go with the label ``block``; combinations with
enough support and confidence, and without a shorter one that does as well, are the mined rules. They match by an
inverted index: each rule is posted under its rarest token, a URL's tokens find the postings, and a rule fires if the
URL has all its tokens.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_side, staged

BLOCK = "label=block"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host labels with their place from the right, and words of the path, digits folded."""
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    words = F.filter(F.split(F.lower(path), r"[^a-z0-9]+"), lambda x: x != "")
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    paths = F.transform(words, lambda x: F.concat(F.lit("p="), F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(x)))
    return F.array_distinct(F.concat(hosts, paths))


def explicit(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The fitting rule of the longest text as struct(rule, verdict), or null. ``rules``: (verdict, ``host/path``)."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        on_host = (host == h) | F.endswith(host, F.lit("." + h))
        fits = F.when(on_host & F.startswith(path, F.lit("/" + p)), F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """Rules ``tokens array<string>, confidence, support``, of any length, from ``tokens array<string>, bad boolean``.

    Only tokens with enough bad rows are mined: others can't be in a rule. A token that bad rows alone have is a rule as
    it is, and as sure as any rule that holds it; it is not mined further, so that a long URL of tokens of its own doesn't
    make the search deep. No labelled rows, or none that are bad, give no rules. The number of rules is bounded by the
    support, not by the rows.
    """
    labelled = staged(labelled.filter("bad is not null").select("tokens", "bad"))
    n = labelled.count()
    empty = labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double")
    if not n:
        return empty
    each = labelled.select(F.explode("tokens").alias("t"), "bad").groupBy("t").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    each = staged(each.filter(F.col("bad") >= F.lit(math.ceil(min_support * n))))
    certain = each.filter("bad = n").select(F.array("t").alias("tokens"), F.lit(1.0).alias("confidence"), (F.col("bad") / n).alias("support"))
    terms = [r["t"] for r in each.filter("bad < n").select("t").sort("t").collect()]  # at most tokens per URL / min_support
    if not terms:
        return staged(certain)
    items = F.array_intersect("tokens", F.array(*(F.lit(t) for t in terms)))
    baskets = labelled.select(F.when(F.col("bad"), F.concat(items, F.array(F.lit(BLOCK)))).otherwise(items).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK))
    rules = staged(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").unionByName(certain))
    less = rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("as_sure"), F.col("tokens")[0].alias("t"))
    covered = rules.select("tokens", "confidence", F.explode("tokens").alias("t")).join(less, "t")
    covered = covered.filter((F.size("less") < F.size("tokens")) & (F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("less", "tokens")) == 0))
    return rules.join(covered.select("tokens").distinct(), "tokens", "left_anti")


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id`` of those pages (page_id, tokens) that have all tokens of some rule, each once, by the inverted index."""
    counts = pages.select(F.explode("tokens").alias("token")).groupBy("token").count()
    posted = rules.select(F.monotonically_increasing_id().alias("rule_no"), "tokens")
    posted = staged(posted)
    anchors = posted.select("rule_no", "tokens", F.explode("tokens").alias("token")).join(counts, "token")
    anchors = anchors.groupBy("rule_no").agg(F.min_by(F.struct("token", "tokens"), F.struct("count", "token")).alias("a")).select(F.col("a.token").alias("token"), F.col("a.tokens").alias("need"))
    hits = pages.select("page_id", "tokens", F.explode("tokens").alias("token")).join(small_side(anchors), "token")
    return hits.filter(F.size(F.array_except("need", "tokens")) == 0).select("page_id").distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labels: DataFrame | None = None, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``labels`` (page_id, bad boolean) teach the mined rules, with the explicit verdicts, which overrule them. A null or
    unparsable URL has empty host and path, no tokens, and verdict allow unless a rule says otherwise; rows that repeat
    stay; pages without label teach nothing; null ids stay and are never taught; no pages give no rows.
    """
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("fit", explicit(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    base = staged(base)
    taught = base.select("page_id", "tokens", (F.col("fit.verdict") == "block").alias("by_rule"))
    if labels is not None:
        said = labels.groupBy("page_id").agg(F.max("bad").alias("said"))
        taught = taught.join(said, "page_id", "left").withColumn("bad", F.coalesce("by_rule", "said"))
    else:
        taught = taught.withColumn("bad", F.col("by_rule"))
    mined = mine(taught, min_support, min_confidence)
    free = base.filter("fit is null and size(tokens) > 0 and page_id is not null").select("page_id", "tokens")
    fired = small_side(match(free, mined)).withColumn("fired", F.lit(True))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("fired"), "block").otherwise("allow"))
    return base.join(fired, "page_id", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
