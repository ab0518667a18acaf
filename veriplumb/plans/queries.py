"""Queries that run the operators on the driver's tables, with the SQL that gives the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import convert_dates, infer_date_format, parsed
from ..functions.staging import new_place
from ..functions.types import col, field_types, normalised
from ..operators import compare as cmp
from ..operators.detect import detect_df
from ..operators.discover import discover_df
from ..operators.model import DatasetConstraints
from ..operators.profile import exact_distinct, profile_table, statistics, unique_values
from ..operators.rexinfer import coverage, first_match, incremental_coverage, infer, matching_examples, runs
from ..operators.textdiff import compare_huge
from ..operators.verify import repaired, verify_df, violating_values
from ..sources.readers import load, read_csv_with_metadata, read_text_table, upgrade_integral_floats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with nulls and NaN: small values are null, and one type."""
    e = _t(spark, sf_dir, "events")
    return e.withColumn("value", F.when(F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value"))).withColumn("event_type", F.nullif("event_type", F.lit("click")))


EVENTS = "(SELECT event_id, ts, user_id, NULLIF(event_type, 'click') AS event_type, CASE WHEN value < 10 THEN NULL ELSE value END AS value, props FROM events)"


def long_form(df: DataFrame, stats: dict[str, str], fields: list[str] | None = None) -> DataFrame:
    """One row per column with the statistics named, cast to the types given."""
    kinds = {n: k for n, k in field_types(df).items() if fields is None or n in fields}
    df = normalised(df)
    rows = []
    for n, k in kinds.items():
        s = statistics(n, k) | {"n_records": F.count(F.lit(1))}
        s["n_nulls"] = s["n_records"] - s["n_nonnull"]
        rows.append(F.struct(F.lit(n).alias("field"), *(s[key].cast(t).alias(key) for key, t in stats.items())))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def union_sql(fields: list[str], select: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS field, {select.format(c=f)} FROM {source}" for f in fields)


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
NUMBERS = LINEITEM[:8]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS n_records FROM {t}" for t in ("region", "nation", "orders", "lineitem", "events")))
def stat_row_count(spark, sf_dir):
    parts = [_t(spark, sf_dir, t).agg(F.count("*").alias("n_records")).select(F.lit(t).alias("table_name"), "n_records") for t in ("region", "nation", "orders", "lineitem", "events")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(union_sql(["event_id", "ts", "user_id", "event_type", "value", "props"], "CAST(COUNT(*) AS BIGINT) AS n_records, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS n_nulls, CAST(COUNT({c}) AS BIGINT) AS n_nonnull", EVENTS))
def stat_nulls(spark, sf_dir):
    return long_form(_events(spark, sf_dir), {"n_records": "long", "n_nulls": "long", "n_nonnull": "long"})


@query(union_sql(NUMBERS, "CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max", "lineitem"))
def stat_min_max_numeric(spark, sf_dir):
    return long_form(_t(spark, sf_dir, "lineitem"), {"min": "double", "max": "double"}, NUMBERS)


@query("SELECT 'o_orderdate' AS field, strftime(MIN(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min, strftime(MAX(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max FROM orders")
def stat_min_max_date(spark, sf_dir):
    return _t(spark, sf_dir, "orders").agg(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(k) for k, c in statistics("o_orderdate", "date").items() if k in ("min", "max"))).select(F.lit("o_orderdate").alias("field"), "min", "max")


@query(union_sql(["p_name", "p_brand", "p_type"], "MIN({c}) AS min, MAX({c}) AS max", "part"))
def stat_min_max_string(spark, sf_dir):
    return long_form(_t(spark, sf_dir, "part"), {"min": "string", "max": "string"}, ["p_name", "p_brand", "p_type"])


@query(" UNION ALL ".join(union_sql(fs, "CAST(MIN(LENGTH({c})) AS BIGINT) AS min_length, CAST(MAX(LENGTH({c})) AS BIGINT) AS max_length", t) for t, fs in (("customer", ["c_name", "c_mktsegment"]), ("documents", ["text", "lang", "source"]), ("pages", ["url", "html"]))))
def stat_lengths(spark, sf_dir):
    want = {"min_length": "long", "max_length": "long"}
    return long_form(_t(spark, sf_dir, "customer"), want, ["c_name", "c_mktsegment"]).unionAll(long_form(_t(spark, sf_dir, "documents"), want, ["text", "lang", "source"])).unionAll(long_form(_t(spark, sf_dir, "pages"), want, ["url", "html"]))


@query(union_sql(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "CAST(COUNT(DISTINCT {c}) AS BIGINT) AS n_distinct", "orders"))
def stat_distinct(spark, sf_dir):
    found = exact_distinct(_t(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return spark.createDataFrame(list(found.items()), "field string, n_distinct long")


@query(f"SELECT DISTINCT event_type AS value FROM {EVENTS}")
def stat_unique_values(spark, sf_dir):
    return unique_values(_events(spark, sf_dir), "event_type", include_nulls=True).withColumnRenamed("event_type", "value")


@query(union_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "CAST(COUNT(*) FILTER ({c} <> FLOOR({c})) AS BIGINT) AS non_integral", "lineitem"))
def stat_non_integral(spark, sf_dir):
    return long_form(_t(spark, sf_dir, "lineitem"), {"non_integral": "long"}, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, '{k}' AS type, CAST(COUNT(*) AS BIGINT) AS n_records, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS n_nulls, {'CAST(MIN(LENGTH(' + c + ')) AS BIGINT)' if k == 'string' else 'CAST(NULL AS BIGINT)'} AS min_length, {'CAST(MAX(LENGTH(' + c + ')) AS BIGINT)' if k == 'string' else 'CAST(NULL AS BIGINT)'} AS max_length, {'CAST(COUNT(*) FILTER (' + c + ' <> FLOOR(' + c + ')) AS BIGINT)' if k == 'real' else 'CAST(NULL AS BIGINT)'} AS non_integral FROM orders" for c, k in (("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"), ("o_totalprice", "real"), ("o_orderdate", "date"), ("o_orderpriority", "string"))))
def profile_one_pass(spark, sf_dir):
    return profile_table(_t(spark, sf_dir, "orders")).drop("min", "max")


def _discovered(spark, df, kind):
    return discover_df(df).to_df(spark).filter(F.col("kind") == kind).select("field", "value")


SIGN = "CASE WHEN MIN({c}) = 0 AND MAX({c}) = 0 THEN '\"zero\"' WHEN MIN({c}) > 0 THEN '\"positive\"' WHEN MIN({c}) >= 0 THEN '\"non-negative\"' WHEN MAX({c}) < 0 THEN '\"negative\"' WHEN MAX({c}) <= 0 THEN '\"non-positive\"' END"


@query("SELECT * FROM (" + union_sql(NUMBERS, SIGN + " AS value", "lineitem") + ") WHERE value IS NOT NULL")
def discover_sign(spark, sf_dir):
    return _discovered(spark, _t(spark, sf_dir, "lineitem").select(*NUMBERS), "sign")


@query(union_sql(NUMBERS, "CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max", "lineitem"))
def discover_minmax(spark, sf_dir):
    rows = discover_df(_t(spark, sf_dir, "lineitem").select(*NUMBERS), kinds=("min", "max")).to_df(spark)
    return rows.groupBy("field").agg(*(F.max(F.when(F.col("kind") == k, F.col("value").cast("double"))).alias(k) for k in ("min", "max")))


@query(union_sql(["c_name", "c_mktsegment"], "CAST(MIN(LENGTH({c})) AS BIGINT) AS min_length, CAST(MAX(LENGTH({c})) AS BIGINT) AS max_length", "customer"))
def discover_lengths(spark, sf_dir):
    rows = discover_df(_t(spark, sf_dir, "customer")).to_df(spark).filter(F.col("kind").isin("min_length", "max_length"))
    return rows.groupBy("field").agg(*(F.max(F.when(F.col("kind") == k, F.col("value").cast("long"))).alias(k) for k in ("min_length", "max_length")))


@query("SELECT field, value FROM (" + union_sql(["event_id", "ts", "user_id", "event_type", "value", "props"], "CAST(COUNT(*) - COUNT({c}) AS VARCHAR) AS value", EVENTS) + ") WHERE CAST(value AS BIGINT) < 2")
def discover_nulls(spark, sf_dir):
    return _discovered(spark, _events(spark, sf_dir), "max_nulls")


@query("SELECT field, v AS value FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, '[\"' || string_agg(v, '\", \"' ORDER BY v) || '\"]' AS v, COUNT(*) AS n FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL)" for c, t in (("o_orderstatus", "orders"), ("o_orderpriority", "orders"))) + ") WHERE n <= 20")
def discover_allowed(spark, sf_dir):
    return _discovered(spark, _t(spark, sf_dir, "orders"), "allowed_values")


@query("SELECT field, 'true' AS value FROM (" + union_sql(["n_nationkey", "n_name", "n_regionkey"], "COUNT(DISTINCT {c}) AS d, COUNT({c}) AS n", "nation") + ") WHERE d = n AND d > 1")
def discover_unique(spark, sf_dir):
    return _discovered(spark, _t(spark, sf_dir, "nation"), "no_duplicates")


def _verified(spark, df, fields, epsilon=None, **options):
    return verify_df(df, {"fields": fields}, epsilon, **options).to_df(spark)


def _verify_sql(field: str, kinds: dict[str, str], source: str) -> str:
    tests = ", ".join(f"({t}) AS {k}" for k, t in kinds.items())
    flags = [f"CAST({k} AS INT)" for k in kinds]
    return f"SELECT '{field}' AS field, CAST({len(kinds)} - ({' + '.join(flags)}) AS BIGINT) AS failures, CAST({' + '.join(flags)} AS BIGINT) AS passes, {', '.join(kinds)} FROM (SELECT {tests} FROM {source})"


@query(_verify_sql("o_totalprice", {"min": "MIN(o_totalprice) >= 1000", "max": "MAX(o_totalprice) <= 400000"}, "orders"))
def verify_min_max_closed(spark, sf_dir):
    return _verified(spark, _t(spark, sf_dir, "orders"), {"o_totalprice": {"min": {"value": 1000, "precision": "closed"}, "max": {"value": 400000, "precision": "closed"}}})


@query(_verify_sql("l_quantity", {"min": "MIN(l_quantity) > 1", "max": "MAX(l_quantity) < 51"}, "lineitem"))
def verify_min_max_open(spark, sf_dir):
    return _verified(spark, _t(spark, sf_dir, "lineitem"), {"l_quantity": {"min": {"value": 1, "precision": "open"}, "max": {"value": 51, "precision": "open"}}})


@query(_verify_sql("c_acctbal", {"min": "MIN(c_acctbal) >= -900.0 * 1.2", "max": "MAX(c_acctbal) <= 9000.0 * 1.2"}, "customer"))
def verify_min_max_fuzzy(spark, sf_dir):
    return _verified(spark, _t(spark, sf_dir, "customer"), {"c_acctbal": {"min": -900.0, "max": 9000.0}}, 0.2)


@query(_verify_sql("c_acctbal", {"sign": "MIN(c_acctbal) >= 0"}, "customer") + " UNION ALL " + _verify_sql("c_custkey", {"sign": "MIN(c_custkey) > 0"}, "customer"))
def verify_sign(spark, sf_dir):
    out = _verified(spark, _t(spark, sf_dir, "customer"), {"c_acctbal": {"sign": "non-negative"}, "c_custkey": {"sign": "positive"}})
    return out


@query(_verify_sql("value", {"max_nulls": "COUNT(*) - COUNT(value) <= 5"}, EVENTS) + " UNION ALL " + _verify_sql("ts", {"max_nulls": "COUNT(*) - COUNT(ts) <= 0"}, EVENTS))
def verify_max_nulls(spark, sf_dir):
    return _verified(spark, _events(spark, sf_dir), {"value": {"max_nulls": 5}, "ts": {"max_nulls": 0}})


@query(_verify_sql("o_orderkey", {"no_duplicates": "COUNT(DISTINCT o_orderkey) = COUNT(o_orderkey)"}, "orders") + " UNION ALL " + _verify_sql("o_custkey", {"no_duplicates": "COUNT(DISTINCT o_custkey) = COUNT(o_custkey)"}, "orders"))
def verify_nodups(spark, sf_dir):
    return _verified(spark, _t(spark, sf_dir, "orders"), {"o_orderkey": {"no_duplicates": True}, "o_custkey": {"no_duplicates": True}})


@query(_verify_sql("o_orderstatus", {"allowed_values": "COUNT(*) FILTER (o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')) = 0"}, "orders") + " UNION ALL " + _verify_sql("o_orderpriority", {"allowed_values": "COUNT(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) = 0"}, "orders"))
def verify_allowed(spark, sf_dir):
    return _verified(spark, _t(spark, sf_dir, "orders"), {"o_orderstatus": {"allowed_values": ["F", "O"]}, "o_orderpriority": {"allowed_values": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}})


@query(_verify_sql("c_name", {"rex": "COUNT(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]+')) = 0"}, "customer") + " UNION ALL " + _verify_sql("c_mktsegment", {"rex": "COUNT(*) FILTER (NOT regexp_matches(c_mktsegment, '^[A-M]+$')) = 0"}, "customer"))
def verify_rex(spark, sf_dir):
    return _verified(spark, _t(spark, sf_dir, "customer"), {"c_name": {"rex": ["^Customer#[0-9]+"]}, "c_mktsegment": {"rex": ["^[A-M]+$"]}})


@query(_verify_sql("c_name", {"min_length": "MIN(LENGTH(c_name)) >= 10", "max_length": "MAX(LENGTH(c_name)) <= 12"}, "customer"))
def verify_lengths(spark, sf_dir):
    return _verified(spark, _t(spark, sf_dir, "customer"), {"c_name": {"min_length": 10, "max_length": 12}})


@query(_verify_sql("l_quantity", {"type": "COUNT(*) FILTER (l_quantity <> FLOOR(l_quantity)) = 0"}, "lineitem") + " UNION ALL " + _verify_sql("l_tax", {"type": "COUNT(*) FILTER (l_tax <> FLOOR(l_tax)) = 0"}, "lineitem"))
def verify_type_sloppy(spark, sf_dir):
    return _verified(spark, _t(spark, sf_dir, "lineitem"), {"l_quantity": {"type": "int"}, "l_tax": {"type": "int"}})


CUSTOMER = {"c_custkey": {"type": "int", "min": 1, "no_duplicates": True}, "c_name": {"type": "string", "min_length": 18, "max_length": 18}, "c_acctbal": {"type": "real", "min": 0.0, "max": 9000.0}, "c_missing": {"type": "int"}}
TO_FRAME = (
    "SELECT field, CAST((type = false)::INT + COALESCE((min = false)::INT, 0) + COALESCE((min_length = false)::INT, 0) + COALESCE((max = false)::INT, 0) + COALESCE((max_length = false)::INT, 0) + COALESCE((no_duplicates = false)::INT, 0) AS BIGINT) AS failures, "
    "CAST(type::INT + COALESCE(min::INT, 0) + COALESCE(min_length::INT, 0) + COALESCE(max::INT, 0) + COALESCE(max_length::INT, 0) + COALESCE(no_duplicates::INT, 0) AS BIGINT) AS passes, type, min, min_length, max, max_length, no_duplicates FROM ("
    "SELECT 'c_missing' AS field, false AS type, NULL::BOOLEAN AS min, NULL::BOOLEAN AS min_length, NULL::BOOLEAN AS max, NULL::BOOLEAN AS max_length, NULL::BOOLEAN AS no_duplicates"
    " UNION ALL SELECT 'c_custkey', true, MIN(c_custkey) >= 1, NULL, NULL, NULL, COUNT(DISTINCT c_custkey) = COUNT(c_custkey) FROM customer"
    " UNION ALL SELECT 'c_name', true, NULL, MIN(LENGTH(c_name)) >= 18, NULL, MAX(LENGTH(c_name)) <= 18, NULL FROM customer"
    " UNION ALL SELECT 'c_acctbal', true, MIN(c_acctbal) >= 0, NULL, MAX(c_acctbal) <= 9000, NULL, NULL FROM customer)"
)


@query(TO_FRAME)
def verify_to_frame(spark, sf_dir):
    return _verified(spark, _t(spark, sf_dir, "customer"), CUSTOMER)


def _detected(df, fields, key, **options):
    return detect_df(df, {"fields": fields}, key=key, per_constraint=True, write_all=True, **options).detected()


@query("SELECT o_orderkey, o_totalprice >= 50000 AS o_totalprice_min_ok, o_totalprice <= 300000 AS o_totalprice_max_ok, CAST((o_totalprice < 50000)::INT + (o_totalprice > 300000)::INT AS BIGINT) AS n_failures FROM orders")
def detect_min_max(spark, sf_dir):
    return _detected(_t(spark, sf_dir, "orders"), {"o_totalprice": {"min": 50000, "max": 300000}}, "o_orderkey")


@query("SELECT c_custkey, c_acctbal >= 0 AS c_acctbal_sign_ok, CAST((c_acctbal < 0)::INT AS BIGINT) AS n_failures FROM customer")
def detect_sign(spark, sf_dir):
    return _detected(_t(spark, sf_dir, "customer"), {"c_acctbal": {"sign": "non-negative"}}, "c_custkey")


@query("SELECT page_id, LENGTH(url) <= 40 AS url_max_length_ok, CAST((LENGTH(url) > 40)::INT AS BIGINT) AS n_failures FROM pages")
def detect_length(spark, sf_dir):
    return _detected(_t(spark, sf_dir, "pages"), {"url": {"max_length": 40}}, "page_id")


@query(f"SELECT event_id, value IS NOT NULL AS value_nonnull_ok, event_type IS NOT NULL AS event_type_nonnull_ok, CAST((value IS NULL)::INT + (event_type IS NULL)::INT AS BIGINT) AS n_failures FROM {EVENTS}")
def detect_nulls(spark, sf_dir):
    return _detected(_events(spark, sf_dir), {"value": {"max_nulls": 1}, "event_type": {"max_nulls": 0}}, "event_id")


@query("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) = 1 AS o_custkey_nodups_ok, CAST((COUNT(*) OVER (PARTITION BY o_custkey) > 1)::INT AS BIGINT) AS n_failures FROM orders")
def detect_dups(spark, sf_dir):
    return _detected(_t(spark, sf_dir, "orders"), {"o_custkey": {"no_duplicates": True}}, "o_orderkey")


@query(f"SELECT event_id, CASE WHEN event_type IS NOT NULL THEN event_type IN ('view', 'purchase') END AS event_type_values_ok, CAST(COALESCE((event_type NOT IN ('view', 'purchase'))::INT, 0) AS BIGINT) AS n_failures FROM {EVENTS}")
def detect_allowed(spark, sf_dir):
    return _detected(_events(spark, sf_dir), {"event_type": {"allowed_values": ["view", "purchase"]}}, "event_id")


@query("SELECT p_partkey, regexp_matches(p_brand, '^Brand#[1-3][0-9]$') AS p_brand_rex_ok, CAST((NOT regexp_matches(p_brand, '^Brand#[1-3][0-9]$'))::INT AS BIGINT) AS n_failures FROM part")
def detect_rex(spark, sf_dir):
    return _detected(_t(spark, sf_dir, "part"), {"p_brand": {"rex": [r"^Brand#[1-3][0-9]$"]}}, "p_partkey")


ORDER_RULES = {"o_totalprice": {"min": 20000, "max": 350000}, "o_orderpriority": {"allowed_values": ["1-URGENT", "2-HIGH"]}, "o_orderstatus": {"max_length": 1}}
BAD_ORDER = "((o_totalprice < 20000)::INT + (o_totalprice > 350000)::INT + (o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))::INT)"


@query(f"SELECT o_orderkey, CAST({BAD_ORDER} AS BIGINT) AS n_failures FROM orders")
def detect_n_failures(spark, sf_dir):
    return detect_df(_t(spark, sf_dir, "orders"), {"fields": ORDER_RULES}, key="o_orderkey", write_all=True).detected()


@query(f"SELECT CAST(COUNT(*) FILTER ({BAD_ORDER} = 0) AS BIGINT) AS n_passing, CAST(COUNT(*) FILTER ({BAD_ORDER} > 0) AS BIGINT) AS n_failing FROM orders")
def detect_counts(spark, sf_dir):
    d = detect_df(_t(spark, sf_dir, "orders"), {"fields": ORDER_RULES}, key="o_orderkey").detection
    return spark.createDataFrame([(d.n_passing, d.n_failing)], "n_passing long, n_failing long")


@query(f"SELECT *, CAST({BAD_ORDER} AS BIGINT) AS n_failures FROM orders WHERE {BAD_ORDER} > 0")
def detect_failing_rows(spark, sf_dir):
    return detect_df(_t(spark, sf_dir, "orders"), {"fields": ORDER_RULES}, key="o_orderkey", output_fields=[]).detected()


@query("SELECT *, c_acctbal >= 0 AS c_acctbal_min_ok, CAST((c_acctbal < 0)::INT AS BIGINT) AS n_failures FROM customer WHERE c_acctbal < 0")
def detect_interleave(spark, sf_dir):
    return detect_df(_t(spark, sf_dir, "customer"), {"fields": {"c_acctbal": {"min": 0.0}}}, key="c_custkey", output_fields=[], interleave=True, per_constraint=True).detected()


BRANDS = ["^Brand#[1-2][0-9]$", "^Brand#[0-9]3$", "^Brand#5[0-9]$"]


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, CAST(COUNT(*) FILTER (regexp_matches(p_brand, '{p}')) AS BIGINT) AS n FROM part" for p in BRANDS))
def rex_coverage(spark, sf_dir):
    return coverage(_t(spark, sf_dir, "part"), "p_brand", BRANDS)


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, CAST(COUNT(DISTINCT p_brand) FILTER (regexp_matches(p_brand, '{p}')) AS BIGINT) AS n FROM part" for p in BRANDS))
def rex_coverage_dedup(spark, sf_dir):
    return coverage(_t(spark, sf_dir, "part"), "p_brand", BRANDS, dedup=True)


FIRST = "CASE " + " ".join(f"WHEN regexp_matches(p_brand, '{p}') THEN {i}" for i, p in enumerate(BRANDS)) + " END"


@query(f"SELECT {FIRST} AS pattern, CAST(COUNT(*) AS BIGINT) AS n FROM part GROUP BY 1")
def rex_first_match(spark, sf_dir):
    counted = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("s")).agg(F.count("*").alias("n"))
    return first_match(counted, BRANDS).groupBy("pattern").agg(F.sum("n").alias("n"))


@query(f"SELECT p_brand AS s, CAST(COUNT(*) AS BIGINT) AS n, {FIRST} AS pattern FROM part GROUP BY p_brand")
def rex_matching_examples(spark, sf_dir):
    return matching_examples(_t(spark, sf_dir, "part"), "p_brand", BRANDS)


@query("SELECT regexp_replace(regexp_replace(regexp_replace(url, '[A-Za-z0-9]+', 'W', 'g'), '[!-/:-@\\[-`{-~]+', '.', 'g'), '\\s+', ' ', 'g') AS shape, CAST(COUNT(*) AS BIGINT) AS n FROM pages GROUP BY 1")
def rex_signature_groups(spark, sf_dir):
    from ..operators.rexinfer import Classes

    kind = Classes().kind

    def shapes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(k for k, _ in runs(s, kind)).replace("Ḉ", "W") for s in b.column("url").to_pylist()]), b.column("n")], names=["shape", "n"])

    counted = _t(spark, sf_dir, "pages").groupBy("url").agg(F.count("*").alias("n"))
    return counted.mapInArrow(shapes, "shape string, n long").groupBy("shape").agg(F.sum("n").alias("n"))


def _width(low: str, high: str, one: str) -> str:
    """SQL for a class with its quantifier, from the least and most length of a run."""
    return f"""CASE WHEN {low} = {high} THEN '{one}' || CASE WHEN {low} = 1 THEN '' ELSE '{{' || {low} || '}}' END WHEN {high} - {low} <= 2 THEN '{one}{{' || {low} || ',' || {high} || '}}' ELSE '{one}+' END"""


@query(f"""SELECT '^Brand\\#' || {_width("MIN(LENGTH(p_brand)) - 6", "MAX(LENGTH(p_brand)) - 6", "[0-9]")} || '$' AS rex, CAST(COUNT(*) AS BIGINT) AS n FROM part
UNION ALL SELECT '^' || {_width("MIN(LENGTH(p_type))", "MAX(LENGTH(p_type))", "[A-Z]")} || '$', CAST(COUNT(*) AS BIGINT) FROM part""")
def rex_infer(spark, sf_dir):
    found = infer(_t(spark, sf_dir, "part"), ["p_brand", "p_type"])
    return spark.createDataFrame(list(zip(found.rex, found.frequencies, strict=True)), "rex string, n long")


@query()
def rex_infer_urls(spark, sf_dir):
    found = infer(_t(spark, sf_dir, "pages"), "url")
    return spark.createDataFrame(list(zip(found.rex, found.frequencies, strict=True)), "rex string, n long")


def _greedy_sql() -> str:
    """Greedy coverage by three patterns, a step each: the most new rows, ties by text; then without the strings it matches."""
    sql = ["WITH s AS (SELECT p_brand AS s, COUNT(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1)", "p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(BRANDS)) + ") AS t(place, rex))", "m AS (SELECT place, rex, s, n FROM p JOIN s ON regexp_matches(s, rex))"]
    for k in range(len(BRANDS)):
        gone = " UNION ALL ".join(f"SELECT place FROM f{j}" for j in range(k)) or "SELECT -1"
        sql.append(f"f{k} AS (SELECT p.place, p.rex, COALESCE(SUM(m.n), 0) AS incr, COUNT(m.s) AS incr_uniq FROM p LEFT JOIN (SELECT * FROM m WHERE s NOT IN (SELECT s FROM m WHERE place IN ({gone}))) m ON m.place = p.place WHERE p.place NOT IN ({gone}) GROUP BY 1, 2 ORDER BY incr DESC, p.rex LIMIT 1)")
    every = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(len(BRANDS)))
    return ", ".join(sql) + f" SELECT f.rex, CAST(COALESCE(SUM(m.n), 0) AS BIGINT) AS n, CAST(COUNT(m.s) AS BIGINT) AS n_uniq, CAST(f.incr AS BIGINT) AS incr, CAST(f.incr_uniq AS BIGINT) AS incr_uniq, CAST(f.place AS BIGINT) AS place FROM ({every}) f LEFT JOIN m ON m.place = f.place GROUP BY f.rex, f.incr, f.incr_uniq, f.place"


@query(_greedy_sql())
def rex_incremental_coverage(spark, sf_dir):
    found = incremental_coverage(_t(spark, sf_dir, "part"), "p_brand", BRANDS)
    return spark.createDataFrame([(k, c.n, c.n_uniq, c.incr, c.incr_uniq, c.index) for k, c in found.items()], "rex string, n long, n_uniq long, incr long, incr_uniq long, place long")


def _changed(df):
    """A copy of orders with prices raised a little, some statuses lost, and some rows left out."""
    k = F.col("o_orderkey")
    return df.filter(k % 50 != 7).withColumn("o_totalprice", F.when(k % 10 == 3, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(k % 9 != 2, F.col("o_orderstatus")))


CHANGED = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 9 <> 2 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 0.5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 50 <> 7)"
FIELDS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
MASKS = ", ".join(f"(a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.{c} IS DISTINCT FROM b.{c}) AS {c}" for c in FIELDS)


@query(f"SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NOT NULL AS in_actual, b.o_orderkey IS NOT NULL AS in_expected, {MASKS} FROM {CHANGED} a FULL JOIN orders b ON a.o_orderkey = b.o_orderkey")
def cmp_cell_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return cmp.cell_masks(_changed(o), o, ["o_orderkey"])


@query(f"SELECT o_orderkey, CAST({' + '.join(f'{c}::INT' for c in FIELDS)} AS BIGINT) AS n_diffs FROM (SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS o_orderkey, {MASKS} FROM {CHANGED} a FULL JOIN orders b ON a.o_orderkey = b.o_orderkey)")
def cmp_row_diff_counts(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return cmp.diff_counts(cmp.cell_masks(_changed(o), o, ["o_orderkey"]), ["o_orderkey"])


@query(f"SELECT CAST((SELECT COUNT(*) FROM {CHANGED}) AS BIGINT) AS n_actual, CAST((SELECT COUNT(*) FROM orders) AS BIGINT) AS n_expected, CAST(SUM({' + '.join(f'{c}::INT' for c in FIELDS)}) AS BIGINT) AS n_values, CAST(COUNT(*) FILTER ({' OR '.join(FIELDS)}) AS BIGINT) AS n_rows FROM (SELECT {MASKS} FROM {CHANGED} a JOIN orders b ON a.o_orderkey = b.o_orderkey)")
def cmp_summary(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    d = cmp.compare(_changed(o), o, key="o_orderkey")
    return spark.createDataFrame([(d.n_actual, d.n_expected, d.n_values, d.n_rows)], "n_actual long, n_expected long, n_values long, n_rows long")


@query("SELECT 'missing' AS kind, 'o_custkey' AS field UNION ALL SELECT 'extra', 'extra_col' UNION ALL SELECT 'type', 'o_totalprice'")
def cmp_schema_missing_extra(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    d = cmp.schema_diff(o.drop("o_custkey").withColumn("extra_col", F.lit(1)).withColumn("o_totalprice", F.col("o_totalprice").cast("string")), o)
    return spark.createDataFrame([("missing", c) for c in d.missing] + [("extra", c) for c in d.extra] + [("type", c) for c in d.types], "kind string, field string")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_parse_iso(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"))
    return o.select("o_orderkey", F.date_format(parsed(F.col("text"), infer_date_format(o, "text")), "yyyy-MM-dd").alias("day"))


@query("SELECT CASE WHEN MAX(day(o_orderdate)) > 12 THEN 'd/M/yyyy' END AS pattern FROM orders")
def date_infer_format(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("text"))
    return spark.createDataFrame([(infer_date_format(o, "text"),)], "pattern string")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, l_tax FROM lineitem")
def upgrade_integral(spark, sf_dir):
    return upgrade_integral_floats(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"))


def _summary(spark, d):
    return spark.createDataFrame([(d.n_actual, d.n_expected, d.n_values, d.n_rows)], "n_actual long, n_expected long, n_values long, n_rows long")


PRICE_CHANGED = "COUNT(*) FILTER (o_orderkey % 10 = 3)"


@query(f"SELECT CAST(COUNT(*) AS BIGINT) AS n_actual, CAST(COUNT(*) AS BIGINT) AS n_expected, CAST({PRICE_CHANGED} AS BIGINT) AS n_values, CAST({PRICE_CHANGED} AS BIGINT) AS n_rows FROM orders")
def cmp_sorted(spark, sf_dir):
    """By position after a sort, of tables whose rows lie in different partitions."""
    o = _t(spark, sf_dir, "orders")
    changed = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 3, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice")))
    return _summary(spark, cmp.compare(changed.repartition(5, "o_custkey"), o, sortby=["o_orderkey"]))


@query("SELECT CAST(COUNT(*) AS BIGINT) AS n_actual, CAST(COUNT(*) AS BIGINT) AS n_expected, CAST(COUNT(*) FILTER (round_even(o_totalprice * 1.00001, 1) <> round_even(o_totalprice, 1)) AS BIGINT) AS n_values, CAST(COUNT(*) FILTER (round_even(o_totalprice * 1.00001, 1) <> round_even(o_totalprice, 1)) AS BIGINT) AS n_rows FROM orders")
def cmp_rounded(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return _summary(spark, cmp.compare(o.withColumn("o_totalprice", F.col("o_totalprice") * 1.00001), o, key="o_orderkey", precision=1))


@query(f"SELECT CAST(COUNT(*) AS BIGINT) AS n_actual, CAST(COUNT(*) AS BIGINT) AS n_expected, CAST({PRICE_CHANGED} AS BIGINT) AS n_values, CAST({PRICE_CHANGED} AS BIGINT) AS n_rows FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 50 <> 7")
def cmp_filtered(spark, sf_dir):
    """Both sides filtered, and one column left out."""
    o = _t(spark, sf_dir, "orders").filter("o_orderkey % 50 <> 7")
    return _summary(spark, cmp.compare(_changed(o).drop("o_orderstatus").join(o.select("o_orderkey", "o_orderstatus"), "o_orderkey"), o, key="o_orderkey", condition=F.col("o_orderstatus") == "F", check_order=False, check_data=cmp.all_fields_except(["o_orderpriority"])))


@query("SELECT CAST(COUNT(*) AS BIGINT) AS n_actual, CAST(COUNT(*) AS BIGINT) AS n_expected, CAST(COUNT(*) FILTER (l_linenumber = 2) AS BIGINT) AS n_values, CAST(COUNT(*) FILTER (l_linenumber = 2) AS BIGINT) AS n_rows FROM lineitem")
def cmp_repeated_keys(spark, sf_dir):
    """Rows that share a key are matched in the order of their other columns."""
    x = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax")
    return _summary(spark, cmp.compare(x.withColumn("l_tax", F.when(F.col("l_linenumber") == 2, F.col("l_tax") + 1).otherwise(F.col("l_tax"))), x, key="l_orderkey"))


@query("SELECT 'actual' AS side, 'o_orderkey,o_orderstatus,o_custkey' AS fields UNION ALL SELECT 'expected', 'o_orderkey,o_custkey,o_orderstatus'")
def cmp_column_order(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    d = cmp.schema_diff(o.select("o_orderkey", "o_orderstatus", "o_custkey"), o.select("o_orderkey", "o_custkey", "o_orderstatus"))
    return spark.createDataFrame([("actual", ",".join(d.order[0])), ("expected", ",".join(d.order[1]))], "side string, fields string")


@query("SELECT p_brand AS value, CAST(COUNT(*) AS BIGINT) AS n FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3][0-9]$') GROUP BY 1")
def verify_rex_violations(spark, sf_dir):
    return violating_values(_t(spark, sf_dir, "part"), "p_brand", ("rex", ["^Brand#[1-3][0-9]$"]))


@query(f"SELECT event_type AS value, CAST(COUNT(*) AS BIGINT) AS n FROM {EVENTS} WHERE event_type NOT IN ('view', 'purchase') GROUP BY 1")
def verify_allowed_violations(spark, sf_dir):
    return violating_values(_events(spark, sf_dir), "event_type", ("allowed_values", ["view", "purchase"]))


@query("SELECT 'o_open' AS field, CAST(COUNT(*) FILTER (lower(o_open) NOT IN ('true', 'false')) > 0 AS BIGINT) AS failures, CAST(COUNT(*) FILTER (lower(o_open) NOT IN ('true', 'false')) = 0 AS BIGINT) AS passes, COUNT(*) FILTER (lower(o_open) NOT IN ('true', 'false')) = 0 AS type FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'True' WHEN 'F' THEN 'false' END AS o_open FROM orders)")
def verify_type_bool_text(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "O", "True").when(F.col("o_orderstatus") == "F", "false")
    return _verified(spark, _t(spark, sf_dir, "orders").select(text.alias("o_open")), {"o_open": {"type": "bool"}})


@query("SELECT 'big' AS field, MIN(CAST(o_totalprice > 200000 AS INT)) = 1 AS min, MAX(CAST(o_totalprice > 200000 AS INT)) = 1 AS max FROM orders")
def stat_min_max_bool(spark, sf_dir):
    return long_form(_t(spark, sf_dir, "orders").select((F.col("o_totalprice") > 200000).alias("big")), {"min": "boolean", "max": "boolean"})


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, '\"{k}\"' AS value" for f, k in (("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"), ("o_totalprice", "real"), ("o_orderdate", "date"), ("o_orderpriority", "string"))))
def discover_type(spark, sf_dir):
    return discover_df(_t(spark, sf_dir, "orders"), kinds=("type",)).to_df(spark).select("field", "value")


@query(f"""SELECT 'p_brand' AS field, '["^Brand\\\\#' || {_width("MIN(LENGTH(p_brand)) - 6", "MAX(LENGTH(p_brand)) - 6", "[0-9]")} || '$"]' AS value FROM part""")
def discover_rex(spark, sf_dir):
    return discover_df(_t(spark, sf_dir, "part").select("p_brand"), inc_rex=True, kinds=("rex",)).to_df(spark).select("field", "value")


@query("SELECT CAST(n AS BIGINT) AS n_row, o_orderkey, CAST(1 AS BIGINT) AS n_failures FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE o_totalprice < 50000")
def detect_numbered(spark, sf_dir):
    """Row numbers of a table that a sort has shuffled."""
    found = detect_df(_t(spark, sf_dir, "orders").orderBy("o_orderkey"), {"fields": {"o_totalprice": {"min": 50000}}}, output_fields=["o_orderkey"], row_number="n_row")
    return found.detected()


@query("SELECT c_custkey, false AS c_name_type_ok, c_acctbal >= 0 AS c_acctbal_min_ok, CAST(1 + (c_acctbal < 0)::INT AS BIGINT) AS n_failures FROM customer")
def detect_type(spark, sf_dir):
    return _detected(_t(spark, sf_dir, "customer"), {"c_name": {"type": "int"}, "c_acctbal": {"min": 0.0}}, "c_custkey")


@query("SELECT *, c_acctbal >= 0 AS c_acctbal_min_ok, CAST((c_acctbal < 0)::INT AS BIGINT) AS n_failures FROM customer")
def detect_in_place(spark, sf_dir):
    return detect_df(_t(spark, sf_dir, "customer"), {"fields": {"c_acctbal": {"min": 0.0}}}, in_place=True).detected()


def _as_text(spark, df: DataFrame, kind: str = "csv", **options) -> str:
    """Path of a delimited copy of ``df`` in the shared folder."""
    path = f"{new_place(spark)}.{kind}"
    df.write.csv(path, header=True, **{"quote": '"', "escape": '"', "emptyValue": "", **options})
    return path


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 0 AS good FROM customer")
def load_csv_typed(spark, sf_dir):
    """Types that the values of a delimited file fit."""
    return load(spark, _as_text(spark, _t(spark, sf_dir, "customer").withColumn("good", F.col("c_acctbal") > 0)))


@query("SELECT page_id, html FROM pages WHERE html <> ''")
def load_csv_quoted(spark, sf_dir):
    """Fields with quotes, separators and line breaks."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "html").filter("html <> ''")
    return read_text_table(spark, _as_text(spark, pages), escape='"', nulls=()).select(F.col("page_id").cast("long").alias("page_id"), "html")


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_totalprice AS price FROM orders")
def load_csvw(spark, sf_dir):
    """Columns typed and renamed by metadata."""
    from ..sources.csvw import parse

    said = {"@context": "http://www.w3.org/ns/csvw", "url": "t.psv", "dialect": {"delimiter": "|"}, "tableSchema": {"columns": [{"name": "id", "titles": "o_orderkey", "datatype": "integer"}, {"name": "day", "datatype": {"base": "date", "format": "dd/MM/yyyy"}}, {"name": "status", "null": "P"}, {"name": "price", "datatype": "double"}]}}
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return read_csv_with_metadata(spark, _as_text(spark, o, "psv", sep="|"), parse(said))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS euro, strftime(o_orderdate, '%d/%m') AS none FROM orders")
def date_convert_columns(spark, sf_dir):
    """Two columns of dates in different forms, and one that is none."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", *(F.date_format("o_orderdate", p).alias(n) for n, p in (("iso", "yyyy-MM-dd"), ("euro", "dd.MM.yyyy"), ("none", "dd/MM"))))
    return convert_dates(o)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(l AS VARCHAR) AS l, o_open FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS l, CAST(o_orderkey % 2 AS INT) = 1 AS o_open FROM orders)")
def repair_types(spark, sf_dir):
    """Columns cast to what constraints say."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("decimal(20,1)").alias("l"), (F.col("o_orderkey") % 2).cast("int").alias("o_open"))
    return repaired(o, DatasetConstraints.from_dict({"fields": {"o_orderkey": {"type": "string"}, "l": {"type": "string"}, "o_open": {"type": "bool"}}}))


@query("SELECT CAST(l AS BIGINT) AS line, a AS actual, b AS expected FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS l, c_name AS b, CASE WHEN c_custkey % 7 = 2 THEN 'x' || c_name ELSE c_name END AS a FROM customer) WHERE a <> b")
def text_huge_diff(spark, sf_dir):
    """Lines that differ in two texts, as tables."""
    c = _t(spark, sf_dir, "customer")
    paths = []
    for text in (F.when(F.col("c_custkey") % 7 == 2, F.concat(F.lit("x"), "c_name")).otherwise(F.col("c_name")), F.col("c_name")):
        paths.append(new_place(spark))
        c.orderBy("c_custkey").select(text.alias("value")).write.text(paths[-1])
    return compare_huge(spark, *paths)


#: What the flagship query verifies, one constraint of each kind.
FLAGSHIP = {
    "l_orderkey": {"type": "int", "min": 0, "sign": "non-negative", "max_nulls": 0}, "l_linenumber": {"type": "int", "min": 1, "max": 7, "sign": "positive"},
    "l_quantity": {"type": "real", "min": 1.0, "max": 50.0}, "l_discount": {"type": "real", "min": 0.0, "max": 0.1}, "l_returnflag": {"type": "string", "min_length": 1, "max_length": 1, "allowed_values": ["A", "N", "R"], "rex": ["^[ANR]$"]},
    "l_shipdate": {"type": "date", "max_nulls": 0},
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification of lineitem as a table."""
    return _verified(spark, _t(spark, sf_dir, "lineitem"), FLAGSHIP)


__all__ = ["QUERIES", "SQL", "col", "flagship"]
