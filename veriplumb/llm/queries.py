"""The corpus operators' queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, media, mixing, neardup, packing, quality, sharding, urlfilter, vecdup, warc
from .shared import table

SHARDS, SLOTS = [f"shard-{i:03d}" for i in range(64)], 6553
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def tokenizer_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files())


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.to_media(table(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES, labels)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = langid.identify(docs, langid.fit(docs.filter(~langid.held_out())))
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    return quality.judge(table(spark, sf_dir, "documents"), labels)


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_media, op3_sharding, op4_mixing, op5_minhash, op6_url_filter, op7_warc, op8_language, op9_quality, op10_vectors)
}

WORD = r"[^\x20\x09-\x0D]+"
_OWNERS = sharding.fill(SHARDS, SLOTS).tolist()

#: The table's owners as a list, one base-64 digit (0-9, A-Z, a-z, two more) a slot.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"

SHARD_SQL = f"""
SELECT doc_id, slot, 'shard-' || lpad(CAST(strpos('{_DIGITS}', substr('{"".join(_DIGITS[o] for o in _OWNERS)}', slot + 1, 1)) - 1 AS VARCHAR), 3, '0') AS shard
FROM (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '{sharding.NULL_KEY}')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
"""

MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS stop, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (1.5::DOUBLE * total - coalesce(sum(stop) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level > stop / weight THEN stop ELSE least(stop, weight * max(level) FILTER (level <= stop / weight) OVER ()) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
x AS (SELECT *, CAST(round_even(target - whole * source_size, 0) AS BIGINT) AS extra FROM e)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, extra - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw % {mixing.RUNS}, draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
sh AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
f AS (SELECT s, count(*) AS df FROM sh GROUP BY s),
p AS MATERIALIZED (SELECT doc_id, s, n FROM (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS r FROM sh JOIN f USING (s) JOIN n USING (doc_id)) WHERE r <= n - (4 * n + 4) // 5 + 1),
c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b USING (s) WHERE a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
i AS (SELECT a, b, na, nb, count(*) AS k FROM c JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND x.s = y.s GROUP BY ALL),
l AS MATERIALIZED (SELECT a AS u, b AS v FROM i WHERE 100 * k >= 80 * (na + nb - k) UNION ALL SELECT b, a FROM i WHERE 100 * k >= 80 * (na + nb - k)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, l.v FROM r JOIN l ON l.u = r.c),
m AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, documents.doc_id = m.component_id AS kept
FROM documents JOIN m ON m.d = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""


def _rule_sql(part: int) -> str:
    best = "NULL"
    for verdict, text in sorted(URL_RULES, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        best = f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{(text, verdict)[part]}' ELSE {best} END"
    return best


URL_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS said,
  list_filter(list_reverse(string_split(host, '.')), lambda x: x <> '') AS hs, list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda x: x <> '') AS ps FROM b),
t AS MATERIALIZED (SELECT page_id, host, path, rule, said, list_distinct(list_concat(list_transform(range(1, len(hs) + 1), lambda i: 'h' || (i - 1) || '=' || hs[i]),
  list_transform(ps, lambda x: 'p=' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' || length(x) ELSE x END))) AS tokens FROM c),
g AS (SELECT doc_id, max(quality = 0) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS MATERIALIZED (SELECT tokens, coalesce(said = 'block', bad) AS bad FROM t LEFT JOIN g ON g.doc_id = t.page_id WHERE coalesce(said = 'block', bad) IS NOT NULL),
u AS (SELECT row_number() OVER () AS k, bad, unnest(tokens) AS x FROM k),
combos AS (SELECT [x] AS need, bad FROM u UNION ALL SELECT [p.x, q.x], p.bad FROM u p JOIN u q ON p.k = q.k AND p.x < q.x UNION ALL SELECT [p.x, q.x, r.x], p.bad FROM u p JOIN u q ON p.k = q.k AND p.x < q.x JOIN u r ON r.k = q.k AND q.x < r.x),
rules AS MATERIALIZED (SELECT need FROM combos GROUP BY need HAVING count(*) FILTER (bad) >= ceil(0.01 * (SELECT count(*) FROM k)) AND count(*) FILTER (bad) >= 0.8 * count(*))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN EXISTS (SELECT 1 FROM rules WHERE list_has_all(t.tokens, rules.need)) THEN 'block' ELSE 'allow' END) AS verdict FROM t
"""

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i // 8 * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

VECTOR_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
r AS (SELECT vec_id AS d, vec_id AS c FROM embeddings UNION SELECT r.d, l.v FROM r JOIN l ON l.u = r.c),
m AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.u = vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON m.d = vec_id
"""

#: Packing, PNG, suffix automata and the fitted classifier are not for SQL; their tests have brute force or round trips.
ORACLE_SQL: dict[str, str] = {"op3_sharding": SHARD_SQL, "op4_mixing": MIX_SQL, "op5_minhash": NEAR_SQL, "op6_url_filter": URL_SQL, "op7_warc": WARC_SQL, "op10_vectors": VECTOR_SQL}
