"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.tables import shared_folder
from . import audit, bpe, decontam, langid, minhash, packing, quality, suffixes, tokenfile, toxicity, trie, vectors, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), path, _vocabulary())
    return tokenfile.digests(tokenfile.read_tokens(spark, path))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), _vocabulary(), with_ids=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontam.contamination(docs, items).drop("items", "spans")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = _table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    warc.write_index(warc.read_archives(spark, path), path)
    records = warc.indexed_records(spark, path, pages)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(_table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]))
    END AS g FROM w
), s AS (SELECT doc_id, unnest(g) AS x FROM g),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM g),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY 1, 2
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS root FROM n
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id
)
SELECT n.doc_id, n.n AS n_shingles, c.root AS component_id, n.doc_id = c.root AS kept
FROM n JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) c ON c.id = n.doc_id
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2),
    lambda p: array_to_string(w[p : p + least(len(w), 13) - 1], ' '))) AS x
  FROM i WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p,
    unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p : p + n - 1], ' '))) AS x
  FROM d, sizes WHERE len(w) >= n
),
hits AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (n, x)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {s}) & 31) + 1, 1)"
    for k in range(8)
    for s in (15, 10, 5, 0)
)
OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html
"""

OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (
  SELECT vec_id AS id, vec_id AS root FROM v
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.root AS component_id, v.vec_id = c.root AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) c ON c.id = v.vec_id
"""

OP10_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM d WHERE n >= 100)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w),
s AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, -1) AS fresh FROM f WHERE r > 1),
g AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN y IS NULL THEN substr(h, 2 * x + 1) ELSE substr(h, 2 * x + 1, 2 * (y - x)) END, '' ORDER BY x) AS k
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
),
sums AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS m, good, toxic
  FROM d LEFT JOIN l USING (doc_id)
),
g AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL
),
x AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
o AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS p FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
s AS (
  SELECT array_to_string(list_transform(p, lambda k: substr('ABCDE', k + 1, 1)), '') AS filter_order, step::INT AS step,
    1 << p[step] AS bit, coalesce(list_sum(list_transform(p[1 : step - 1], lambda k: 1 << k)), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE m & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE m & before = 0 AND m & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE m & before <> 0 AND m & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE m = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE m & before = 0 AND m & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE m & before = 0 AND m & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM g, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""

OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos, id, words FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)
),
convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 4 AS h
  FROM turns, crc
),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, pos, id, words FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, id, words FROM turns JOIN convs USING (conv_id) WHERE pos > h
),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, id, words FROM rebuilt),
keys AS (SELECT conv_id, string_agg(id, '' ORDER BY d) AS k FROM numbered GROUP BY 1),
whole AS (SELECT conv_id, coalesce(k, '') AS k, length(coalesce(k, '')) // 64 AS n FROM convs LEFT JOIN keys USING (conv_id)),
members AS (
  SELECT conv_id, d, substr(k, 1, 64 * d) AS p, d = n AS ends FROM (SELECT *, unnest(range(n + 1)) AS d FROM whole)
),
nodes AS (
  SELECT d, p, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(min(words), 0) AS saved,
    coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE ends), '') AS ids
  FROM members m LEFT JOIN numbered USING (conv_id, d) GROUP BY d, p
),
kids AS (SELECT substr(p, 1, 64 * (d - 1)) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
up AS (
  SELECT substr(p, 1, 64 * a) AS p, sum(saved) AS saved, count(*) FILTER (WHERE n IS NULL) AS leaves
  FROM (SELECT nodes.p, saved, kids.n, unnest(range(d + 1)) AS a FROM nodes LEFT JOIN kids ON kids.p = nodes.p) GROUP BY 1
)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  up.leaves AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(x.ids) AS ends_sha256
FROM nodes x JOIN up ON up.p = x.p LEFT JOIN kids ON kids.p = x.p
LEFT JOIN nodes y ON x.d > 0 AND y.d = x.d - 1 AND y.p = substr(x.p, 1, 64 * y.d)
"""

QUERIES: dict[str, Query] = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_token_output": op2_token_output,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_bpe": op5_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_vector_near_dedup": op9_vector_near_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_trie": op13_conversation_trie,
}
SQL: dict[str, str] = {
    "op1_minhash_forest": OP1_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op9_vector_near_dedup": OP9_SQL,
    "op10_suffix_dedup": OP10_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_conversation_trie": OP13_SQL,
}
