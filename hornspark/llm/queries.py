"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hornspark.llm import audit, bpe, containment, flac, html, html_training, langid, merkle, pii, secrets, sharding, simhash, token_counts, url_rules
from hornspark.plans.rules import local_frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.train())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train())


#: Bytes of text in a shard of op4.
SHARD_BYTES = 1 << 20


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h, coalesce(strlen(text), 0) AS n_bytes
  FROM documents
), bucket AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS bytes, count(*) AS n, count(DISTINCT h) = 1 AS one_key
  FROM sized, range(0, 60) AS u(depth) GROUP BY ALL
), leaf AS (
  SELECT doc_id, n_bytes, min(depth) AS depth
  FROM sized, range(0, 60) AS u(depth) JOIN bucket b USING (depth)
  WHERE b.prefix = h >> (60 - depth) AND (bytes <= {SHARD_BYTES} OR one_key) GROUP BY ALL
)
SELECT doc_id, leaf.n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 60, '0'), CAST(depth AS INTEGER)) END AS shard,
  CAST(0 AS BIGINT) AS page, CAST(bytes AS BIGINT) AS shard_bytes, n AS shard_rows
FROM leaf JOIN sized USING (doc_id) JOIN bucket USING (depth) WHERE prefix = h >> (60 - depth)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(table(spark, sf_dir, "documents"))


def op7_contained_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = """
WITH item AS (
  SELECT item_id, w, least(5, len(w)) AS m
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark)
  WHERE len(w) > 0
), item_shingle AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM item, unnest(range(1, len(w) - m + 2)) AS u(i)
), item_size AS (
  SELECT item_id, count(*) AS n FROM item_shingle GROUP BY item_id
), doc AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
), size AS (
  SELECT DISTINCT m FROM item
), doc_shingle AS (
  SELECT DISTINCT doc_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM doc, size, unnest(range(1, len(w) - m + 2)) AS u(i)
)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM doc_shingle JOIN item_shingle USING (m, s) JOIN item_size USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)
"""


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2)
    return found.select("doc_id", "fingerprint", "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), html_training.train())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), numbered AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc32
  FROM documents, crc
), field AS (
  SELECT doc_id, source, crc32, concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head, text FROM numbered
), doc AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      CASE WHEN crc32 % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS forged FROM field)
), tree AS (
  SELECT source, 0 AS level, pos AS idx, leaf AS digest, n FROM doc
  UNION ALL SELECT source, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM tree WHERE n > 1 GROUP BY source, level, idx // 16, n
), subroot AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, pos AS idx, digest, n FROM subroot
  UNION ALL SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY level, idx // 16, n
), side AS (
  SELECT false AS over, source, level, idx, digest FROM tree WHERE n > 1 UNION ALL SELECT true, NULL, level, idx, digest FROM top WHERE n > 1
), sibling AS (
  SELECT over, source, level, idx, coalesce(string_agg(digest, '') OVER (PARTITION BY over, source, level, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY over, source, level, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM side
), step AS (
  SELECT d.source, d.pos, s.over, s.level, s.l, s.r FROM doc d JOIN sibling s ON NOT s.over AND s.source IS NOT DISTINCT FROM d.source AND s.idx = d.pos // CAST(pow(16, s.level) AS BIGINT)
  UNION ALL SELECT d.source, d.pos, s.over, s.level, s.l, s.r FROM doc d JOIN subroot u ON u.source IS NOT DISTINCT FROM d.source JOIN sibling s ON s.over AND s.idx = u.pos // CAST(pow(16, s.level) AS BIGINT)
), path AS (
  SELECT source, pos, string_agg(l || r, '' ORDER BY over, level) AS proof, list({'l': l, 'd': '', 'r': r} ORDER BY over, level) AS steps FROM step GROUP BY source, pos
), folded AS (
  SELECT d.*, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend({'l': '', 'd': coalesce(forged, leaf), 'r': ''}, coalesce(steps, [])), lambda a, x: {'l': '', 'd': sha256(x.l || a.d || x.r), 'r': ''}).d AS folded_root
  FROM doc d LEFT JOIN path p ON p.source IS NOT DISTINCT FROM d.source AND p.pos = d.pos
)
SELECT f.doc_id, f.source, leaf, u.digest AS subroot, t.digest AS root, proof_sha256, folded_root, folded_root = t.digest AS verified
FROM folded f JOIN subroot u ON u.source IS NOT DISTINCT FROM f.source, (SELECT digest FROM top WHERE n = 1) t
"""


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH doc AS (
  SELECT coalesce(source, '') AS part, doc_id, t, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM (SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents) LEFT JOIN labels USING (doc_id)
), masked AS (
  SELECT part, good, toxic, (n_words < 50)::INT + 2 * (100 * n_distinct < 65 * n_words)::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM doc
), cell AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masked GROUP BY part, mask
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), perm AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), stepped AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS f, 1 << (strpos('ABCDE', substr(filter_order, s, 1)) - 1) AS bit,
    coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (strpos('ABCDE', substr(filter_order, i, 1)) - 1))), 0)::BIGINT AS before
  FROM perm, range(1, 6) r(s)
), counted AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed, sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
  FROM cell, stepped GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM counted
"""


#: The rules of op13: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), local_frame(spark, URL_RULES, "host string, path string, verdict string"))


OP13_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r, row_number() OVER () AS n FROM pages
), part AS (
  SELECT n, page_id, regexp_extract(r, '^[^/?#]*') AS raw, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM rest
), rule(h, p, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}), best AS (
  SELECT n, max({{'size': length(h) + length(p), 'host_size': length(h), 'rule': h || p, 'verdict': verdict}}) AS found FROM part JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, 'allow') AS verdict FROM part LEFT JOIN best USING (n)
"""


QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_personal_data": op2_personal_data,
    "op3_secrets": op3_secrets,
    "op4_extendible_shards": op4_extendible_shards,
    "op5_language_id": op5_language_id,
    "op6_flac_media": op6_flac_media,
    "op7_contained_benchmark_items": op7_contained_benchmark_items,
    "op8_simhash_near_duplicates": op8_simhash_near_duplicates,
    "op9_token_counts": op9_token_counts,
    "op10_main_text": op10_main_text,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_url_rules": op13_url_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op4_extendible_shards": OP4_SQL,
    "op7_contained_benchmark_items": OP7_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_filter_interactions": OP12_SQL,
    "op13_url_rules": OP13_SQL,
}
