"""The operators' queries over the shared tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chunk_bpe, clusters, katz, langid, media, near_duplicates, packing, resampling, suffix_dedup, token_counts, topk, url_filter, warc
from siltstone.llm.tables import crc32_mod, documents, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir), crc32_mod("doc_id", 10) != 0)[0]


def op2_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.digest(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, crc32_mod("doc_id", 4) != 2)
    held = docs.select("doc_id", "text", (crc32_mod("doc_id", 4) == 2).alias("held_out"))
    return langid.predict(held, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir), k=4, num=85, den=100)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(documents(spark, sf_dir)))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: action and `host/path` of the rules
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filtered(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": OP8_SQL, "op11_centroid_clustering": OP11_SQL, "op12_target_resampling": OP12_SQL}


OP8_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
             sha1(coalesce(html, '')) AS payload_digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept
      FROM pages)
"""

#: Rounds are chained steps; integer products stand exactly in doubles, as no component passes 2**20 here.
OP11_SQL = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, sha256('1:' || vec_id) AS h, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v FROM kept ORDER BY h NULLS LAST, v LIMIT 16)"""
    + "".join(
        f""",
a{n} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v), cluster := c.cluster)) AS near
  FROM kept k, c{n} c GROUP BY r),
c{n + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT cluster, list(mean ORDER BY i) AS v FROM (
      SELECT near.cluster AS cluster, i, CAST(floor(sum(v[i]) / count(*)) AS DOUBLE) AS mean
      FROM kept JOIN a{n} USING (r), range(1, 65) t(i) GROUP BY ALL) GROUP BY cluster) m USING (cluster))"""
        for n in range(4)
    )
    + """
SELECT vec_id, near.cluster AS cluster, CAST(near.d AS BIGINT) AS distance,
       CAST(sum(near.d) OVER (PARTITION BY near.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM kept JOIN a3 USING (r) JOIN c3 c ON c.cluster = near.cluster
"""
)

#: CRC-32 goes over the bytes of all distinct features, one position a step; its table comes from the polynomial.
OP12_SQL = """
WITH RECURSIVE poly AS (
  SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS v, 0 AS step FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM poly WHERE step < 8),
crc AS MATERIALIZED (SELECT b, v FROM poly WHERE step = 8),
texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, * FROM (
    SELECT doc_id, text, TRUE AS own FROM documents UNION ALL SELECT NULL, text, FALSE FROM benchmark)),
words AS MATERIALIZED (
  SELECT r, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts),
runs AS MATERIALIZED (
  SELECT r, own, f, count(*) AS n FROM (
    SELECT r, own, unnest(w) AS f FROM words UNION ALL
    SELECT r, own, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words) GROUP BY ALL),
distinct_f AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM runs),
steps AS (
  SELECT f, h, CAST(1 AS BIGINT) AS pos, CAST(4294967295 AS BIGINT) AS reg FROM distinct_f
  UNION ALL
  SELECT f, h, pos + 2, xor(crc.v, reg >> 8) FROM steps JOIN crc ON crc.b = xor(reg, CAST('0x' || substr(h, pos, 2) AS BIGINT)) & 255 WHERE pos < length(h)),
bucketed AS MATERIALIZED (SELECT f, xor(reg, 4294967295) % 10000 AS bucket FROM steps WHERE pos > length(h)),
counts AS MATERIALIZED (SELECT r, own, bucket, sum(n) AS n FROM runs JOIN bucketed USING (f) GROUP BY ALL),
whole AS MATERIALIZED (SELECT CAST(coalesce(sum(n) FILTER (own), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (NOT own), 0) AS DOUBLE) AS t FROM counts),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((b.t + 1) * (w.s + 10000) / ((b.s + 1) * (w.t + 10000)))) AS gain
  FROM (SELECT bucket, CAST(coalesce(sum(n) FILTER (own), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (NOT own), 0) AS DOUBLE) AS t FROM counts GROUP BY bucket) b, whole w),
weights AS (SELECT r, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM counts JOIN gains USING (bucket) WHERE own GROUP BY r),
scored AS MATERIALIZED (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (r) WHERE own),
ranked AS (
  SELECT *, n_words >= 20 AND doc_id IS NOT NULL AS may, row_number() OVER (PARTITION BY n_words >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_words >= 20 AND doc_id IS NOT NULL) OVER () AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 25 * many // 100 THEN place END AS rank FROM ranked
"""
