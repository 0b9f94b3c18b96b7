"""Queries over the tables of a folder, each with its operator's production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, language_id, lexical, line_quality, minmax_dedup, order_minhash, packing, secret_scan, sentence_dedup, spelling, token_files, warc, windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id_crc32() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"), secret_scan.joined("spans").alias("spans"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontamination.scan_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.measures(scanned).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), _id_crc32() % 4 == 2)


def op8_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_removed", "removed_spans", "first_docs", "text")


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = line_quality.fit(docs, _table(spark, sf_dir, "labels"), line_quality.learnable())
    held_out = F.coalesce(_id_crc32() % 5 == 0, F.lit(False))
    return line_quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_digests(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), rewrite=spelling.drop_one(31))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_secret_scan, op3_order_minhash, op4_warc_chunks, op5_decontamination, op6_token_files, op7_language_id,
        op8_sentence_dedup, op9_line_quality, op10_minmax_dedup, op11_ranked_search, op12_window_packing, op13_spelling_variants,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op4_warc_chunks": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS last_id FROM p
)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(s, 1 + 5 * CAST(i // 4 AS INTEGER), 5))::BIGINT >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM d
""",
    "op5_decontamination": f"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM wins
), grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, grams.n, item_id FROM grams JOIN wins ON grams.g = wins.g AND grams.n = wins.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_minmax_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), r(doc_id, node) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.node = e.x
)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.node) AS component_id, min(r.node) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id
""",
    "op11_ranked_search": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark
), c AS (
  SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0
), m AS (
  SELECT doc_id, w, 50 + (50 * len(w)::BIGINT * big_n) // big_l AS m FROM d, c WHERE len(w) > 0
), tf AS (
  SELECT doc_id, m, t, count(*) AS tf FROM (SELECT doc_id, m, unnest(w) AS t FROM m) WHERE t IN (SELECT t FROM b) GROUP BY ALL
), df AS (
  SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS wt FROM tf, c GROUP BY t, big_n
), s AS (
  SELECT item_id, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM b JOIN tf USING (t) JOIN df USING (t) GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
""",
    "op13_spelling_variants": f"""
WITH RECURSIVE bit(i, c, k) AS (
  SELECT i, i, 0 FROM range(0, 256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8
), crc AS (
  SELECT list(c::BIGINT ORDER BY i) AS tab FROM bit WHERE k = 8
), runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS run FROM documents) GROUP BY ALL
), bytes AS (
  SELECT run, k, list_transform(regexp_extract_all(coalesce(doc_id::VARCHAR, '') || ':' || run, '.'), lambda x: unicode(x)::BIGINT) AS u FROM runs
), flat AS (
  SELECT run, k, flatten(list_transform(u, lambda x: CASE WHEN x < 128 THEN [x] ELSE [195, x - 64] END)) AS u FROM bytes
), h AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, u), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM flat, crc
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k FROM h
), n AS (
  SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), gaps AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS g FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM n)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN n b ON a.g = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN n b ON a.g = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS top, max(near_n) AS top_n FROM near GROUP BY word
), f AS (
  SELECT n.word, n.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= 10 * n.n THEN top END AS form, CASE WHEN top_n >= 10 * n.n THEN top_n END AS form_n
  FROM n LEFT JOIN best USING (word)
), up(word, now) AS (
  SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.now WHERE f.form IS NOT NULL
), root AS (
  SELECT up.word, up.now AS root FROM up JOIN f ON f.word = up.now WHERE f.form IS NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
""",
}
