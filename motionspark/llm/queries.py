"""The opN queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionspark.llm import cotraining, decontamination, fertility, hard_negatives, line_dedup, mixing, secret_scan, secret_scan_sql, sharding, shared, spelling, token_store, toxicity, warc
from motionspark.llm.jaccard_join import ngram_jaccard_join


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["rank"] < secret_scan.KINDS.index(secret_scan.CLASSES[0].kind))
    return scanned.select(
        "doc_id",
        *(secret_scan.count_kind(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(spans).alias("spans"),
    )


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared.shared_dir(spark)}/motionspark/tokens-{uuid.uuid4().hex}"
    token_store.write_token_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.document_digests(token_store.open_token_store(spark, path))


def op4_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotraining.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "score", (F.col("score") >= cotraining.KEPT_FROM).alias("kept"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    predicted = F.when(F.col("score") >= toxicity.TOXIC_FROM, 1).otherwise(0)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op7_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.shard_rows(narrow, shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), mixing.TARGET_WEIGHTS, block=16)
    return mixed.select("doc_id", "source", "block", "block_slot", "mix_position")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    judged = fertility.quality_rules(
        _table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("piece_bpe_32k.model")
    )
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *base, *(F.round(c, 6).alias(c) for c in fertility.MEASURES))


def op11_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared.shared_dir(spark)}/motionspark/warc-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.page_records(warc.read_archives(spark, path))


def op12_summa_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(_table(spark, sf_dir, "documents").select("doc_id", "text"), thinned=97)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_store": op3_token_store,
    "op4_cotraining_quality": op4_cotraining_quality,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_toxicity": op6_toxicity,
    "op7_hypergeometric_sharding": op7_hypergeometric_sharding,
    "op8_pfair_mixing": op8_pfair_mixing,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_fertility_rules": op10_fertility_rules,
    "op11_warc_segments": op11_warc_segments,
    "op12_summa_hard_negatives": op12_summa_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS s FROM d),
b AS (SELECT * FROM l WHERE trim(s, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
f AS MATERIALIZED (SELECT s, min({'d': doc_id, 'i': i}) AS p, length(s) AS n FROM b GROUP BY s),
v AS MATERIALIZED (SELECT s, p, n, k, substr(s, 1, k) || substr(s, k + 2) AS v FROM (SELECT s, p, n, unnest(range(n)) AS k FROM f WHERE n >= 20)),
near AS (SELECT s FROM (SELECT s, p, min(p) OVER (PARTITION BY v, k) AS q FROM v) WHERE q < p
  UNION SELECT v.s FROM v JOIN f ON v.v = f.s WHERE f.n >= 20 AND f.p < v.p
  UNION SELECT f.s FROM v JOIN f ON v.v = f.s WHERE f.n >= 20 AND v.p < f.p),
m AS (SELECT b.doc_id, b.i, near.s IS NOT NULL AS near, f.p <> {'d': b.doc_id, 'i': b.i} AS again
  FROM b JOIN f ON b.s = f.s LEFT JOIN near ON near.s = b.s),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again AND NOT near) AS n_exact, count(*) FILTER (near) AS n_near FROM m GROUP BY 1),
t AS (SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.i) FILTER (NOT coalesce(m.near OR m.again, false)) AS text FROM l LEFT JOIN m ON m.doc_id = l.doc_id AND m.i = l.i GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_exact, 0) AS n_exact, coalesce(c.n_near, 0) AS n_near
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
""",
    "op2_secret_scan": secret_scan_sql.oracle(),
    "op5_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT u, v FROM c JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * i >= 90 * (p.n + q.n - i)),
g AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT g.v, r.c FROM r JOIN g ON g.u = r.doc_id WHERE r.c < g.v)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
""",
    "op11_warc_segments": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS largest FROM p),
r AS (SELECT *, n >= 1000 AND largest IS NOT NULL AND page_id IS DISTINCT FROM largest AS again FROM g)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN largest END AS refers_to, true AS intact
FROM r
""",
    "op12_summa_hard_negatives": r"""
WITH v AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.u, a.vec_id AS anchor_id, r.u AS other, r.vec_id AS other_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.u <> r.u WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, other_id NULLS LAST) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.u, p.other ORDER BY s.score DESC, s.other_id NULLS LAST) AS nth
  FROM p JOIN s ON s.u = p.u AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, nth::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE nth <= 3
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
u AS (SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY 1, 2),
b AS (SELECT run, n, flatten(list_transform(string_split(d || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM u),
h AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || bytes::BIGINT[], lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1),
v AS MATERIALIZED (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT k.word, v.word, v.n FROM k JOIN v ON k.cut = v.word UNION SELECT v.word, k.word, k.n FROM k JOIN v ON k.cut = v.word),
best AS (SELECT word, count(*) AS n_near, min({'less': -other_n, 'other': other}) AS b FROM near GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * n THEN b.other END AS form, CASE WHEN -b.less >= 2 * n THEN -b.less END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
way AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL),
ends AS (SELECT way.word, way.root FROM way JOIN f ON f.word = way.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(ends.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN ends ON ends.word = f.word
""",
}
