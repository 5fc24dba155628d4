"""The operators' queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from rowforge.llm import op1_topk, op2_mixing, op3_kdtree, op4_toxicity, op5_syncmers, op6_chat, op7_jaccard, op8_secrets, op9_repair, op10_bpe


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_byte_bpe(spark, sf_dir):
    return op10_bpe.encode_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_threshold_topk(spark, sf_dir):
    return op1_topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_mixing_rates(spark, sf_dir):
    labelled = op2_mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op2_mixing.mixing_rates(_documents(spark, sf_dir), labelled, [0.88, 0.08, 0.04])


def op3_kd_shards(spark, sf_dir):
    return op3_kdtree.kd_shards(_documents(spark, sf_dir))


def op4_toxicity_grades(spark, sf_dir):
    return op4_toxicity.grade_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_syncmer_fingerprints(spark, sf_dir):
    return op5_syncmers.fingerprints(_documents(spark, sf_dir))


def op6_chat_paths(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return op6_chat.conversation_digests(said.unionByName(more))


def op7_jaccard_groups(spark, sf_dir):
    return op7_jaccard.near_groups(_documents(spark, sf_dir), words=3, percent=90)


def op8_secret_spans(spark, sf_dir):
    return op8_secrets.find_secrets(_documents(spark, sf_dir))


def op9_repair_ids(spark, sf_dir):
    return op9_repair.token_offsets(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_threshold_topk": op1_threshold_topk, "op2_mixing_rates": op2_mixing_rates, "op3_kd_shards": op3_kd_shards, "op4_toxicity_grades": op4_toxicity_grades, "op5_syncmer_fingerprints": op5_syncmer_fingerprints, "op6_chat_paths": op6_chat_paths, "op7_jaccard_groups": op7_jaccard_groups, "op8_secret_spans": op8_secret_spans, "op9_repair_ids": op9_repair_ids, "op10_byte_bpe": op10_byte_bpe}
ORACLE: dict[str, str] = {
    "op7_jaccard_groups": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d
        ), u AS (
            SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
        ), link AS (
            SELECT a.doc_id AS p, b.doc_id AS q FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS c FROM s UNION SELECT link.q, reach.c FROM reach JOIN link ON reach.doc_id = link.p
        )
        SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)""",
    "op6_chat_paths": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
            UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 24) AS BIGINT) AS formatted_chars
        FROM said GROUP BY conv_id""",
    "op1_threshold_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
            FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
