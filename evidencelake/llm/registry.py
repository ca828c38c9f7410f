"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from evidencelake.llm import backoff, bpe, chat, htmlmain, knpoints, merkle, nearjoin, oracles, packing, rules, suffixdup, topk, toxicity, trie
from evidencelake.llm.common import Scratch, table


def op1_byte_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op2_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op3_html_extraction(spark, sf_dir):
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark, sf_dir):
    return backoff.score(table(spark, sf_dir, "documents"))


def op4_word_lm_scoring(spark, sf_dir):
    return backoff.score_words(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return rules.judge(rules.ledger(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("failed").alias("failed_bits"), *rules.MEASURES[5:])


def rule_ablation(spark, sf_dir):
    """The ledger stored once, and for each rule of the current policy what it rejects, and what it alone does."""
    return rules.ablation(Scratch(spark).keep(rules.ledger(table(spark, sf_dir, "documents")), "ledger"))


def op6_curve_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_ngram_jaccard_join(spark, sf_dir):
    return nearjoin.near_groups(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    return suffixdup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    return knpoints.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_chat_formatting(spark, sf_dir):
    hard = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.render_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"rule_ablation": rule_ablation}


ORACLES = {
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_lm_scoring": """
        WITH g AS (
            SELECT doc_id, substr(text, CAST(i AS INTEGER), 3) AS g, count(*) AS n FROM documents, unnest(range(1, length(text) - 1)) AS t(i) GROUP BY ALL),
        c AS (SELECT g, sum(n) AS n FROM g GROUP BY g),
        ab AS (SELECT substr(g, 1, 2) AS k, sum(n) AS n FROM c GROUP BY 1), bc AS (SELECT substr(g, 2, 2) AS k, sum(n) AS n FROM c GROUP BY 1),
        b AS (SELECT substr(g, 2, 1) AS k, sum(n) AS n FROM c GROUP BY 1), z AS (SELECT substr(g, 3, 1) AS k, sum(n) AS n FROM c GROUP BY 1),
        s AS (
            SELECT c.g, ln(CASE WHEN c.n >= 2 THEN c.n / ab.n WHEN bc.n >= 2 THEN 0.4::DOUBLE * bc.n / b.n ELSE 0.4::DOUBLE * 0.4::DOUBLE * z.n / (SELECT sum(n) FROM c) END) AS s
            FROM c JOIN ab ON ab.k = substr(c.g, 1, 2) JOIN bc ON bc.k = substr(c.g, 2, 2) JOIN b ON b.k = substr(c.g, 2, 1) JOIN z ON z.k = substr(c.g, 3, 1)),
        d AS (SELECT doc_id, sum(n) AS n_grams, sum(n * s) AS total FROM g JOIN s USING (g) GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n_grams, 0) AS BIGINT) AS n_grams, round(total / nullif(n_grams, 0), 6) AS score
        FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN d USING (doc_id)""",
    "op4_word_lm_scoring": oracles.WORD_SCORES,
    "op5_quality_rules": oracles.RULES,
    "rule_ablation": oracles.ABLATION,
    "op7_ngram_jaccard_join": oracles.NEAR,
    "op8_suffix_dedup": oracles.REPEATS,
    "op11_prefix_trie": oracles.TRIE,
    "op12_chat_formatting": oracles.CHAT,
    "op13_merkle_manifest": oracles.MERKLE,
}


def oracle_sql():
    return ORACLES
