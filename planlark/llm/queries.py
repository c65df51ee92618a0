"""The queries of the corpus operators, over whole tables, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planlark.llm import bpe_chunks, exact_dedup, hamming, html_extract, mixing, ngram_join, prefix_trie, quality, rans_store, secrets, toxicity, warc, whitening
from planlark.llm.common import LOWER, UPPER, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op1_exact_dedup(spark, table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.op2_bpe(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3_mixing(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op4_ngram_join(spark, table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.op5_topk(spark, table(spark, sf_dir, "embeddings"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op6_html(spark, table(spark, sf_dir, "pages"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op7_secrets(spark, table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_store.op9_rans(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op10_warc(spark, table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11_whitening(spark, table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op12_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op13_trie(spark, table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_ngram_join": op4_ngram_join,
    "op5_exact_topk": op5_exact_topk,
    "op6_html_extraction": op6_html_extraction,
    "op7_secret_scans": op7_secret_scans,
    "op8_toxicity": op8_toxicity,
    "op9_rans": op9_rans,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_quality": op12_quality,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
        FROM t JOIN g ON t.text_sha256 = g.text_sha256""",
    "op5_exact_topk": """
        WITH bits AS (
            SELECT vec_id AS id, CASE WHEN x > 0 THEN 1 ELSE 0 END AS bit, i
            FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)),
        codes AS (SELECT id, string_agg(bit::VARCHAR, '' ORDER BY i) AS code FROM bits GROUP BY id),
        pairs AS (
            SELECT q.id AS query_id, r.id AS vec_id, hamming(q.code, r.code) AS distance
            FROM codes q JOIN codes r ON q.id <> r.id WHERE q.id % 100 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= 10""",
    "op10_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
        d AS (
            SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
                array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest
            FROM t),
        g AS (SELECT payload_digest AS pd, max(page_id) AS head FROM d GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
            CASE WHEN d.page_id = g.head THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN d.page_id = g.head THEN NULL ELSE g.head END AS refers_to
        FROM d JOIN g ON d.payload_digest = g.pd""",
    "op13_prefix_trie": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
            SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS from_id,
                xor(4294967295, list_reduce(
                    list_prepend(4294967295::BIGINT, list_transform(range(1, CAST(length(conv_id::VARCHAR) AS BIGINT) + 1), lambda i: ascii(substr(conv_id::VARCHAR, CAST(i AS INTEGER), 1))::BIGINT)),
                    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 9 AS h
            FROM t GROUP BY conv_id),
        c AS (SELECT o.conv_id, o.from_id, o.h, least(o.h, coalesce(f.n, 0)) AS taken, least(o.h, coalesce(f.n, 0)) + greatest(o.n - o.h, 0) AS len
            FROM own o LEFT JOIN own f ON f.conv_id = o.from_id),
        r AS (
            SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.from_id AND t.pos <= c.h
            UNION ALL SELECT c.conv_id, t.pos - c.h + c.taken, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
        p AS (
            SELECT conv_id, pos AS depth, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS path, strlen(text) AS bytes FROM r
            UNION ALL SELECT conv_id, 0, [], 0 FROM c),
        m AS (SELECT p.conv_id AS member, p.depth, c.len, p.bytes, min(p.conv_id) OVER (PARTITION BY p.path) AS conv_id FROM p JOIN c ON c.conv_id = p.conv_id),
        n AS (
            SELECT conv_id, depth, count(*) AS n_convs, max(bytes) AS bytes, max(len) = depth AS leaf,
                sha256(coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (len = depth), '')) AS ends_sha256
            FROM m GROUP BY conv_id, depth),
        up AS (SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id FROM n JOIN m ON m.member = n.conv_id AND m.depth = n.depth - 1),
        kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
        sums AS (
            SELECT m.conv_id, m.depth, count(*) FILTER (n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
            FROM n JOIN m ON m.member = n.conv_id AND m.depth <= n.depth GROUP BY m.conv_id, m.depth)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children,
            sums.n_leaves, CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM n JOIN sums ON sums.conv_id = n.conv_id AND sums.depth = n.depth
        LEFT JOIN up ON up.conv_id = n.conv_id AND up.depth = n.depth
        LEFT JOIN kids ON kids.conv_id = n.conv_id AND kids.depth = n.depth""",
}
