"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import pieces, runtime
from .exact_dedup import exact_dedup
from .langid import identify_language
from .mixing import mix
from .near_dedup import near_dedup
from .packing import pack
from .quality import score_quality
from .token_counts import count_tokens
from .token_output import tokenize_corpus
from .vector_dedup import near_vectors
from .warc import fixity


def op1_p_stable_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(runtime.read_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_context_mixing_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_corpus(runtime.read_table(spark, sf_dir, "documents"), pieces.tokenizer_path("byte_bpe_50k.json"), end=2)


def op3_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(runtime.read_table(spark, sf_dir, "documents"), runtime.read_table(spark, sf_dir, "labels"), fold=1, folds=3)


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(runtime.read_table(spark, sf_dir, "documents"), amount=1.5, most=2.0, residual="round").drop("copies")


def op5_backoff_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(runtime.read_table(spark, sf_dir, "documents"), fold=2, folds=4)


def op6_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity(runtime.read_table(spark, sf_dir, "pages"))


def op7_tree_merge_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(runtime.read_table(spark, sf_dir, "documents"))


def op8_signature_join_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(runtime.read_table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(runtime.read_table(spark, sf_dir, "documents"), pieces.tokenizer_path("word_bpe_49k.json"), capacity=2048, end=0)


def op10_arrow_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(runtime.read_table(spark, sf_dir, "documents"), pieces.tokenizer_path("piece_bpe_32k.model"), limit=4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_p_stable_vector_dedup": op1_p_stable_vector_dedup,
    "op2_context_mixing_token_output": op2_context_mixing_token_output,
    "op3_bradley_terry_quality": op3_bradley_terry_quality,
    "op4_pivotal_mixing": op4_pivotal_mixing,
    "op5_backoff_language_id": op5_backoff_language_id,
    "op6_merkle_fixity_audit": op6_merkle_fixity_audit,
    "op7_tree_merge_exact_dedup": op7_tree_merge_exact_dedup,
    "op8_signature_join_near_dedup": op8_signature_join_near_dedup,
    "op9_hierarchical_packing": op9_hierarchical_packing,
    "op10_arrow_token_counts": op10_arrow_token_counts,
}

#: Components of a link table ``links(a, b)`` over ``nodes(id)``: the least id that each reaches.
REACHED = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
        least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

ORACLES: dict[str, str] = {
    "op1_p_stable_vector_dedup": f"""
        WITH RECURSIVE nodes AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        links AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.label = y.label AND x.id <> y.id AND len(x.v) = len(y.v)
                  WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
        {REACHED},
        n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
        SELECT least.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, least.id = component_id AS kept
        FROM least LEFT JOIN n USING (id)
    """,
    "op8_signature_join_near_dedup": rf"""
        WITH RECURSIVE nodes AS (
            SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct([concat_ws(' ', w[i], w[i + 1], w[i + 2]) for i in range(1, len(w) - 1)])
                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM nodes),
        sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
        shared AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
        {REACHED}
        SELECT least.id AS doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, least.id = component_id AS kept
        FROM least LEFT JOIN sizes USING (id)
    """,
    "op6_merkle_fixity_audit": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, md5(coalesce(CAST(page_id AS VARCHAR), '')) AS k,
                          replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url, chr(13) || chr(10) AS nl FROM pages),
        r AS (
            SELECT page_id,
                   'WARC/1.0' || nl || 'WARC-Type: resource' || nl
                   || 'WARC-Record-ID: <urn:uuid:' || substr(k, 1, 8) || '-' || substr(k, 9, 4) || '-' || substr(k, 13, 4)
                   || '-' || substr(k, 17, 4) || '-' || substr(k, 21, 12) || '>' || nl
                   || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || url || nl
                   || 'Content-Type: text/html; charset=utf-8' || nl
                   || 'Content-Length: ' || CAST(strlen(body) AS VARCHAR) || nl || nl || body || nl || nl AS record
            FROM p)
        SELECT page_id, CAST(strlen(record) AS BIGINT) AS n_bytes, sha256(record) AS record_sha256, true AS intact FROM r
    """,
    "op7_tree_merge_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
    """,
}
