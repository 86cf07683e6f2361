"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bsi_topk import top_k
from .common import table
from .decontaminate import find_leaks
from .html_wrappers import extract_pages
from .ngram_join import near_duplicate_classes
from .pii import checked, surrogate_documents
from .quality import score_quality
from .secrets import oracle as secrets_sql, scan_secrets
from .sentencepiece_codec import encode_documents
from .sharding import shard_documents
from .toxicity import score_toxicity


#: A public SentencePiece model of 32,000 pieces.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Anyone who knows the key can undo the surrogates: pass your own, kept secret, for real texts.
PII_KEY = b"example key for the registered queries"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"), size=4, percent=85)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str, key: bytes = PII_KEY) -> DataFrame:
    return checked(surrogate_documents(table(spark, sf_dir, "documents"), key))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_path, verify=-1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_decontamination": op2_decontamination,
        "op3_exact_topk": op3_exact_topk,
        "op4_ngram_join": op4_ngram_join,
        "op5_quality": op5_quality,
        "op6_sharding": op6_sharding,
        "op7_html_text": op7_html_text,
        "op8_secrets": op8_secrets,
        "op9_pii_surrogates": op9_pii_surrogates,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": OP3_SQL, "op4_ngram_join": OP4_SQL, "op8_secrets": secrets_sql()}


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 3), ' ') END AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT f.doc_id AS a, h.doc_id AS b FROM p JOIN n f ON f.r = x JOIN n h ON h.r = y WHERE 100 * c >= 85 * (f.n + h.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
m AS (SELECT a, min(b) AS b FROM t GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (r) LEFT JOIN m ON m.a = w.doc_id
"""
