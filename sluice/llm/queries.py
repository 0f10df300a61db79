"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_templates, op2_vectors, op3_suffixes, op4_quality, op5_pii, op6_tokens, op7_pieces, op8_minhash, op9_urls, op10_html
from .shared import Scratch

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_templates.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_suffixes.remove_repeats(_table(spark, sf_dir, "documents"), length=200)


def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), limit=0.7)


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pii.find(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    root = scratch.path("shards")
    manifest = op6_tokens.write_ids(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), root, end_id=0)
    return op6_tokens.read_digests(spark, scratch.keep(manifest, "manifest"), root)


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_pieces.encode(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_urls.url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_html.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_template_decontamination, op2_embedding_near_dedup, op3_suffix_dedup, op4_rule_quality, op5_boosted_pii,
        op6_token_files, op7_piece_sampling, op8_minhash_near_dedup, op9_url_filter, op10_html_extraction,
    )
}

_REACH = """
reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN linked l ON l.a = r.other),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": f"""
WITH RECURSIVE valid AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH},
n AS (SELECT a, count(*) AS n_links FROM linked GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN n ON n.a = id
""",
    "op8_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END) AS shingles FROM w),
sizes AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
items AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM items x JOIN items y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM component JOIN sizes ON doc_id = id
""",
}
