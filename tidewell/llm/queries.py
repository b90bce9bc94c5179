"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.fixtures import read

from . import bit_slices, context_mixing, line_dedup, lsh_forest, merge_path, mixing, mtree, nbsvm, packing, secret_scan, surrogates, syncmers, token_index
from .common import documents

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER, RANKS = "byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
#: The key of the surrogates; a deployment gives its own.
SECRET = "tidewell surrogate key"


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edited(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of five words or more that an earlier document or line has; the starts and lengths
    of what is removed, in the original text, as comma-separated numbers."""
    numbers = {c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("removed_starts", "removed_lengths")}
    return line_dedup.remove_repeats(documents(spark, sf_dir)).select("doc_id", "text", F.size("removed_starts").alias("n_removed"), *numbers.values())


def op3_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.index_documents(spark, documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced, and the types of what was replaced."""
    return surrogates.replace_entities(documents(spark, sf_dir), SECRET).select("doc_id", "text", "kinds")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search_every(read(spark, sf_dir, "embeddings"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and links (other documents with a shingle Jaccard of 0.8 or more)."""
    return lsh_forest.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "links")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.scores(documents(spark, sf_dir), read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scores(documents(spark, sf_dir))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_path.report(documents(spark, sf_dir), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.search(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_substring_dedup, op3_token_index, op4_pii_surrogates, op5_best_fit_packing, op6_exact_top_k, op7_ngram_jaccard_join, op8_quality_classifier, op9_source_mixing, op10_lm_scoring,
                                   op11_tokenizer_alignment, op12_secret_scan, op13_lexical_search)}

ORACLE: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit,
                          generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text <> ''),
        n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(unit), '[\p{P}\p{S}]+', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS n,
                     sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY place) - length(unit) - 1 AS start,
                     sum(length(unit) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM u),
        r AS (SELECT *, n <> '' AND len(string_split(n, ' ')) >= 5
                        AND row_number() OVER (PARTITION BY n ORDER BY doc_id, place) > 1 AS gone FROM n),
        d AS (SELECT doc_id, coalesce(string_agg(unit, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
                     CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
                     coalesce(string_agg(CAST(start AS VARCHAR), ',' ORDER BY place) FILTER (gone), '') AS removed_starts,
                     coalesce(string_agg(CAST(least(length(unit) + 1, total - start) AS VARCHAR), ',' ORDER BY place) FILTER (gone), '') AS removed_lengths
              FROM r GROUP BY doc_id)
        SELECT doc_id, text, n_removed, removed_starts, removed_lengths FROM d
        UNION ALL SELECT doc_id, text, 0, '', '' FROM documents WHERE text IS NULL OR text = ''""",
    "op6_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
                     , q.v AS qv FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0) q, v c WHERE c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op9_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, md5('17:' || doc_id) AS h,
                          coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
        s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
        w AS (SELECT *, CAST((n - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
        l AS (SELECT a.n, a.cap / a.w AS own, ((SELECT sum(source_size) FROM s) - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w), 0))
                     / sum(b.w) FILTER (b.cap / b.w >= a.cap / a.w) AS level FROM w a, w b GROUP BY a.n, a.cap, a.w),
        t AS (SELECT *, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= own) * w, cap)) AS target FROM w),
        p AS (SELECT d.*, source_size, target, floor(target + 1e-6) AS goal,
                     sum(size) OVER (PARTITION BY n ORDER BY h, doc_id) - size AS pos
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
               CAST((SELECT sum(greatest(0, least(pos + size + k * source_size, goal) - (pos + k * source_size))) FROM range(3) r(k)) AS BIGINT) AS taken
        FROM p""",
    "op13_lexical_search": r"""
        WITH t AS (SELECT rowid AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                   FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
        f AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        s AS (SELECT r, count(*) AS n FROM t GROUP BY r),
        g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM s),
        i AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, docs),
        x AS (SELECT item_id, i.text, f.r, f.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
              FROM i JOIN w USING (term) JOIN f USING (term) JOIN s ON s.r = f.r, g GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
        FROM x WHERE score > 0 QUALIFY rank <= 10""",
}
