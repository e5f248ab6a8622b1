"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, neardup, neighbours, passages, quality, suffixes, token_count, topk, warc

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> bytes:
    """Content of a public tokenizer file; the package that holds it tells its place."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archive(_table(spark, sf_dir, "pages"), folder)
    return warc.summary(spark, folder)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), digests=True)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), scheme=neardup.Scheme(words=4))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("bytes", 256).alias("kept_sha256"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_source_mixing": op3_source_mixing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_repeated_substrings": op6_repeated_substrings,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_warc_archive": op8_warc_archive,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}


_WORD = r"'[^\x20\x09-\x0D]+'"
_WORDS = f"regexp_extract_all(coalesce(text, ''), {_WORD})"

#: SQL for what SQL can express; it compares every row with every other in the plainest way.
ORACLE: dict[str, str] = {
    "op2_exact_top_k": """
        WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
        p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op3_source_mixing": f"""
        WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5('17:' || coalesce(doc_id, -1)), 1, 15) AS BIGINT) AS u FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
        l AS (SELECT *, 3 * total AS cap, sum(total) OVER () - coalesce(sum(3 * total) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS share FROM s
          WINDOW b AS (ORDER BY CAST(3 * total AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, cap * share <= rest * w AS is_full FROM l),
        t AS (SELECT source, total, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(sum(total) OVER () - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM f),
        g AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // total ELSE 0 END AS copies FROM t),
        o AS (SELECT d.*, g.total, g.target, g.copies, CAST(floor(g.target + 0.5) AS BIGINT) - g.copies * g.total AS more,
            coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u % CAST(floor(sqrt((SELECT count(*) FROM d))) AS BIGINT), u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, total AS source_size, target, CAST(copies * size + greatest(0, least(size, more - before)) AS BIGINT) AS taken FROM o""",
    "op4_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws FROM documents),
        h AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) AS k FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
        u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        r AS (SELECT doc_id AS id, doc_id AS c FROM w UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.id)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = w.doc_id AS kept FROM w JOIN r ON r.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n""",
    "op5_repeated_passages": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        k AS (SELECT doc_id, k, array_to_string(ws[k : k + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS k FROM w WHERE len(ws) >= 20)),
        f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS turn FROM k),
        g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS i FROM f WHERE turn > 1),
        x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        y AS (SELECT x.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y ON y.doc_id = w.doc_id""",
    "op8_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, n AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1) FOR i IN range(0, 32)], '') AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d""",
}
