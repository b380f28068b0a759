"""One query for each operator of this package, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .hard_negatives import hard_negatives
from .histogram_shards import histogram_shards
from .line_chunks import line_dedup
from .packing import pack
from . import quality_crf
from .recompression import repeated_windows
from .simhash_trie import simhash_groups
from .spaced_seeds import find_passages
from .suffix_dedup import repeated_bytes
from .tokens import vocabulary
from .topk_search import top_k
from .warc import archive_round_trip
from .wavelet import token_shards
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, in doc_id order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("__bytes"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    out = histogram_shards(docs, "doc_id", F.coalesce(F.col("__bytes"), F.lit(0)) + 1, shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark's items of five words or more in all documents, a row for each document and benchmark text."""
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_words=5)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes that no 50-byte string of an earlier document covers."""
    return repeated_bytes(table(spark, sf_dir, "documents"), length=50).drop("kept")


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that no repeated 35-word window covers."""
    out = repeated_windows(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    out = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, found by the capture index and read from the archives."""
    out = archive_round_trip(table(spark, sf_dir, "pages"), least_bytes=1000)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_crf.quality(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, read back from the wavelet-matrix shards."""
    out = token_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return out.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines after the removal of repeated runs of lines."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op11_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of every fiftieth embedding."""
    return top_k(table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)


def op12_pca_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding; where vec_id is divisible by 7, the label is the next one."""
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", changed), "id % 50 = 0", positives=5, negatives=3)


def op13_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding, whitened on the four leading components."""
    return whiten(table(spark, sf_dir, "embeddings"), components=4)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_spaced_seeds, op2_suffix_array, op3_recompression, op4_best_fit_packing, op5_warc_index, op6_line_crf, op7_wavelet_tokens, op8_line_chunks, op9_simhash_trie, op10_histogram_shards, op11_columnar_topk, op12_pca_negatives, op13_lobpcg_whitening)}
#: What SQL can express whole. The texts' own bytes, words and payloads are counted there by other means.
SQL: dict[str, str] = {
    "op2_suffix_array": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        b AS (SELECT doc_id, x, unnest(range(0, len(x) // 2)) AS i FROM d),
        s AS (SELECT doc_id, i, substring(x, 2 * i + 1, 2) AS byte, substring(x, 2 * i + 1, 100) AS str FROM b),
        f AS (SELECT str, min(doc_id) AS least FROM s WHERE len(str) = 100 GROUP BY 1),
        m AS (SELECT s.doc_id, s.i, s.byte, coalesce(f.least < s.doc_id, false) AS hit FROM s LEFT JOIN f ON s.str = f.str),
        g AS (SELECT doc_id, i, byte, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
        o AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
              sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256 FROM e GROUP BY 1)
        SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
        FROM d LEFT JOIN o USING (doc_id)""",
    "op3_recompression": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        t AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
        n AS (SELECT word, row_number() OVER () AS id FROM (SELECT DISTINCT word FROM t)),
        s AS (SELECT r, k, word, list(id) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS win FROM t JOIN n USING (word)),
        c AS (SELECT win FROM s WHERE len(win) = 35 GROUP BY 1 HAVING count(*) > 1),
        m AS (SELECT s.r, s.k, s.word, len(s.win) = 35 AND c.win IS NOT NULL AS hit FROM s LEFT JOIN c ON s.win = c.win),
        g AS (SELECT r, k, word, bool_or(hit) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
        o AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM g GROUP BY 1)
        SELECT d.doc_id, coalesce(o.n_words, 0) AS n_words, coalesce(o.n_removed, 0) AS n_removed, coalesce(o.kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN o USING (r)""",
    "op5_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top, payload_bytes >= 1000 AS long FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN long AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN long AND page_id <> top THEN top END AS refers_to
        FROM g""",
    "op11_columnar_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op12_pca_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                   WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.x) = len(c.x)),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
               s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        QUALIFY rank <= 3""",
}
