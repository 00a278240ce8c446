"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm import (
    crf,
    exact_dedup,
    host_suffix,
    huffman,
    interpolated_lm,
    license_diagonals,
    order_minhash,
    piece_fst,
    positional_index,
    prefix_monoid,
    rlz_dedup,
    rotation_codes,
    strassen_negatives,
)

#: Vocabulary files of the installed public tokenizers.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_diagonals.licenses(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = Path(public_tokenizers.path(BYTE_BPE)).read_text(encoding="utf-8")
    return huffman.round_trip(_table(spark, sf_dir, "documents"), tokenizer).withColumnRenamed("id", "doc_id")


def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated"
    )


def op7_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rlz_dedup.duplicate_spans(_table(spark, sf_dir, "documents"))
    return parsed.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op8_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Path(public_tokenizers.path(PIECE_BPE)).read_bytes()
    encoded = piece_fst.encode(_table(spark, sf_dir, "documents"), model)
    return encoded.select(F.col("id").alias("doc_id"), "n_pieces", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "round_trip")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_host_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_suffix.main_text(_table(spark, sf_dir, "pages"))


def op11_prefix_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_monoid.prefix_tree(_table(spark, sf_dir, "conversations"), conv - conv % 20, F.crc32(conv.cast("string")) % 4, 3)


def op12_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return strassen_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op13_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation_codes.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_interpolated_lm": op1_interpolated_lm,
    "op2_license_diagonals": op2_license_diagonals,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_huffman_files": op4_huffman_files,
    "op5_crf_toxicity": op5_crf_toxicity,
    "op6_positional_index": op6_positional_index,
    "op7_rlz_dedup": op7_rlz_dedup,
    "op8_piece_fst": op8_piece_fst,
    "op9_order_minhash": op9_order_minhash,
    "op10_host_suffix": op10_host_suffix,
    "op11_prefix_monoid": op11_prefix_monoid,
    "op12_strassen_negatives": op12_strassen_negatives,
    "op13_rotation_codes": op13_rotation_codes,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_positional_index": r"""
        WITH docs AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        items AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
        windows AS (
          SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
        places AS (
          SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
        found AS (SELECT doc_id, item_id, k, i FROM places JOIN windows USING (k, phrase)),
        hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM found) GROUP BY doc_id),
        named AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
        FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op7_rlz_dedup": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
          SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS phrase
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
        gone AS (
          SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place
          FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY phrase) < doc_id AS known FROM windows) WHERE known),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM docs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)
    """,
    "op11_prefix_monoid": r"""
        WITH RECURSIVE own AS (
          SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
          FROM conversations WHERE conv_id IS NOT NULL),
        heads AS (
          SELECT c, c - c % 20 AS base, xor(list_reduce(
                   list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295) % 4 AS h
          FROM (SELECT DISTINCT c FROM own)),
        turns AS (
          SELECT heads.c, own.p AS d, role, text FROM heads JOIN own ON own.c = base AND own.p <= h
          UNION ALL
          SELECT heads.c, (SELECT least(heads.h, count(*)) FROM own AS b WHERE b.c = base) + own.p - h, role, text FROM heads JOIN own ON own.c = heads.c AND own.p > h),
        paths AS (
          SELECT c, d, string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY d) AS path,
                 string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up,
                 len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, d = max(d) OVER (PARTITION BY c) AS ends FROM turns),
        members AS (
          SELECT c, d, path, coalesce(up, '') AS up, words, ends FROM paths
          UNION ALL SELECT c, 0, '', NULL, 0, c NOT IN (SELECT c FROM turns) FROM heads),
        nodes AS (
          SELECT path, min(up) AS up, min(c) AS conv_id, min(d) AS depth, count(*) AS n, (count(*) - 1) * min(words) AS own_saved,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
          FROM members GROUP BY path),
        kids AS (SELECT up AS path, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY up),
        below AS (
          SELECT top.path, sum((k IS NULL)::INT) AS n_leaves, sum(low.own_saved) AS saved
          FROM nodes AS low LEFT JOIN kids ON kids.path = low.path
          JOIN members AS m ON m.c = low.conv_id AND m.d <= low.depth JOIN nodes AS top ON top.path = m.path GROUP BY top.path)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children,
               n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes AS n LEFT JOIN nodes AS p ON p.path = n.up LEFT JOIN kids ON kids.path = n.path JOIN below ON below.path = n.path
    """,
    "op12_strassen_negatives": """
        WITH rows AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                 coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
          FROM rows AS a JOIN rows AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        ranked AS (
          SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
                 vec_id AS negative_id, positive_score, score AS negative_score
          FROM positives AS p JOIN scores AS s ON p.anchor_id = s.anchor_id
          WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT * FROM ranked WHERE rank <= 5
    """,
    "op13_rotation_codes": """
        WITH RECURSIVE usable AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM usable AS a JOIN usable AS b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN least ON a = vec_id
    """,
}
