"""Exact duplicates by skew-safe combining, with DataFrame operations only.

Texts are grouped in three stages, and each one groups by the whole text next to its
digest, so equal means equal content, never just an equal hash:

1. local: the partial aggregation before the first shuffle folds the copies of a task;
2. salted: what is left meets by (salt, digest, text), so the copies of one text, however
   many, are spread over SALTS tasks;
3. global: at most SALTS winners per text are combined to the row that stays.

Then every document looks its winner up by the digest (SHA-256) along with length and a
second hash, so that no text travels a third time.

Defined cases: a null text is an empty text; a null id is below every id and stays only in
a group of null ids; rows that repeat with id and text are one document and share the
decision; an empty table gives an empty result; the input's other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def winners(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text of rows (id, text, digest): digest, text, keep_id, group_size."""
    salted = (
        rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "digest", "text")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, normalise: Column | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest (sha256, lowercase hex). normalise: the text to
    compare, as an expression over docs; else the text as it is."""
    text = F.coalesce(normalise if normalise is not None else F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    won = winners(rows, salts)
    mark = [F.octet_length("text").alias("size"), F.xxhash64("text").alias("check")]
    members = rows.select("id", "digest", *mark)
    groups = won.select("digest", *mark, "keep_id", "group_size")
    hits = members.join(groups, ["digest", "size", "check"])
    return hits.select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat with id and text, one. The winner's
    other columns travel through the same three stages, so no join is needed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = F.struct(F.col(id_col).cast("long").isNotNull(), F.col(id_col).cast("long"))
    rest = F.struct(F.col(text_col).isNull().alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])
    rows = docs.select(text.alias("text"), order.alias("o"), rest.alias("r"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    best = lambda: (F.max("o").alias("o"), F.max_by("r", "o").alias("r"))
    salted = rows.groupBy(F.pmod(F.xxhash64("o"), F.lit(salts)).cast("int").alias("salt"), "digest", "text").agg(*best())
    won = salted.groupBy("digest", "text").agg(*best())
    kept = F.when(~F.col("r.none"), F.col("text"))
    return won.select(*[(kept if c == text_col else F.col(f"r.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
