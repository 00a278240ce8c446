"""Removal of passages that an earlier document already has, by relative Lempel-Ziv factors.

This is a look-up of windows, not a parse against reference texts: each k-word window of a
document is looked up among the windows of all documents, and is marked if a document with a
smaller id has it. Marked windows that overlap or touch are merged, and a merged range is called
a factor. It is at least k words long, has no reference document or position, and may join
windows from several documents. The union of the ranges is the duplicate part of the document.

The index is a key space of k-word hashes spread over buckets (see blocks.py): a block of
documents sends each distinct key once with the smallest id that has it, and gets a bit
back that says whether another block has it with a smaller id. Two sequences count as
equal when a 64-bit hash and the bucket, drawn by a second hash, agree; the buckets grow
with the data, and so do the bits compared.

Defined cases: null and empty texts have no words; a null id counts as below every id;
rows with equal ids are not earlier than each other, so copies under one id stay; of texts
shorter than k words nothing is removed; an empty table gives an empty result; columns
besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparktab.llm import blocks, words

MIN_WORDS = 13

SCHEMA = "id long, n_words long, n_removed long, factor_starts array<int>, factor_ends array<int>, kept string"


class _Windows:
    """The k-word windows of a block's documents; the same for the question and for the end."""

    def __init__(self, table: pa.Table, k: int, n_buckets: int):
        self.data, self.offsets = words.buffer_of(table.column("text"))
        starts, ends, self.first = words.spans(self.data, self.offsets, words.SPACED)
        word = words.hashes(self.data, starts, ends)
        self.at = words.within(self.first, k)
        keys = words.grams(word, k)[self.at]
        owner = blocks.ids_of(table)[words.text_of(self.first)[self.at]]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        heads = np.flatnonzero(new)
        self.keys = ranked[heads]
        self.least = owner[order[heads]]  # documents come by id, so the first of a key has the smallest
        self.key_of = np.empty(len(keys), np.int64)
        self.key_of[order] = np.cumsum(new) - 1
        self.owner = owner
        other = words.grams(word, k, seed=1)[self.at[order[heads]]]
        self.bucket = (other % np.uint64(n_buckets)).astype(np.int64)


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, the merged factors as word ranges [start, end), and the kept
    words joined by one space."""
    rows = blocks.documents(docs, id_col, text_col)
    _, n_bytes = blocks.sizes(rows)
    n_buckets = blocks.bucket_count(n_bytes // 7)
    dealt = blocks.deal(rows, n_bytes)

    def questions(block, table):
        w = _Windows(table, k, n_buckets)
        if not len(w.keys):
            return
        base = int(w.least.min())
        above = (w.least - base).view(np.uint64)
        for b, of in blocks.by_bucket(w.bucket, n_buckets):
            yield b, block, len(of), w.keys[of].tobytes(), base.to_bytes(8, "little", signed=True) + words.narrow(above[of])

    def reply(rows):
        keys = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in rows])
        least = np.concatenate(
            [words.widen(r["extra"][8:], r["n"]).view(np.int64) + int.from_bytes(r["extra"][:8], "little", signed=True) for r in rows]
        )
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))
        earlier = np.empty(len(keys), bool)
        earlier[order] = least[order] > smallest[np.cumsum(new) - 1]
        at = 0
        for r in rows:
            own = earlier[at : at + r["n"]]
            at += r["n"]
            if own.any():
                yield r["block"], r["bucket"], r["n"], np.packbits(own).tobytes()

    def finish(block, table, replies):
        w = _Windows(table, k, n_buckets)
        known = np.zeros(len(w.keys), bool)
        if replies:
            for b, of in blocks.by_bucket(w.bucket, n_buckets):
                if b in replies:
                    known[of] = np.unpackbits(np.frombuffer(replies[b][1], np.uint8), count=len(of)).astype(bool)
        matched = known[w.key_of] | (w.least[w.key_of] < w.owner)
        at = w.at[matched]
        total = int(w.first[-1])
        dup = words.covered(total, at, at + k)
        kept, starts, ends = [], [], []
        removed = np.zeros(table.num_rows, np.int64)
        touched = np.zeros(table.num_rows, bool)
        touched[words.text_of(w.first)[at]] = True
        for i in range(table.num_rows):
            tokens = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split()
            if touched[i]:
                gone = dup[w.first[i] : w.first[i + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                starts.append(edge[::2].tolist())
                ends.append(edge[1::2].tolist())
                removed[i] = int(gone.sum())
                tokens = compress(tokens, (~gone).tolist())
            else:
                starts.append([])
                ends.append([])
            kept.append(b" ".join(tokens).decode("utf-8"))
        return pa.table(
            {
                "id": table.column("id"),
                "n_words": pa.array(np.diff(w.first)),
                "n_removed": pa.array(removed),
                "factor_starts": pa.array(starts, pa.list_(pa.int32())),
                "factor_ends": pa.array(ends, pa.list_(pa.int32())),
                "kept": pa.array(kept, pa.string()),
            }
        )

    asked = blocks.ask(dealt, questions)
    return blocks.meet(dealt, blocks.answer(asked, n_buckets, reply), finish, SCHEMA)
