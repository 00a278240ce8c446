"""Language-model scores by deleted interpolation.

The model mixes two maximum-likelihood estimates, of the word after its predecessor and of
the word alone:

    P(w | v) = l[b(v)] * c(v, w) / c(v) + (1 - l[b(v)]) * (c(w) + 1) / (N + V + 1)

b(v) groups the contexts by their frequency (powers of two). The weights l come from
expectation-maximisation on held-out counts: every training document is held out in turn,
its tokens are judged with the counts of all others, and what EM needs of them, the ratio
of the two estimates, is kept as a histogram per group. All training tokens take part, in
the counts and in the weights.

A text's tokens are its lower-cased words and one end token; the end token of the text
before serves as the context of the first word, so c(end) counts the texts.

Counts are asked for as packed questions of blocks to a bucketed key space (blocks.py):
nothing has the size of the vocabulary on the driver or in a broadcast. What the driver
gets is N, V and histograms of at most GROUPS x BINS cells.

Defined cases: a null text is an empty text, which is one end token; a null id counts as
the text '' for the training rule; rows that repeat are texts of their own; without any
training row N and V are 0 and all weights are 0, so the score is the base score; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm import blocks, words

GROUPS = 32
#: Ratios are counted in steps of 1/STEPS of a power of two, from 2**-LOW_POWER on.
STEPS, LOW_POWER = 16, 64
BINS = 2 * LOW_POWER * STEPS
ROUNDS, TOLERANCE = 200, 1e-7
LN10 = float(np.log(10.0))

PARTS = (
    "id long, trains boolean, n_tokens long, n_known long, base double, "
    "unseen binary, n_seen int, seen binary, times binary, vocabulary long, cells binary, counts binary"
)


def every_seventh(doc_id: int | None) -> bool:
    """True for documents the model learns from: crc32 of the id's decimal text, modulo 7, is not 2."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


class _Tokens:
    """Words and end tokens of a block's texts with the block's distinct words and word pairs."""

    END = np.uint64(0x1F3D5B79A8C6E402)

    def __init__(self, table: pa.Table, trains: Callable, n_buckets: int):
        data, offsets = words.buffer_of(table.column("text"))
        data = words.LOWER[data]
        starts, ends, first = words.spans(data, offsets, words.SPACED)
        n_docs = table.num_rows
        self.ids = table.column("id").to_pylist()
        self.trains = np.array([trains(i) for i in self.ids], bool)
        # one end after each text: position of word j of text i is j + i
        self.first = first + np.arange(n_docs + 1)
        self.n = int(self.first[-1])
        token = np.full(self.n, self.END, np.uint64)
        token[np.arange(len(starts)) + words.text_of(first)] = words.hashes(data, starts, ends)
        before = np.empty(self.n, np.uint64)
        before[1:] = token[:-1]
        before[self.first[:-1]] = self.END
        self.of = words.text_of(self.first)
        pair = words.mix(before * np.uint64(0xD1342543DE82EF95) + token * np.uint64(0x2545F4914F6CDD1D))
        other = words.mix(before * np.uint64(0x9FB21C651E98DF25) ^ words.mix(token))
        weight = self.trains[self.of]
        self.word_of, self.word_keys, self.word_count, head, self.word_own = self._distinct(token, weight)
        self.word_bucket = (words.mix(~token[head]) % np.uint64(n_buckets)).astype(np.int64)
        self.pair_of, self.pair_keys, self.pair_count, head, self.pair_own = self._distinct(pair, weight)
        self.pair_bucket = (other[head] % np.uint64(n_buckets)).astype(np.int64)
        # the context of a token as a distinct word: its predecessor, the end token for a first word
        previous = np.arange(self.n) - 1
        previous[self.first[:-1]] = self.first[1:] - 1
        self.context_of, self.context_own = self.word_of[previous], self.word_own[previous]

    def _distinct(self, keys, weight):
        """For each token the number of its key, and how often the key is in its document; for each key its value,
        its count in training documents and one place."""
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        count = np.bincount(number[weight], minlength=len(heads)).astype(np.int64)
        new[1:] |= np.diff(self.of[order]) != 0
        runs = np.flatnonzero(new)
        own = np.empty(len(keys), np.int64)
        own[order] = np.repeat(np.diff(np.append(runs, len(keys))), np.diff(np.append(runs, len(keys))))
        return number, ranked[heads], count, order[heads], own


def _seven(keys: np.ndarray) -> bytes:
    """Seven bytes of each key. With the bucket, drawn by another hash, 62 bits or more are compared, and more as the
    buckets grow with the data; a rare shared key adds up two counts."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _eight(raw: bytes) -> np.ndarray:
    seven = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    out = np.zeros((len(seven), 8), np.uint8)
    out[:, :7] = seven
    return out.reshape(-1).view("<u8")


def _histogram_add(into: dict, cells: np.ndarray, counts: np.ndarray) -> None:
    for c, n in zip(cells.tolist(), counts.tolist()):
        into[c] = into.get(c, 0) + n


def count_parts(docs: DataFrame, id_col: str, text_col: str, trains: Callable[[int | None], bool]) -> DataFrame:
    """Staged rows: per document what its score needs besides the weights, and per block histograms and key totals."""
    rows = blocks.documents(docs, id_col, text_col)
    _, n_bytes = blocks.sizes(rows)
    n_buckets = blocks.bucket_count(n_bytes // 6)
    dealt = blocks.deal(rows, n_bytes, 2 * blocks.BLOCK_BYTES)

    def questions(block, table):
        t = _Tokens(table, trains, n_buckets)
        for kind, (bucket, keys, count) in enumerate(((t.word_bucket, t.word_keys, t.word_count), (t.pair_bucket, t.pair_keys, t.pair_count))):
            for b, of in blocks.by_bucket(bucket, n_buckets):
                # words and pairs of a bucket are questions of their own: even and odd buckets
                yield 2 * b + kind, block, len(of), _seven(keys[of]), words.narrow(count[of])

    def reply(rows):
        keys = np.concatenate([_eight(r["keys"]) for r in rows])
        count = np.concatenate([words.widen(r["extra"], r["n"]) for r in rows]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        total = np.add.reduceat(count[order], np.flatnonzero(new))
        everywhere = np.empty(len(keys), np.int64)
        everywhere[order] = total[np.cumsum(new) - 1]
        at = 0
        bucket = rows[0]["bucket"]
        for r in rows:
            yield r["block"], bucket, r["n"], words.narrow(everywhere[at : at + r["n"]])
            at += r["n"]
        if bucket % 2 == 0:  # the vocabulary is counted where each word is seen whole
            yield -1, bucket, int((total > 0).sum()), None

    def finish(block, table, replies):
        if block < 0:
            return _rows([], vocabulary=sum(n for n, _ in replies.values()))
        t = _Tokens(table, trains, n_buckets)
        total = []
        for kind, (bucket, keys) in enumerate(((t.word_bucket, t.word_keys), (t.pair_bucket, t.pair_keys))):
            full = np.zeros(len(keys), np.int64)
            for b, of in blocks.by_bucket(bucket, n_buckets):
                full[of] = words.widen(replies[2 * b + kind][1], len(of)).astype(np.int64)
            total.append(full)
        word_total, pair_total = total
        word, context, pair = word_total[t.word_of], word_total[t.context_of], pair_total[t.pair_of]
        group = _group(context)
        log_word = np.log10(word + 1.0)
        n_docs = table.num_rows
        docs_rows = []
        known = np.add.reduceat((word > 0).astype(np.int64), t.first[:-1]) if n_docs else []
        base = np.add.reduceat(log_word, t.first[:-1]) if n_docs else []
        seen = pair > 0
        ratio = (pair[seen] / (context[seen] * (word[seen] + 1.0))).astype("<f4").view(np.uint32).astype(np.int64)
        # a document's tokens with the same group and ratio count as one value and its multiplicity
        values, times = np.unique(t.of[seen] << 40 | group[seen] << 32 | ratio, return_counts=True)
        cuts = np.searchsorted(values, np.arange(n_docs + 1) << 40)
        for i in range(n_docs):
            own, hits = slice(t.first[i], t.first[i + 1]), slice(cuts[i], cuts[i + 1])
            docs_rows.append(
                (
                    t.ids[i],
                    bool(t.trains[i]),
                    int(t.first[i + 1] - t.first[i]),
                    int(known[i]),
                    float(base[i]),
                    np.bincount(group[own][~seen[own]], minlength=GROUPS).astype("<i4").tobytes(),
                    int(cuts[i + 1] - cuts[i]),
                    words.narrow(np.diff(values[hits] & 0xFFFFFFFFFF, prepend=0)),
                    words.narrow(times[hits]),
                )
            )
        # each training document held out: what all others say of its tokens
        learns = t.trains[t.of]
        word, context = (word - t.word_own)[learns], (context - t.context_own)[learns]
        pair = (pair - t.pair_own)[learns]
        cell = np.zeros(len(word), np.int64)
        seen = (pair > 0) & (context > 0)
        power = np.log2(pair[seen] / (context[seen] * (word[seen] + 1.0)))
        cell[seen] = 1 + np.clip(np.floor((power + LOW_POWER) * STEPS), 0, BINS - 2).astype(np.int64)
        cells, counts = np.unique(_group(context) * BINS + cell, return_counts=True)
        return _rows(docs_rows, cells=cells, counts=counts)

    asked = blocks.ask(dealt, questions)
    answered = blocks.answer(asked, 2 * n_buckets, reply)
    return blocks.staged(blocks.meet(dealt, answered, finish, PARTS), "lm-parts")


def _group(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else by powers of two."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), GROUPS - 1), 0)


def _rows(docs_rows, vocabulary=None, cells=None, counts=None) -> pa.Table:
    names = [x.split()[0] for x in PARTS.split(", ")]
    extra = (*[None] * 9, vocabulary, None if cells is None else cells.astype("<i8").tobytes(), None if counts is None else counts.astype("<i8").tobytes())
    rows = [(*r, None, None, None) for r in docs_rows] + [extra]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names)


def held_out_cells(parts: DataFrame) -> dict[int, int]:
    """Held-out tokens by group and ratio step, summed over all blocks: at most GROUPS x BINS cells."""

    def run(batches):
        cells: dict[int, int] = {}
        for batch in batches:
            for c, n in zip(batch.column("cells").to_pylist(), batch.column("counts").to_pylist()):
                _histogram_add(cells, np.frombuffer(c, "<i8"), np.frombuffer(n, "<i8"))
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int64()), pa.array(list(cells.values()), pa.int64())], ["cell", "n"])

    sums = parts.where("cells is not null").select("cells", "counts").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return {r["cell"]: r["n"] for r in sums.collect()}


def learn_weights(cells: dict[int, int], scale: float) -> np.ndarray:
    """One weight per context group, by expectation-maximisation; scale is N + V + 1."""
    table = np.zeros((GROUPS, BINS))
    for cell, n in cells.items():
        table[cell // BINS, cell % BINS] = n
    ratio = np.zeros(BINS)
    ratio[1:] = 2.0 ** ((np.arange(BINS - 1) + 0.5) / STEPS - LOW_POWER) * scale
    weights = np.where(table.sum(axis=1) > 0, 0.5, 0.0)
    weights[0] = 0.0
    for _ in range(ROUNDS):
        mixed = weights[:, None] * ratio[None, :]
        share = mixed / (mixed + (1.0 - weights)[:, None])
        new = np.divide((table * share).sum(axis=1), table.sum(axis=1), out=np.zeros(GROUPS), where=table.sum(axis=1) > 0)
        new = np.clip(new, 0.0, 1.0 - 1e-6)
        new[0] = 0.0
        moved = np.abs(new - weights).max()
        weights = new
        if moved < TOLERANCE:
            break
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trains: Callable[[int | None], bool] = every_seventh) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, vocabulary, base_score, score (log10)."""
    parts = count_parts(docs, id_col, text_col, trains)
    totals = parts.agg(F.sum(F.when(F.col("trains"), F.col("n_tokens"))).alias("n"), F.sum("vocabulary").alias("v")).first()
    tokens, vocabulary = int(totals["n"] or 0), int(totals["v"] or 0)
    scale = float(tokens + vocabulary + 1)
    weights = learn_weights(held_out_cells(parts), scale)
    unseen_gain = np.log10(1.0 - weights)

    def run(batches):
        for batch in batches:
            gain = []
            for unseen, seen, n_seen, times in zip(*(batch.column(c).to_pylist() for c in ("unseen", "seen", "n_seen", "times"))):
                value = np.cumsum(words.widen(seen, n_seen))
                of = weights[value >> np.uint64(32)]
                ratio = (value & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.float32).astype(np.float64)
                mixed = of * (ratio * scale) + (1.0 - of)
                gain.append(float(np.frombuffer(unseen, "<i4") @ unseen_gain + np.log10(mixed) @ words.widen(times, n_seen)))
            base = batch.column("base").to_numpy() - batch.column("n_tokens").to_numpy() * np.log10(scale)
            n = batch.num_rows
            columns = [
                batch.column("id"),
                pa.array(~batch.column("trains").to_numpy(zero_copy_only=False)),
                batch.column("n_tokens"),
                batch.column("n_known"),
                pa.array(np.full(n, tokens, np.int64)),
                pa.array(np.full(n, vocabulary, np.int64)),
                pa.array(base),
                pa.array(base + np.array(gain)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "vocabulary", "base_score", "score"])

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, vocabulary long, base_score double, score double"
    return parts.where("trains is not null").select("id", "trains", "n_tokens", "n_known", "base", "unseen", "seen", "n_seen", "times").mapInArrow(run, schema)
