"""Toxic spans by a linear-chain conditional random field.

The tags are 0 and 1 (toxic). A token's emission is the sum of the weights of its features,
the lower-cased word and its first 3 to 6 bytes, hashed; a 2 x 2 table scores neighbouring
tags. Forward-backward gives each token's marginal probability of tag 1 within its run of
at most RUN tokens. The tokens at half or more are the offending ones, with their character
offsets; a document's score comes from its largest marginal, calibrated on documents.

Training tokens are labelled from the documents' labels. A feature marks toxic tokens if it
stands almost only in toxic documents, in at least CONTEXTS different contexts (the word
before and the word after), so that copies of one text do not make its words suspicious. A
token of a toxic document is labelled 1 if one of its features marks toxic tokens.

The model is fitted in one task on a bounded sample, by hash of the id: at most SAMPLE_DOCS
different texts of each label, drawn from those of at most SAMPLE_CHARS characters, and at
most TRAIN_RUNS runs. All documents are scored in whole.

Defined cases: null and empty texts have no token, and get the calibrated score of a marginal
of zero; a null id is not learned from (the label table has nothing for it) and counts as
not held out; rows that repeat are scored alike; a document with two labels counts as toxic
if one says so, labels without a document and null labels are left out; with no toxic or no
clean training document the score is the share of toxic ones (0 if there are none); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm import blocks, words
from sparktab.llm.huffman import in_runs

SAMPLE_DOCS, SAMPLE_CHARS, TRAIN_RUNS = 1_500, 50_000, 30_000
RUN = 32
CONTEXTS, PURITY = 4, 0.9
FEATURE_BITS = 18
PREFIXES = (3, 4, 5, 6)
STEPS, RATE, DECAY = 40, 0.4, 1e-4
TEXT_RUN = 4 << 20
THRESHOLD = 0.3
FLOOR = -12.0

FITTED = ["emission", "step", "line", "fixed"]
SCORED = "id long, score double, n_offending int, starts array<int>, ends array<int>"


@dataclass
class Model:
    """emission: a weight per hashed feature; step: scores of tag pairs [from, to]; line: slope and intercept of the
    calibration; fixed: the score if there was nothing to learn."""

    emission: np.ndarray
    step: np.ndarray
    line: tuple[float, float]
    fixed: float | None = None


class Tokens:
    """Tokens of several texts with their hashed features and the runs they are tagged in."""

    def __init__(self, text: pa.Array):
        self.data, self.offsets = words.buffer_of(text)
        lower = words.LOWER[self.data]
        self.starts, self.ends, self.first = words.spans(lower, self.offsets, words.ALNUM)
        rows = words.beginnings(lower, self.starts, self.ends, PREFIXES)
        self.features = np.empty(rows.shape, np.int32)
        for kind, row in enumerate(rows):  # row by row, for memory
            own = words.mix(row + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            self.features[kind] = own >> np.uint64(64 - FEATURE_BITS)
        self.word = rows[0].copy()
        self.of = words.text_of(self.first)
        place = np.arange(len(self.of)) - self.first[self.of]
        self.column = place % RUN
        self.row = np.cumsum((self.column == 0)) - 1
        self.n_runs = int(self.row[-1]) + 1 if len(self.row) else 0

    def laid_out(self, values: np.ndarray, empty: float) -> np.ndarray:
        """Values of the tokens as a table of runs."""
        out = np.full((self.n_runs, RUN), empty, values.dtype)
        out[self.row, self.column] = values
        return out


def forward_backward(emission: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs (rows) with the log-score of tag 1 at each place: the marginal of tag 1 at each place, the expected
    counts of tag pairs, and the log of the normaliser of each run."""
    n, size = emission.shape
    m = np.exp(step)
    up = np.exp(np.clip(emission, -30, 30))
    inside = np.arange(size)[None, :] < lengths[:, None]
    alpha = np.empty((size, 2, n))
    norm = np.zeros(n)
    a0, a1 = np.ones(n), up[:, 0]
    for t in range(size):
        if t:
            b0 = a0 * m[0, 0] + a1 * m[1, 0]
            b1 = (a0 * m[0, 1] + a1 * m[1, 1]) * up[:, t]
            a0, a1 = np.where(inside[:, t], b0, a0), np.where(inside[:, t], b1, a1)
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        norm += np.log(total)
        alpha[t, 0], alpha[t, 1] = a0, a1
    marginal = np.zeros((n, size))
    pairs = np.zeros((2, 2))
    z0, z1 = np.ones(n), np.ones(n)
    for t in range(size - 1, -1, -1):
        here = inside[:, t]
        p0, p1 = alpha[t, 0] * z0, alpha[t, 1] * z1
        total = p0 + p1
        marginal[:, t] = np.where(here, p1 / total, 0.0)
        if t:
            f0, f1 = z0, z1 * up[:, t]
            q = [alpha[t - 1, i] * m[i, j] * (f0, f1)[j] for i in (0, 1) for j in (0, 1)]
            whole = q[0] + q[1] + q[2] + q[3]
            for k in range(4):
                pairs[k // 2, k % 2] += (q[k] / whole)[here].sum()
            y0, y1 = m[0, 0] * f0 + m[0, 1] * f1, m[1, 0] * f0 + m[1, 1] * f1
            scale = y0 + y1
            z0, z1 = np.where(here, y0 / scale, z0), np.where(here, y1 / scale, z1)
    return marginal, pairs, norm


def token_labels(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """1 for the tokens of toxic documents that have a feature which marks toxic tokens."""
    size = 1 << FEATURE_BITS
    n = len(tokens.of)
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:], after[:-1] = tokens.word[:-1], tokens.word[1:]
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[1:], last[:-1] = tokens.of[1:] != tokens.of[:-1], tokens.of[1:] != tokens.of[:-1]
    before[first], after[last] = 0, 0
    context = words.mix(before * np.uint64(0xD1342543DE82EF95) + after) >> np.uint64(32)
    bad = toxic[tokens.of] > 0
    marks = np.zeros((len(tokens.features), n), bool)
    for kind, feature in enumerate(tokens.features):
        counts = []
        for side in (bad, ~bad):
            seen = np.unique(feature[side].astype(np.uint64) << np.uint64(32) | context[side])
            counts.append(np.bincount((seen >> np.uint64(32)).astype(np.int64), minlength=size))
        marking = (counts[0] >= CONTEXTS) & (counts[0] >= PURITY * (counts[0] + counts[1]))
        marks[kind] = marking[feature]
    return (marks.any(axis=0) & bad).astype(np.int8)


def fit(texts: list[str], toxic: list[int], clean_share: float) -> Model:
    """A model from whole documents and their labels. clean_share: documents that each clean one here stands for, over
    those that each toxic one stands for."""
    labels = np.array(toxic, np.int64)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(1 << FEATURE_BITS, np.float32), np.zeros((2, 2)), (0.0, 0.0), share)
    tokens = Tokens(pa.array(texts, pa.string()))
    tags = token_labels(tokens, labels)
    # all runs with a toxic token, and others by hash
    hot = np.zeros(tokens.n_runs, bool)
    hot[tokens.row[tags > 0]] = True
    rank = words.mix(np.arange(tokens.n_runs, dtype=np.uint64))
    order = np.lexsort((rank, ~hot))[:TRAIN_RUNS]
    chosen = np.full(tokens.n_runs, -1)
    chosen[np.sort(order)] = np.arange(len(order))
    mine = chosen[tokens.row] >= 0
    row, column, tag = chosen[tokens.row[mine]], tokens.column[mine], tags[mine]
    features = tokens.features[:, mine]
    lengths = np.bincount(row, minlength=len(order))
    table = np.zeros((len(order), RUN), np.int8)
    table[row, column] = tag
    both = np.zeros((2, 2))
    follows = column > 0
    np.add.at(both, (table[row[follows], column[follows] - 1], tag[follows]), 1)
    weights, step = np.zeros(1 << FEATURE_BITS), np.zeros((2, 2))
    bias = float(np.log((tag.sum() + 1) / len(tag)))
    moment = [np.zeros_like(weights), np.zeros_like(step), 0.0]
    for turn in range(STEPS):  # Adagrad on the log-likelihood
        emission = np.zeros((len(order), RUN))
        emission[row, column] = weights[features].sum(axis=0) + bias
        marginal, pairs, _ = forward_backward(emission, lengths, step)
        off = tag - marginal[row, column]
        slope = np.zeros_like(weights)
        for feature in features:
            slope += np.bincount(feature, off, minlength=len(weights))
        slope -= DECAY * len(order) * weights
        gradients = [slope, both - pairs, float(off.sum())]
        for k, g in enumerate(gradients):
            moment[k] = moment[k] + np.square(g)
        weights += RATE * gradients[0] / np.sqrt(moment[0] + 1e-8)
        step += 0.3 * RATE * gradients[1] / np.sqrt(moment[1] + 1e-8)
        bias += 0.3 * RATE * gradients[2] / np.sqrt(moment[2] + 1e-8)
    emission = weights.astype(np.float32)
    model = Model(np.append(emission, np.float32(bias)), step, (1.0, 0.0))
    most = strongest(tokens, marginals(tokens, model))
    return Model(model.emission, step, _calibrate(most, labels, clean_share))


def _calibrate(most: np.ndarray, labels: np.ndarray, clean_share: float) -> tuple[float, float]:
    """Weighted logistic regression of the label on the strongest marginal's log-odds, by Newton steps."""
    weight = np.where(labels > 0, 1.0, clean_share)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * most + b, -30, 30)))
        g = np.array([(weight * (labels - p) * most).sum() - 0.01 * (a - 1), (weight * (labels - p)).sum() - 0.01 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * most * most).sum() + 0.01, (v * most).sum()], [(v * most).sum(), v.sum() + 0.01]])
        move = np.linalg.solve(h, g)
        move = np.clip(move, -1, 1)
        a, b = max(a + move[0], 0.05), b + move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(a), float(b)


def marginals(tokens: Tokens, model: Model) -> np.ndarray:
    """Each token's marginal of tag 1."""
    if not tokens.n_runs:
        return np.zeros(0)
    emission = model.emission[tokens.features].sum(axis=0, dtype=np.float64) + float(model.emission[-1])
    lengths = np.bincount(tokens.row, minlength=tokens.n_runs)
    table, _, _ = forward_backward(tokens.laid_out(emission, 0.0), lengths, model.step)
    return table[tokens.row, tokens.column]


def strongest(tokens: Tokens, marginal: np.ndarray) -> np.ndarray:
    """Of each document the log-odds of its largest marginal, FLOOR at least."""
    most = np.full(len(tokens.first) - 1, 0.0)
    np.maximum.at(most, tokens.of, marginal)
    most = np.clip(most, 1e-9, 1 - 1e-9)
    return np.clip(np.log(most) - np.log1p(-most), FLOOR, -FLOOR)


def learns(id_col: Column) -> Column:
    """True for documents that labels may be learned from: crc32 of the id's decimal text, modulo 4, is not 2."""
    return F.crc32(id_col.cast("long").cast("string").cast("binary")) % 4 != 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits in one task, on at most SAMPLE_DOCS different texts of each label and SAMPLE_CHARS characters a text; the
    driver gets the weights only."""
    rows = blocks.documents(docs, id_col, text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learns(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # drawn from what can be used: labelled documents that exist, short enough, one of each text
    short = rows.where(F.length("text") <= SAMPLE_CHARS).select("id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(5), "text").alias("b"))
    usable = short.join(known, "id").groupBy("a", "b").agg(F.min(F.struct("id", "toxic")).alias("r")).select("r.*")
    drawn = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS) for y in (0, 1)]
    sample = rows.join(F.broadcast(drawn[0].unionByName(drawn[1])), "id").where(F.length("text") <= SAMPLE_CHARS)

    def run(batches):
        held = list(batches)
        table = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("text", "ascending")]) if held else None
        toxic = table.column("toxic").to_pylist() if table else []
        stand = [share.get(y, 0) / max(1, toxic.count(y)) for y in (0, 1)]
        model = fit(table.column("text").to_pylist() if table else [], toxic, stand[0] / stand[1] if stand[1] else 1.0)
        columns = [[model.emission.astype("<f4").tobytes()], [model.step.ravel().tolist()], [list(model.line)], [model.fixed]]
        types = [pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], FITTED)

    # a bounded sample: at most 2 * SAMPLE_DOCS texts, unless rows repeat with their id
    one = sample.dropDuplicates(["id", "text"]).select("id", "text", "toxic").repartition(1)
    row = one.mapInArrow(run, "emission binary, step array<double>, line array<double>, fixed double").first()
    if row is None:
        return fit([], [], 1.0)
    return Model(np.frombuffer(row["emission"], "<f4"), np.array(row["step"]).reshape(2, 2), tuple(row["line"]), row["fixed"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score, and its offending tokens: number, character offsets [start, end)."""

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            text = text.fill_null("") if text.null_count else text
            for low, high in in_runs(np.diff(words.buffer_of(text)[1]).tolist(), TEXT_RUN):
                tokens = Tokens(text[low:high])
                marginal = marginals(tokens, model)
                if model.fixed is None:
                    slope, level = model.line
                    scores = 1 / (1 + np.exp(-np.clip(slope * strongest(tokens, marginal) + level, -30, 30)))
                else:
                    scores = np.full(high - low, model.fixed)
                hits = np.flatnonzero(marginal >= 0.5)
                cuts = np.searchsorted(tokens.of[hits], np.arange(high - low + 1))
                starts, ends = [], []
                for i in range(high - low):
                    own = hits[cuts[i] : cuts[i + 1]]
                    if not len(own):
                        starts.append([])
                        ends.append([])
                        continue
                    base = tokens.offsets[i]
                    char = np.cumsum((tokens.data[base : tokens.offsets[i + 1]] & 0xC0) != 0x80)
                    starts.append((char[tokens.starts[own] - base] - 1).tolist())
                    ends.append(char[tokens.ends[own] - base - 1].tolist())
                columns = [
                    batch.column("id")[low:high],
                    pa.array(scores),
                    pa.array(np.diff(cuts), pa.int32()),
                    pa.array(starts, pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")])

    return blocks.documents(docs, id_col, text_col).mapInArrow(run, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns and scores: id, held_out, score, predicted, and the offending tokens."""
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    held_out = F.coalesce(~learns(F.col("id")), F.lit(False))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "n_offending", "starts", "ends")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns. The score travels with the row, so
    nothing is joined."""
    model = train(docs, labels, id_col, text_col)
    rest = [c for c in docs.columns]
    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*rest).alias("row"))

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            text = text.fill_null("") if text.null_count else text
            for low, high in in_runs(np.diff(words.buffer_of(text)[1]).tolist(), TEXT_RUN):
                if model.fixed is None:
                    tokens = Tokens(text[low:high])
                    most = strongest(tokens, marginals(tokens, model))
                    scores = 1 / (1 + np.exp(-np.clip(model.line[0] * most + model.line[1], -30, 30)))
                else:
                    scores = np.full(high - low, model.fixed)
                kept = batch.column("row").slice(low, high - low).filter(pa.array(scores < THRESHOLD))
                yield pa.RecordBatch.from_arrays([kept], ["row"])

    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField("row", packed.schema["row"].dataType)])
    return packed.mapInArrow(run, schema).select("row.*")
