"""Benchmark decontamination with a positional inverted index.

build_index() stores the postings of all training words: the documents are cut into blocks,
and a block's row holds its distinct terms (64-bit hashes) in order, for each term where
its positions begin, and the positions themselves. A position counts through the block,
with a gap after each document, so that no phrase crosses from one document to the next.
The index is partitioned by document: a block answers a phrase alone, without a shuffle.

find_phrases() intersects posting lists. Within a block it starts each phrase at its rarest
term, takes that list as candidate starts (offset by the term's place in the phrase), and
keeps the candidates that the next rarer terms' lists, offset likewise, contain. Terms are
compared as hashes, and a phrase with all its terms, so a false hit needs as many equal
hashes as the phrase has words. find_near() gives proximity matches: all terms of a phrase
within a span of words, in any order.

The phrases are a query set: they are read in blocks of at most PHRASE_WORDS words, each
sent to the tasks as one broadcast of bounded size.

Defined cases: null and empty texts have no words, on either side; a null id is kept as
null; rows that repeat are documents of their own; items that repeat with id are one item;
an item with a null id counts in hits and in the number of items, and as '' in the
checksum; empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm import blocks, words

PHRASE_WORDS = 2_000_000
BLOCK_BYTES = 2 << 20

INDEX = "ids array<long>, first_word array<int>, terms binary, begins binary, positions binary"


def _index_row(texts: pa.Table, gap: int) -> pa.RecordBatch:
    data, offsets = words.buffer_of(texts.column("text"))
    data = words.LOWER[data]
    starts, ends, first = words.spans(data, offsets, words.ALNUM)
    term = words.hashes(data, starts, ends)
    place = np.arange(len(term)) + gap * words.text_of(first)
    order = np.argsort(term, kind="stable")
    ranked = term[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([texts.column("id").to_pylist()], pa.list_(pa.int64())),
            pa.array([first.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([ranked[heads].astype("<u8").tobytes()], pa.binary()),
            pa.array([np.append(heads, len(ranked)).astype("<i4").tobytes()], pa.binary()),
            pa.array([place[order].astype("<i4").tobytes()], pa.binary()),
        ],
        ["ids", "first_word", "terms", "begins", "positions"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 64) -> DataFrame:
    """The stored index, a row per block of about BLOCK_BYTES of text. gap: longest phrase that may be looked up."""

    def run(batches):
        for batch in batches:
            sizes = np.diff(words.buffer_of(batch.column("text"))[1])
            low, held = 0, 0
            for i, size in enumerate(sizes.tolist()):
                if held and held + size > BLOCK_BYTES:
                    yield _index_row(pa.Table.from_batches([batch.slice(low, i - low)]), gap)
                    low, held = i, 0
                held += size
            if low < batch.num_rows:
                yield _index_row(pa.Table.from_batches([batch.slice(low)]), gap)

    return blocks.staged(blocks.documents(docs, id_col, text_col).mapInArrow(run, INDEX), "positions")


def phrase_blocks(items: DataFrame, id_col: str, text_col: str, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """The windows of k words of the items, in blocks: a matrix of term hashes (0 where a shorter item ends), the item
    number of each window, and the item ids."""
    matrix, of, ids, held = [], [], [], 0
    for row in items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        data, offsets = words.buffer_of(pa.array([row["text"]], pa.string()))
        data = words.LOWER[data]
        starts, ends, _ = words.spans(data, offsets, words.ALNUM)
        term = words.hashes(data, starts, ends)
        if not len(term):
            continue
        if len(term) < k:
            windows = np.zeros((1, k), np.uint64)
            windows[0, : len(term)] = term
        else:
            windows = np.lib.stride_tricks.sliding_window_view(term, k)
        windows = np.unique(windows, axis=0)
        matrix.append(windows)
        of.append(np.full(len(windows), len(ids)))
        ids.append(row["id"])
        held += windows.size
        if held >= PHRASE_WORDS:
            yield np.concatenate(matrix), np.concatenate(of), ids
            matrix, of, ids, held = [], [], [], 0
    if ids:
        yield np.concatenate(matrix), np.concatenate(of), ids


class _Postings:
    """A block's row of the index."""

    def __init__(self, terms: bytes, begins: bytes, positions: bytes):
        self.terms = np.frombuffer(terms, "<u8")
        self.begins = np.frombuffer(begins, "<i4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<i4").astype(np.int64)
        self.span = int(self.positions.max()) + 2 if len(self.positions) else 2
        # (term, position) as one ascending key: a list's members are found by one search
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.begins)) * self.span + self.positions

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term, -1 if the block doesn't have it."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.span + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (position >= 0) & (position < self.span)


def _exact(postings: _Postings, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase numbers and start positions of all occurrences."""
    length = (matrix != 0).sum(axis=1)
    number = postings.number(matrix)
    used = np.arange(matrix.shape[1])[None, :] < length[:, None]
    possible = np.flatnonzero(((number >= 0) | ~used).all(axis=1))
    if not len(possible):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, used = number[possible], used[possible]
    frequency = np.where(used, np.diff(postings.begins)[np.maximum(number, 0)], np.iinfo(np.int64).max)
    by_rarity = np.argsort(frequency, axis=1, kind="stable")
    rows = np.arange(len(possible))
    seed = by_rarity[:, 0]
    n = frequency[rows, seed]
    phrase = np.repeat(rows, n)
    within = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
    start = postings.positions[postings.begins[number[phrase, seed[phrase]]] + within] - seed[phrase]
    for turn in range(1, matrix.shape[1]):
        if not len(phrase):
            break
        place = by_rarity[phrase, turn]
        more = used[phrase, place]
        ok = ~more
        ok[more] = postings.has(number[phrase, place][more], (start + place)[more])
        phrase, start = phrase[ok], start[ok]
    return possible[phrase], start


def _near(postings: _Postings, matrix: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase numbers and positions of their rarest term around which all terms stand within slop words."""
    found, at = [], []
    for i, terms in enumerate(matrix):
        number = postings.number(np.unique(terms[terms != 0]))
        if (number < 0).any():
            continue
        lists = sorted((postings.positions[postings.begins[x] : postings.begins[x + 1]] for x in number), key=len)
        seed = lists[0]
        for other in lists[1:]:
            low = np.searchsorted(other, seed - slop)
            seed = seed[np.searchsorted(other, seed + slop, side="right") > low]
        found.append(np.full(len(seed), i))
        at.append(seed)
    return (np.concatenate(found), np.concatenate(at)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _rows_of(row: dict, gap: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.array(row["first_word"], np.int64)
    return first, first[:-1] + gap * np.arange(len(first) - 1)


def _matches(index: DataFrame, items: DataFrame, id_col: str, text_col: str, k: int, gap: int, slop: int | None) -> DataFrame:
    """One row per document and block of phrases: id, n_words, hit word ranges, items."""
    if k > gap:
        raise ValueError(f"a phrase of {k} words needs an index with a gap of as many words")
    sc = index.sparkSession.sparkContext
    item_type = items.schema[id_col].dataType
    names = ["row", "nth", "id", "n_words", "starts", "ends", "items"]
    schema = f"row long, nth int, id long, n_words int, starts array<int>, ends array<int>, items array<{item_type.simpleString()}>"
    frames = []
    numbered = index.select("*", F.monotonically_increasing_id().alias("row"))
    nothing = (np.zeros((0, k), np.uint64), np.zeros(0, np.int64), [])
    some = phrase_blocks(items, id_col, text_col, k)
    for block in chain([next(some, nothing)], some):
        sent = sc.broadcast(block)

        def run(batches, sent=sent):
            matrix, of, ids = sent.value
            length = (matrix != 0).sum(axis=1)
            for batch in batches:
                for row in batch.to_pylist():
                    first, base = _rows_of(row, gap)
                    n_words = np.diff(first)
                    postings = _Postings(row["terms"], row["begins"], row["positions"])
                    if slop is None:
                        phrase, start = _exact(postings, matrix)
                        end = start + length[phrase]
                    else:
                        phrase, start = _near(postings, matrix, slop)
                        end = start + 1
                    doc = np.searchsorted(base, start, side="right") - 1
                    order = np.argsort(doc, kind="stable")
                    phrase, start, end, doc = phrase[order], start[order], end[order], doc[order]
                    cuts = np.searchsorted(doc, np.arange(len(n_words) + 1))
                    out = []
                    for i, doc_id in enumerate(row["ids"]):
                        own = slice(cuts[i], cuts[i + 1])
                        if cuts[i] == cuts[i + 1]:
                            out.append((row["row"], i, doc_id, int(n_words[i]), [], [], []))
                            continue
                        hit = words.covered(int(n_words[i]), start[own] - base[i], end[own] - base[i])
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                        hits = [ids[x] for x in np.unique(of[phrase[own]]).tolist()]
                        out.append((row["row"], i, doc_id, int(n_words[i]), edge[::2].tolist(), edge[1::2].tolist(), hits))
                    columns = zip(*out) if out else [[]] * 7
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), None]
                    arrays = [pa.array(c, t) if t else pa.array(c, pa.list_(_arrow(item_type))) for c, t in zip(columns, types)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

        frames.append(numbered.mapInArrow(run, schema))
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged if len(frames) == 1 else _merge(merged)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _merge(rows: DataFrame) -> DataFrame:
    """The rows of one document from several blocks of phrases as one; ranges may then overlap."""
    return rows.groupBy("row", "nth", "id", "n_words").agg(
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def find_phrases(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 13, gap: int = 64) -> DataFrame:
    """One row per indexed document: id, n_words, ranges of words [start, end) that lie in an occurrence of k
    consecutive words of an item (of all its words if it has fewer), and the items with occurrences."""
    return _matches(index, items, id_col, text_col, k, gap, None).drop("row", "nth")


def find_near(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 13, slop: int = 32, gap: int = 64) -> DataFrame:
    """As find_phrases(), but for places of the rarest word around which all words of the window stand within slop
    words, in any order. gap of at least slop keeps documents apart."""
    if slop > gap:
        raise ValueError("the index's gap must be at least slop")
    return _matches(index, items, id_col, text_col, k, gap, slop).drop("row", "nth")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, items (distinct, as text), contaminated: at least one word in
    twenty lies in a benchmark phrase."""
    found = find_phrases(build_index(docs, id_col, text_col), items, k=k)
    places = F.arrays_zip("starts", "ends")
    n_hit = F.aggregate(
        F.array_sort(places),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(x["starts"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], x["ends"]).alias("upto"),
        ),
        lambda a: a["n"].cast("long"),
    )
    names = F.array_sort(F.array_distinct(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit("")))))
    rows = found.select("id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), names.alias("items"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns. Rows that share an id go together; rows
    without an id stay."""
    gone = contamination(docs, items, id_col, text_col).where("id is not null and contaminated").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
