"""Token ids in files of canonical, length-limited Huffman codes.

write_ids() encodes every text with a tokenizer, counts the ids over all documents, builds
one code for all (package-merge, at most MAX_BITS a code) and writes the documents in
ascending id order. A file row is a block of documents that can be decoded alone: their
ids, id counts and byte sizes, the code bits, and checkpoints, the bit offset of every
STRIDE-th id of a document. read_ids() decodes a block by table: all its checkpoints are
independent streams, decoded in step with one table look-up for each id.

The code is a list of code lengths, one byte for each id of the vocabulary, kept in a file
row of its own beside the blocks. The driver sees the counts by id and the id bounds of the
parts; both are bounded by the vocabulary and the number of parts, not by the documents.

Defined cases: a null text is an empty text and has only the end id; null ids come first;
rows that repeat are documents of their own, in any order among themselves; an empty table
gives empty files; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm import blocks, words
from sparktab.session import scratch_path

MAX_BITS = 18
STRIDE = 128
END_ID = 0
PART_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
CACHE_PIECES = 400_000
TEXT_RUN, ID_RUN = 2 << 20, 1 << 18

IDS = "id long, n int, ids binary"
CODED = "part int, id long, n int, marks binary, code binary"
FILE = "part int, block int, first_token long, ids array<long>, n array<int>, sizes array<int>, marks binary, code binary"

#: Characters beyond ASCII that may be white space: their bytes as one number, and the first of these bytes.
_WHITE = np.array([int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big") for c in range(0x80, 0x10000) if chr(c).isspace() or c in (0x180E, 0x200B)])
_LEADS = np.isin(np.arange(256), _WHITE >> 16)
#: Letters of ASCII, and marks that end a run of letters without joining it.
_LETTERS = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_MARKS = np.isin(np.arange(256), list(b".,!?;:%$"))
#: Pieces that are encoded end to end.
CHAIN = 256


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start in texts that stand end to end, always where the tokenizer's own split starts one: at every text
    that is not empty, a space before anything but white space, a mark after a letter, a letter after a lone line feed."""
    starts = np.zeros(len(data), bool)
    if not len(data):
        return np.flatnonzero(starts)
    starts[:-1] = (data[:-1] == 0x20) & (data[1:] > 0x20)
    doubtful = np.flatnonzero(starts[:-1] & _LEADS[data[1:]])
    if len(doubtful):
        lead, second, third = (data[np.minimum(doubtful + i, len(data) - 1)].astype(np.int64) for i in (1, 2, 3))
        starts[doubtful] = ~np.isin(lead << 16 | second << 8 | np.where(lead < 0xE0, 0, third), _WHITE)
    # the bytes C3 80 to C3 BF are letters but for two signs
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter_before = _LETTERS[data[:-1]]
    letter_before[1:] |= latin[:-1]
    starts[1:] |= _MARKS[data[1:]] & letter_before
    lone = (data[1:-1] == 0x0A) & (data[:-2] > 0x20) & (data[:-2] < 0x7F)
    starts[2:] |= lone & (_LETTERS[data[2:]] | (data[2:] == 0xC3))
    filled = offsets[1:] > offsets[:-1]
    ends = offsets[1:][filled] - 1
    starts[ends] &= data[ends] != 0x20
    starts[offsets[:-1][filled]] = True
    return np.flatnonzero(starts)


class PieceEncoder:
    """Ids of texts, piece by piece through the tokenizers library; the ids of recent pieces are kept."""

    def __init__(self, tokenizer_json: str):
        # A task has one core; threads of the library's own would only compete with other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.known: dict[bytes, bytes] = {}  # of recent pieces; older: of those before
        self.older: dict[bytes, bytes] = {}
        # Bytes of text that an id stands for: the model writes each byte as one character.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        sizes = {i: len(token) for token, i in vocabulary.items()}
        sizes |= {i: len(token.content.encode()) for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.sizes = np.zeros(max(sizes, default=-1) + 1, np.int64)
        self.sizes[list(sizes)] = list(sizes.values())

    @staticmethod
    def split(text: str) -> list[str]:
        """The pieces of a text."""
        raw = text.encode()
        starts = piece_starts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return [raw[low:high].decode() for low, high in zip(starts, [*starts[1:], len(raw)])]

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces that start with a space before anything but white space remain the library's own pieces when they stand
        end to end, others that start with no white space do so behind a line feed; the bytes of the tokens tell where each
        one ends. The rest is encoded one by one."""
        chained, alone = [], []
        for p in pieces:
            first = p[1:2] if p[0] == 0x20 else p[:1]
            (chained if first > b" " and not _LEADS[first[0]] else alone).append(p)
        for low in range(0, len(chained), CHAIN):
            some = chained[low : low + CHAIN]
            fed = np.fromiter((p[0] != 0x20 for p in some), bool, len(some))
            text = b"".join([p if p[0] == 0x20 else b"\n" + p for p in some]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + fed)
            upto = np.searchsorted(ends, wanted) + 1
            first = np.concatenate([[0], upto[:-1]])
            if ends[-1:] != wanted[-1:] or (ends[upto - 1] != wanted).any() or (self.sizes[ids[first[fed]]] != 1).any():
                alone += some
                continue
            raw = ids.tobytes()
            self.known.update((p, raw[a:b]) for p, a, b in zip(some, (4 * (first + fed)).tolist(), (4 * upto).tolist()))
        for low in range(0, len(alone), CHAIN):
            some = alone[low : low + CHAIN]
            for piece, coded in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)):
                self.known[piece] = np.array(coded.ids, "<u4").tobytes()

    def _packed(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces; kept ones that are used again count as recent."""
        if len(self.known) > CACHE_PIECES:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        fresh = [p for p in pieces if p not in known]
        known.update((p, older[p]) for p in fresh if p in older)
        self._learn([p for p in fresh if p not in older] if older else fresh)
        return list(map(known.__getitem__, pieces))

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each text has."""
        data, offsets = words.buffer_of(texts)
        starts = piece_starts(data, offsets)
        borders = [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), borders).dictionary_encode()
        packed = self._packed(pieces.dictionary.to_pylist())
        pool, size = np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        place = pieces.indices.to_numpy()
        n, first = size[place], (np.cumsum(size) - size)[place]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(upto[-1]) + np.repeat(first - upto[:-1], n)]
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit numbers."""
        ids, counts = self.ids_of(pa.array(texts, pa.large_string()))
        return [ids[high - n : high].tobytes() for n, high in zip(counts, np.cumsum(counts))]


_ENCODERS: dict[int, PieceEncoder] = {}


def encoder_of(tokenizer_json: str) -> PieceEncoder:
    """The encoder of a tokenizer, made once in each worker; later tasks find the pieces it knows."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(tokenizer_json)
    return _ENCODERS[key]


def in_runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to most, or single larger rows."""
    low, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield low, i
            low, held = i, 0
        held += size
    if low < len(sizes):
        yield low, len(sizes)


def encode(docs: DataFrame, tokenizer_json: str, id_col: str, text_col: str, end_id: int = END_ID) -> DataFrame:
    """Rows (id, n, ids): the ids of the text and the end id, packed."""

    def run(batches):
        encoder = encoder_of(tokenizer_json)
        for batch in batches:
            text = batch.column("text")
            text = text.fill_null("") if text.null_count else text
            for low, high in in_runs(np.diff(words.buffer_of(text)[1]).tolist(), TEXT_RUN):
                ids, counts = encoder.ids_of(text[low:high])
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                packed = [ids[upto - n : upto] for n, upto in zip(counts, np.cumsum(counts))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[low:high],
                        pa.array([len(x) for x in packed], pa.int32()),
                        pa.array([words.narrow(x) for x in packed], pa.binary()),
                    ],
                    ["id", "n", "ids"],
                )

    return blocks.documents(docs, id_col, text_col).mapInArrow(run, IDS)


def id_counts(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for low, high in in_runs(batch.column("n").to_pylist(), ID_RUN):
                some = zip(batch.column("n")[low:high].to_pylist(), batch.column("ids")[low:high].to_pylist())
                total += np.bincount(np.concatenate([words.widen(ids, n) for n, ids in some]).astype(np.int64), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    sums = encoded.select("n", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    total = np.zeros(vocabulary, np.int64)
    for row in sums.toLocalIterator():
        total[row["token"]] = row["n"]
    return total


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits for the ids that occur, 0 for the others (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    is_symbol = []
    level = weight
    flags = np.ones(len(weight), bool)
    for _ in range(max_bits - 1):
        is_symbol.append(flags)
        pairs = len(level) // 2
        packages = level[0 : 2 * pairs : 2] + level[1 : 2 * pairs : 2]
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        level, flags = both[rank], rank < len(weight)
    is_symbol.append(flags)
    take, bits = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for flags in reversed(is_symbol):
        symbols = int(flags[:take].sum())
        bits[:symbols] += 1
        take = 2 * (min(take, len(flags)) - symbols)
    lengths[order] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: ascending by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        bits = int(lengths[symbol])
        if bits:
            code = (code << (bits - before)) if before else 0
            codes[symbol] = code
            code, before = code + 1, bits
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every bit string of the longest code's size the id and length of the code it starts with."""
    width = int(lengths.max()) if len(lengths) and lengths.max() else 1
    symbols, sizes = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    order = [s for s in np.lexsort((np.arange(len(lengths)), lengths)).tolist() if lengths[s]]
    spread = 1 << (width - lengths[order].astype(np.int64))
    filled = int(spread.sum())
    symbols[:filled] = np.repeat(np.array(order, np.uint32), spread)
    sizes[:filled] = np.repeat(lengths[order], spread)
    return symbols, sizes, width


def pack_bits(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of documents end to end, each from a byte border on: bytes, byte size of each document, and for each id
    its bit offset in its document."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    last = np.cumsum(counts)
    doc_bits = ends[last - 1] - np.concatenate([[0], ends[last - 1][:-1]])
    sizes = (doc_bits + 7) // 8
    base = 8 * (np.cumsum(sizes) - sizes)
    offset = ends - bits - np.repeat(ends[last - 1] - doc_bits, counts)
    at = offset + np.repeat(base, counts)
    place = at >> 5
    value = codes[ids] << (64 - bits - (at & 31)).astype(np.uint64)
    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    total = np.add.reduceat(value, heads)
    out = np.zeros(int(place[-1]) + 2, np.uint64)
    out[place[heads]] = total >> np.uint64(32)
    out[place[heads] + 1] |= total & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").view(np.uint8)[: int(sizes.sum())], sizes, offset


def unpack_bits(code: np.ndarray, starts: np.ndarray, counts: np.ndarray, table) -> np.ndarray:
    """The ids of streams that start at bit offsets starts and hold counts ids each, one stream after the other."""
    symbols, sizes, width = table
    padded = np.concatenate([code, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(int(counts.sum()), np.uint32)
    to = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    at, to, left = starts[order].astype(np.int64), to[order], counts[order]
    mask = np.uint64((1 << width) - 1)
    for step in range(int(left[0]) if len(left) else 0):
        alive = int(np.searchsorted(-left, -step, side="left"))
        at, to = at[:alive], to[:alive]
        byte = at >> 3
        window = padded[byte] << np.uint64(24) | padded[byte + 1] << np.uint64(16) | padded[byte + 2] << np.uint64(8) | padded[byte + 3]
        window = window << np.uint64(8) | padded[byte + 4]
        entry = (window >> (40 - width - (at & 7)).astype(np.uint64)) & mask
        out[to + step] = symbols[entry]
        at = at + sizes[entry]
    return out


def write_ids(docs: DataFrame, tokenizer_json: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, max_bits: int = MAX_BITS) -> None:
    """Writes path/blocks and path/code."""
    import json

    spark = docs.sparkSession
    kept = blocks.staged(encode(docs, tokenizer_json, id_col, text_col, end_id), "token-ids")
    known = json.loads(tokenizer_json)
    named = [*known["model"]["vocab"].values(), *(t["id"] for t in known.get("added_tokens", [])), end_id]
    lengths = code_lengths(id_counts(kept, max(named) + 1), max_bits)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").write.parquet(f"{path}/code")
    stats = kept.agg(F.sum("n").alias("n"), F.count("id").alias("docs")).first()
    n_parts = max(1, -(-int(stats["n"] or 0) * 3 // 2 // PART_BYTES))
    cuts = [i / n_parts for i in range(1, n_parts)]
    found = kept.where("id is not null").approxQuantile("id", cuts, 1 / (8 * n_parts)) if cuts and stats["docs"] else []
    bounds = np.unique(np.array(found, np.float64))

    def run(batches):
        codes = canonical(lengths)
        for batch in batches:
            for low, high in in_runs(batch.column("n").to_pylist(), ID_RUN):
                counts = batch.column("n")[low:high].to_numpy().astype(np.int64)
                packed = batch.column("ids")[low:high].to_pylist()
                ids = np.concatenate([words.widen(x, n) for x, n in zip(packed, counts)]).astype(np.int64)
                code, sizes, offset = pack_bits(ids, counts, lengths, codes)
                upto, first = np.cumsum(sizes), np.cumsum(counts) - counts
                marks = [offset[f : f + n : STRIDE].astype("<u4").tobytes() for f, n in zip(first, counts)]
                doc = batch.column("id")[low:high]
                part = np.searchsorted(bounds, doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right")
                pieces = [code[e - s : e].tobytes() for s, e in zip(sizes, upto)]
                columns = [pa.array(part, pa.int32()), doc, pa.array(counts, pa.int32()), pa.array(marks, pa.binary()), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "id", "n", "marks", "code"])

    def pack(batches):
        part, block, token, held, size = None, 0, 0, [], 0

        def row():
            first, ids, n, marks, code = token, *zip(*held)
            values = [[part], [block], [first], [list(ids)], [list(n)], [[len(c) for c in code]], [b"".join(marks)], [b"".join(code)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], [x.split()[0] for x in FILE.split(", ")])

        for batch in batches:
            for p, i, n, m, c in zip(*(batch.column(x).to_pylist() for x in ("part", "id", "n", "marks", "code"))):
                if held and (p != part or size + len(c) > BLOCK_BYTES):
                    yield row()
                    block, token, held, size = block + 1, token + sum(x[1] for x in held), [], 0
                if p != part:
                    part, block, token = p, 0, 0
                held.append((i, n, m, c))
                size += len(c)
        if held:
            yield row()

    dealt = kept.mapInArrow(run, CODED).repartition(min(n_parts, blocks.MAX_PARTITIONS), "part").sortWithinPartitions("part", "id")
    dealt.mapInArrow(pack, FILE).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, of_document: Callable[[np.ndarray], object], kind: str, name: str) -> DataFrame:
    """One row per document in the files: id, start (ids before it), n_tokens, and what of_document makes of its ids."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()["lengths"], np.uint8)
    files = spark.read.schema(FILE).parquet(f"{path}/blocks")
    sums = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part], total = total, total + sums[part]

    def run(batches):
        table = decode_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                n, sizes = np.array(row["n"], np.int64), np.array(row["sizes"], np.int64)
                streams = -(-n // STRIDE)
                last = np.cumsum(streams) - 1
                counts = np.full(int(streams.sum()), STRIDE, np.int64)
                counts[last] = n - STRIDE * (streams - 1)
                starts = np.frombuffer(row["marks"], "<u4").astype(np.int64) + np.repeat(8 * (np.cumsum(sizes) - sizes), streams)
                ids = unpack_bits(np.frombuffer(row["code"], np.uint8), starts, counts, table)
                upto = np.cumsum(n)
                made = [of_document(ids[e - k : e]) for k, e in zip(n, upto)]
                start = before[row["part"]] + row["first_token"] + upto - n
                yield pa.RecordBatch.from_pydict({"id": pa.array(row["ids"], pa.int64()), "start": pa.array(start), "n_tokens": pa.array(n), name: made})

    return files.mapInArrow(run, f"id long, start long, n_tokens long, {name} {kind}")


def crc32_of(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def round_trip(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents and reads the files: id, start, n_tokens, ids_crc32."""
    path = scratch_path(docs.sparkSession, "huffman")
    write_ids(docs, tokenizer_json, path, id_col, text_col)
    return read_ids(docs.sparkSession, path, crc32_of, "long", "ids_crc32")
