"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled to three transducers, which are composed with each text:

* normaliser: white space becomes the meta symbol, one is put before the text, and the
  model's switches for extra white space hold; identity otherwise;
* pieces: an arc for every piece that the model can make, found through a table of all
  their beginnings or ends, with a weight;
* byte fallback: for a character that no piece covers, an arc for each of its bytes.

The encoding is the path of least weight in the tropical semiring (min, +). For a unigram
model an arc weighs the negative score of its piece. For a BPE model a path is right if and
only if no two neighbouring pieces would have been merged differently, so the states carry
the last piece, and an arc weighs zero if the pair is stable and infinity if not: exactly
one path of finite weight remains, the merges' own result. Whether a pair is stable follows
from the order of merges along the right edge of the left piece and the left edge of the
right piece. Runs of meta symbols, whose pieces share one rank in BPE models, are an arc of
their own, taken greedily from the left as the merges do.

A text is composed word by word, since no piece holds a meta symbol after another character.
The distinct words of a run of texts are composed together, place by place, as numpy arrays;
long words, runs of meta symbols and the words of unigram models one by one. A word is walked in time linear in its length. Nothing is kept
from run to run but whether pairs of pieces are stable, in a table of fixed size.

Defined cases: a null or empty text has no pieces; a null id is kept; rows that repeat are
documents of their own; an empty table gives an empty result; other columns are ignored.
Model files whose normaliser has a character map are refused.
"""

from __future__ import annotations

import codecs
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparktab.llm import blocks, words
from sparktab.llm.huffman import in_runs

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE_PAIRS, RUN_CACHED = 100_000, 256
TEXT_RUN = 2 << 20
#: Words longer than LONG are composed alone, others WORD_RUN at a time; JUDGED_BITS: of the places of judged pairs.
LONG, WORD_RUN, JUDGED_BITS = 64, 1 << 15, 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
FAR = float("inf")

ENCODED = "id long, n_pieces long, ids array<int>, decoded string, round_trip boolean"


def _fields(raw: bytes):
    """(number, value) of each field of a serialised message."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = varint() if wire == 2 else {5: 4, 1: 8}[wire]
            yield key >> 3, raw[i : i + size]
            i += size


class Model:
    """What a model file says: pieces with score and type, algorithm, and the normaliser's switches."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.algorithm, self.fallback = UNIGRAM, False
        self.prefix, self.squeeze, self.escape, self.suffix_meta = True, True, True, False
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                self.algorithm = trainer.get(3, UNIGRAM)
                self.fallback = bool(trainer.get(35, 0))
                self.suffix_meta = bool(trainer.get(24, 0))
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("a normaliser with a character map is not supported")
                self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        if self.suffix_meta or not self.escape:
            raise ValueError("models that put white space last or keep it as it is are not supported")
        if any(kind == USER for *_, kind in self.pieces):
            raise ValueError("user-defined symbols are not supported")


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """A place for each key among 2**bits."""
    return (keys.astype(np.uint64) * _ODD >> np.uint64(64 - bits)).astype(np.int64)


class Lookup:
    """A table from distinct keys to numbers, asked for many keys at once; -1 stands for keys that it does not hold. Keys
    whose place is taken are in a table of their own."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, len(keys).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        self.crowded = np.zeros(1 << self.bits, bool)
        slots = _slots(keys, self.bits)
        first = np.unique(slots, return_index=True)[1]
        self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
        rest = np.ones(len(keys), bool)
        rest[first] = False
        self.crowded[slots[rest]] = True
        self.rest = Lookup(keys[rest], values[rest]) if rest.any() else None

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = _slots(keys, self.bits)
        same = self.keys[slots] == keys
        out = np.where(same, self.values[slots], -1)
        if self.rest:
            more = np.flatnonzero(self.crowded[slots] & ~same)
            if len(more):
                out[more] = self.rest(keys[more])
        return out


class Transducer:
    """A compiled model. ids_of() and texts_of() work on many texts, decode() on one."""

    def __init__(self, model: Model):
        self.model = model
        self.bpe = model.algorithm == BPE
        self.text_of = [p for p, *_ in model.pieces]
        self.kind_of = [k for *_, k in model.pieces]
        self.unknown = next((i for i, k in enumerate(self.kind_of) if k == UNKNOWN), 0)
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model.pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.number = {p: i for i, (p, _, k) in enumerate(model.pieces) if k == NORMAL}
        self.score = [s for _, s, _ in model.pieces]
        self.least = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0)
        self.pairs: dict[int, bool] = {}
        arcs = dict(self.number)
        if self.bpe:
            self.edges = self._derive()
            arcs = {p: i for p, i in self.number.items() if i in self.edges}
        self.arcs: dict[str, int] = {}
        for piece, i in arcs.items():
            if len(piece) > 1 and set(piece) == {META} and self.bpe:
                continue  # runs have arcs of their own
            for j in range(1, len(piece)):  # a table of the beginnings of pieces, or of their ends for BPE
                self.arcs.setdefault(piece[j:] if self.bpe else piece[:j], -1)
            self.arcs[piece] = i
        self.composed: tuple[str, list[int], list[int]] = ("", [-1], [-1])
        self.runs: dict[int, list[int]] = {}  # pieces of short runs of meta symbols
        self.run_pieces = {len(p): i for p, i in self.number.items() if set(p) == {META}}
        self._tabulate()

    def _tabulate(self) -> None:
        """The tables for many words and ids at once: symbols are the characters of pieces, states the ends of pieces (the
        first one of none), found by the symbol before; the bytes of each piece, and those it has at the start of a text."""
        if self.bpe:
            ends = [p for p in self.arcs if len(p) > 1]
            symbols = sorted(set("".join(self.arcs)))
            self.n_symbols = len(symbols) + 1
            self.symbol_of = np.zeros(0x110000, np.int32)  # 0: in no piece
            self.symbol_of[[ord(c) for c in symbols]] = np.arange(1, self.n_symbols)
            self.symbol_of[0x20] = self.symbol_of[ord(META)]  # a space stands for it in the arrays
            state = {p: k for k, p in enumerate(self.arcs, 1)}
            self.piece_of = np.array([-1, *self.arcs.values()], np.int32)
            self.first = np.array([0, *(state.get(c, 0) for c in symbols)], np.int32)
            keys = np.array([state[p[1:]] * self.n_symbols + int(self.symbol_of[ord(p[0])]) for p in ends], np.int64)
            self.longer = Lookup(keys, np.array([state[p] for p in ends], np.int32))
            self.judged = np.full((2, 1 << JUDGED_BITS), -1, np.int64)  # pairs, and in the last bit whether they are stable
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.text_of)]
        self.controls = np.array([k == CONTROL for k in self.kind_of], bool)
        self.raw = pa.array(raw + [r.removeprefix(META.encode()) for r in raw], pa.large_binary())

    # --- order of merges

    def _merge(self, symbols: list[str]) -> tuple[list[str], list[tuple[float, int]]]:
        """Merges a short list of symbols by rank, leftmost first; the merges made, as (rank, place)."""
        made = []
        while True:
            best, at = FAR, -1
            for i in range(len(symbols) - 1):
                piece = self.number.get(symbols[i] + symbols[i + 1])
                if piece is not None and -self.score[piece] < best:
                    best, at = -self.score[piece], i
            if at < 0:
                return symbols, made
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
            made.append((best, at))

    def _derive(self) -> dict[int, tuple]:
        """For each piece that merges make: its left and right edge, as (part, made at, used up at) from the whole to
        the outermost character."""
        split: dict[int, tuple[str, str] | None] = {}
        for piece, i in self.number.items():
            if len(piece) == 1:
                split[i] = None
                continue
            symbols, made = self._merge(list(piece))
            if len(symbols) == 1:
                before = self._until_last(list(piece), made)
                split[i] = (before[0], before[1])
        edges = {}
        for i in split:
            left, right = [], []
            for side, out in ((0, left), (1, right)):
                part, until = i, FAR
                while True:
                    born = -FAR if split.get(part) is None else -self.score[part]
                    out.append((self.text_of[part], born, until))
                    if split.get(part) is None:
                        break
                    until, part = born, self.number.get(split[part][side], -1)
                    if part < 0:  # a character that is not a piece of its own
                        out.append((split_side, -FAR, until)) if (split_side := self._outer(out[-1][0], side)) else None
                        break
            edges[i] = (tuple(left), tuple(right))
        return edges

    def _until_last(self, symbols, made):
        for _, at in made[:-1]:
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    @staticmethod
    def _outer(text: str, side: int) -> str:
        return text[0] if side == 0 else text[-1]

    def stable(self, left: int, right: int) -> bool:
        """True if merging the text of both pieces leaves the border between them."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stable(left, right)
        return known

    def _stable(self, left: int, right: int) -> bool:
        for a, a_born, a_until in self.edges[left][1]:
            for b, b_born, b_until in self.edges[right][0]:
                if a_born >= b_until or b_born >= a_until:
                    continue  # never there together
                piece = self.number.get(a + b)
                if piece is None:
                    continue
                rank = -self.score[piece]
                # of equal ranks the one further left goes first: the left part's own merge, but not the right part's
                if rank < a_until and rank <= b_until:
                    return False
        return True

    # --- composition

    def normalise(self, text: str) -> str:
        text = text.replace(" ", META)
        if self.model.squeeze:
            text = META.join(x for x in text.split(META) if x)
        return META + text if self.model.prefix and text else text

    def _fallback(self, char: str) -> list[int]:
        if self.model.fallback:
            return [self.byte_id[b] for b in char.encode("utf-8")]
        return [self.unknown]

    def path(self, word: str) -> list[int]:
        """The least path through a word."""
        return self._stable_path(word) if self.bpe else self._light_path(word)

    def _stable_path(self, word: str) -> list[int]:
        """With weights of zero and infinity: each place is reached by one path only, which depends on the text before
        it alone. So the places that a word shares with the word composed before are taken over."""
        n = len(word)
        before, last, back = self.composed
        same = 0
        for a, b in zip(word, before):
            if a != b:
                break
            same += 1
        del last[same + 1 :], back[same + 1 :]
        arc, pairs, stable = self.arcs.get, self.pairs.get, self.stable
        for j in range(same + 1, n + 1):
            found, at = -1, j - 1  # if no piece ends here: a character without a piece of its own
            for i in range(j - 1, -1, -1):
                piece = arc(word[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    here = last[i]
                    if here >= 0:
                        fits = pairs(here << 20 | piece)
                        if not (stable(here, piece) if fits is None else fits):
                            continue
                    found, at = piece, i
                    break
            last.append(found)
            back.append(at)
        self.composed = word, last, back
        return self._trace(word, last, back)

    def _trace(self, word: str, last: list[int], back: list[int]) -> list[int]:
        out: list[int] = []
        j = len(word)
        while j:
            i = back[j]
            if last[j] >= 0:
                out.append(last[j])
            else:
                out.extend(reversed(self._fallback(word[i])))
            j = i
        return out[::-1]

    def _light_path(self, word: str) -> list[int]:
        n = len(word)
        arcs = self.arcs
        best = [FAR] * (n + 1)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == FAR:
                continue
            cost = best[i]
            covered = False
            for j in range(i + 1, n + 1):
                piece = arcs.get(word[i:j])
                if piece is None:
                    break
                if piece < 0:
                    continue
                covered = covered or j == i + 1
                weight = cost - self.score[piece]
                if weight < best[j]:
                    best[j], last[j], back[j] = weight, piece, i
            if not covered:  # no piece for this character alone: its bytes, or the unknown piece
                weight = cost + 10.0 - self.least
                if weight < best[i + 1]:
                    best[i + 1], last[i + 1], back[i + 1] = weight, -1, i
        return self._trace(word, last, back)

    def word(self, word: str) -> list[int]:
        if not self.bpe:
            return self.path(word)
        body = word.lstrip(META)
        run = len(word) - len(body)
        if run <= 1:
            return self.path(word) if word else []
        ids = self.path(META + body) if body else []
        alone = self.number.get(META)
        if not body or ids[0] == alone:  # the last meta symbol stayed single and belongs to the run
            return self._run(run) + ids[1:]
        return self._run(run - 1) + ids

    def _run(self, n: int) -> list[int]:
        """A run of meta symbols, merged from the left; in linear time, since a merge concerns only its neighbours."""
        if META not in self.number:
            return self._fallback(META) * n
        if n > RUN_CACHED:
            return self._merged_run(n)
        if n not in self.runs:
            self.runs[n] = self._merged_run(n)
        return self.runs[n]

    def _merged_run(self, n: int) -> list[int]:
        pieces = self.run_pieces
        out = []  # lengths of merged symbols; none of these can merge with its neighbour
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in pieces:
                last = out.pop()
                out[-1] += last
        return [pieces[k] for k in out]

    # --- many words at once

    def _judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """stable() of many pairs; nothing on the left (-1) is stable."""
        keys = left.astype(np.int64) << 20 | right
        held = self.judged[0][_slots(keys, JUDGED_BITS)]
        other = np.flatnonzero(held >> 1 != keys)
        if len(other):
            held[other] = self.judged[1][_slots(~keys[other], JUDGED_BITS)]
            new = other[held[other] >> 1 != keys[other]]
            if len(new):
                unknown, place = np.unique(keys[new], return_inverse=True)
                fits = np.fromiter((k < 0 or self._stable(k >> 20, k & 0xFFFFF) for k in unknown.tolist()), bool, len(unknown))
                judged = unknown << 1 | fits
                held[new] = judged[place]
                slots = _slots(unknown, JUDGED_BITS)
                free = self.judged[0][slots] == -1
                self.judged[0][slots[free]] = judged[free]
                self.judged[1][_slots(~unknown[~free], JUDGED_BITS)] = judged[~free]
        return (held & 1).astype(bool)

    def _stable_paths(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_stable_path() of words whose characters stand end to end: all pieces, and how many each word has."""
        symbols = self.symbol_of[points]
        order = np.argsort(-sizes, kind="stable")
        start, longest_first = (np.cumsum(sizes) - sizes)[order], -sizes[order]
        last, width = np.full(len(symbols), -1, np.int32), np.ones(len(symbols), np.int64)
        for j in range(-int(longest_first[0])):
            end = start[: np.searchsorted(longest_first, -j)] + j  # the place in all words that have it
            state = self.first[symbols[end]]
            for d in range(j + 1):
                piece = self.piece_of[state]
                fits = piece >= 0
                if d < j:
                    some = np.flatnonzero(fits)
                    fits[some] = self._judge(last[end[some] - d - 1], piece[some])
                last[end[fits]], width[end[fits]] = piece[fits], d + 1
                end, state = end[~fits], state[~fits]
                if d == j or not len(end):
                    break
                state = self.longer(state.astype(np.int64) * self.n_symbols + symbols[end - d - 1])
                end, state = end[state >= 0], state[state >= 0]
        taken = np.zeros(len(symbols), bool)
        at = start - longest_first - 1
        while len(at):
            taken[at] = True
            at = at - width[at]
            inside = at >= start
            at, start = at[inside], start[inside]
        ids, n = last[taken], np.ones(len(points), np.int64)
        if (ids < 0).any():
            chars, which = np.unique(points[taken][ids < 0], return_inverse=True)
            pieces = [self._fallback(META if c == 0x20 else chr(c)) for c in chars.tolist()]
            n[np.flatnonzero(taken)[ids < 0]] = np.array([len(p) for p in pieces])[which]
            ids = np.repeat(ids, n[taken])
            ids[ids < 0] = list(chain.from_iterable(pieces[k] for k in which.tolist()))
        return ids, np.add.reduceat(n * taken, np.cumsum(sizes) - sizes)

    def _paths(self, found: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of distinct words with spaces for meta symbols: a pool, and each word's first place and number."""
        data, offsets = words.buffer_of(found)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        first, sizes = chars[:-1], np.diff(chars)
        in_a_run = (sizes > 1) & (points[first] == 0x20) & (points[np.minimum(first + 1, len(points) - 1)] == 0x20)
        plain = (sizes <= LONG) & ~in_a_run & self.bpe
        pool, place, n = [], np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        total = 0
        for low in range(0, len(sizes), WORD_RUN):
            mine, size = plain[low : low + WORD_RUN], sizes[low : low + WORD_RUN]
            if mine.any():
                ids, counts = self._stable_paths(points[chars[low] : chars[low] + size.sum()][np.repeat(mine, size)], size[mine])
                at = np.flatnonzero(mine) + low
                place[at], n[at] = total + np.cumsum(counts) - counts, counts
                pool.append(ids)
                total += len(ids)
        rest = np.flatnonzero(~plain)
        alone = sorted((data[offsets[k] : offsets[k + 1]].tobytes().decode().replace(" ", META), k) for k in rest.tolist())
        for word, k in alone:
            ids = self.word(word)
            place[k], n[k] = total, len(ids)
            pool.append(np.array(ids, np.int32))
            total += len(ids)
        return np.concatenate(pool), place, n

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts, end to end, and how many each text has. Texts are as spaced() gives them."""
        if self.model.squeeze:
            texts = pa.array([" ".join(x for x in t.split(" ") if x) for t in texts.to_pylist()], pa.large_string())
        if self.model.prefix:
            empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
            texts = pc.if_else(pc.equal(texts, empty), empty, pc.binary_join_element_wise(space, texts, empty))
        data, offsets = words.buffer_of(texts)
        starts = data == 0x20
        starts[1:] &= data[:-1] != 0x20
        starts[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(starts)
        borders = [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), borders).dictionary_encode()
        pool, place, size = self._paths(found.dictionary)
        word = found.indices.to_numpy()
        n, first = size[word], place[word]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(upto[-1]) + np.repeat(first - upto[:-1], n)]
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The pieces of each text."""
        ids, counts = self.ids_of(spaced(pa.array(texts, pa.large_string())))
        return [ids[upto - n : upto].tolist() for n, upto in zip(counts, np.cumsum(counts))]

    def texts_of(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """decode() of sequences that stand end to end: their bytes side by side, if these are valid."""
        upto = np.concatenate([[0], np.cumsum(counts)])
        if META in self.number and not self.controls[ids].any():
            at = ids.astype(np.int64)
            if self.model.prefix:
                at[upto[:-1][counts > 0]] += len(self.text_of)
            raw = self.raw.take(pa.array(at))
            data, offsets = words.buffer_of(raw)
            joined = [None, pa.py_buffer(offsets[upto]), pa.py_buffer(data)]
            try:
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), joined).cast(pa.large_string())
                return pc.replace_substring(texts, META, " ")
            except pa.ArrowInvalid:
                pass
        return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(upto, upto[1:])], pa.large_string())

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of pieces; bytes that are no valid UTF-8 become replacement characters."""
        byte_of, text_of = self.byte_of, self.text_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join([text_of[i] for i in ids if self.kind_of[i] != CONTROL])
        else:
            parts, held = [], bytearray()
            for i in ids:
                byte = byte_of.get(i)
                if byte is not None:
                    held.append(byte)
                    continue
                if held:
                    parts.append(_lenient(bytes(held)))
                    held = bytearray()
                if self.kind_of[i] != CONTROL:
                    parts.append(text_of[i])
            if held:
                parts.append(_lenient(bytes(held)))
            text = "".join(parts)
        return (text[1:] if self.model.prefix and text[:1] == META else text).replace(META, " ")


def _one_byte(wrong: UnicodeError) -> tuple[str, int]:
    return "\ufffd", wrong.start + 1


codecs.register_error("sparktab.one_byte", _one_byte)


def _lenient(raw: bytes) -> str:
    """Each byte that belongs to no valid character is one replacement character."""
    return raw.decode("utf-8", "sparktab.one_byte")


_COMPILED: dict[int, Transducer] = {}


def compiled(raw: bytes) -> Transducer:
    """The transducer of a model file, compiled once in each worker."""
    key = zlib.crc32(raw)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(Model(raw))
    return _COMPILED[key]


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with spaces for meta symbols, which no encoding tells apart."""
    return pc.replace_substring(texts.cast(pa.large_string()), META, " ")


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_pieces, ids, their decoded text, and whether that is the text again (with meta
    symbols read as spaces)."""

    def run(batches):
        fst = compiled(model)
        for batch in batches:
            text = batch.column("text")
            text = text.fill_null("") if text.null_count else text
            for low, high in in_runs(np.diff(words.buffer_of(text)[1]).tolist(), TEXT_RUN):
                texts = spaced(text[low:high])
                ids, counts = fst.ids_of(texts)
                decoded = fst.texts_of(ids, counts)
                upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = [
                    batch.column("id")[low:high],
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(upto), pa.array(ids, pa.int32())),
                    decoded.cast(pa.string()),
                    pc.equal(decoded, texts),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_pieces", "ids", "decoded", "round_trip"])

    return blocks.documents(docs, id_col, text_col).mapInArrow(run, ENCODED)
