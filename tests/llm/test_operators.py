"""Every operator against a brute-force version, on small tables with odd cases."""

import collections
import hashlib
import math
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparktab.llm import (
    blocks,
    crf,
    exact_dedup,
    host_suffix,
    huffman,
    interpolated_lm,
    license_diagonals,
    order_minhash,
    piece_fst,
    positional_index,
    rlz_dedup,
    words,
)

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("id", StringType()), StructField("block", LongType())])


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 400, n))


def texts():
    base = sentence(1, 120)
    edited = base.split()
    edited[50] = "changed"
    passage = sentence(2, 30)
    rows = [(i, base) for i in range(5, 12)] + [(20, " ".join(edited)), (21, sentence(3, 90) + "\n" + passage), (22, passage + " " + sentence(4, 60))]
    rows += [(30, None), (31, ""), (32, "  \t\n"), (33, "Ünï cödé ☃ 日本語 x"), (34, "MIT License, the mit\tlicense; GNU General Public License")]
    rows += [(40, sentence(5, 3)), (40, sentence(5, 3)), (None, base), (None, None), (50, sentence(6, 20_000)), (51, "x" * 5000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_words_match_patterns():
    some = [t or "" for _, t in texts()] + ["a", " a", "a ", "é", "\x1c\x1f"]
    data, offsets = words.buffer_of(pa.array(some))
    for table, pattern in ((words.SPACED, SPACED), (words.ALNUM, ALNUM)):
        lower = words.LOWER[data] if pattern is ALNUM else data
        starts, ends, first = words.spans(lower, offsets, table)
        found = [lower[s:e].tobytes().decode() for s, e in zip(starts, ends)]
        expected = [pattern.findall(t.translate(LOWER) if pattern is ALNUM else t) for t in some]
        assert found == [w for e in expected for w in e]
        assert np.diff(first).tolist() == [len(e) for e in expected]
        hashed = words.hashes(lower, starts, ends)
        assert len(set(hashed.tolist())) == len(set(found))
        assert {w: h for w, h in zip(found, hashed.tolist())} == dict(zip(found, hashed.tolist()))
    assert words.within(np.array([0, 3, 3, 5]), 2).tolist() == [0, 1, 3]


def test_narrow_round_trip():
    for values in ([], [0], [1, 255, 256, 1 << 40], [(1 << 64) - 1]):
        array = np.array(values, np.uint64)
        assert words.widen(words.narrow(array), len(array)).tolist() == values


def test_interpolated_lm(docs, empty):
    got = interpolated_lm.score(docs)
    token = {(i, t): SPACED.findall((t or "").translate(LOWER)) + ["\n"] for i, t in texts()}
    counts = collections.Counter()
    for i, t in texts():
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            counts.update(token[i, t])
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (repr(i), len(token[i, t]), sum(counts[w] > 0 for w in token[i, t]), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in token[i, t]), 4)) for i, t in texts()
    )
    found = got.collect()
    assert sorted((repr(r.id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in found) == expected
    assert {(r.train_tokens, r.vocabulary) for r in found} == {(n, v)}
    assert all(r.score <= 0 for r in found) and sum(r.score for r in found) > sum(r.base_score for r in found)
    assert interpolated_lm.score(empty).collect() == []


def test_interpolated_lm_weights_are_the_maximum():
    cells = {3 * interpolated_lm.BINS: 50, 3 * interpolated_lm.BINS + 1 + int((2 + interpolated_lm.LOW_POWER) * interpolated_lm.STEPS): 50}
    weight = interpolated_lm.learn_weights(cells, 1.0)[3]
    ratio = 2.0 ** (2 + 0.5 / interpolated_lm.STEPS)
    likelihood = lambda w: 50 * math.log(1 - w) + 50 * math.log(1 - w + w * ratio)
    assert likelihood(weight) >= max(likelihood(w / 200) for w in range(200)) - 1e-3


def test_licenses(docs, empty):
    found = license_diagonals.licenses(docs).collect()
    assert len(found) == len(texts())
    one = next(r for r in found if r.id == 34)
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels) == (9, 3, 0, 6, "gpl,mit")
    assert all(r.n_base == 0 and r.base_labels == "" and r.score == 0 for r in found if r.id not in (34,))
    assert license_diagonals.licenses(empty).collect() == []


def test_license_template_with_inserted_words(spark):
    text = "some words Permission is hereby granted, free of extra charge, to any person obtaining a copy of this software and associated documentation files and so on"
    (found,) = license_diagonals.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert found.labels == "mit" and found.base_labels == "" and found.n_base == 0 and 0.8 <= found.score <= 1


def test_exact_groups(docs, empty):
    groups = collections.defaultdict(list)
    for i, t in texts():
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = sorted(((i, top[t or ""], len(groups[t or ""]), i == top[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts()), key=repr)
    assert rows_of(exact_dedup.exact_groups(docs)) == expected
    assert exact_dedup.exact_groups(empty).collect() == []
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.schema == docs.schema
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(x) for x in top.values())


def test_huffman_files(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(huffman, "PART_BYTES", 2000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        source = file.read()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    found = huffman.round_trip(docs, source).orderBy("start").collect()
    assert [r.id for r in found] == sorted((i for i, _ in texts()), key=lambda x: (x is not None, x))
    expected = collections.Counter((i, zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for i, t in texts())
    assert collections.Counter((r.id, r.ids_crc32) for r in found) == expected
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    assert huffman.round_trip(empty, source).collect() == []


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = (rng.pareto(0.6, 300) * 10).astype(np.int64)
    free, limited = huffman.code_lengths(counts, 60), huffman.code_lengths(counts, 10)
    used = counts > 0
    for lengths in (free, limited):
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1.0 and not lengths[~used].any()
    assert limited.max() <= 10 and (counts * free).sum() <= (counts * limited).sum()
    heap = sorted(counts[used].tolist())
    cost = 0
    while len(heap) > 1:
        pair = heap[0] + heap[1]
        cost, heap = cost + pair, sorted([*heap[2:], pair])
    assert cost == (counts * free).sum()
    codes = huffman.canonical(limited)
    ids = rng.choice(np.flatnonzero(used), 1000)
    packed, _, offset = huffman.pack_bits(ids, np.array([1000]), limited, codes)
    marks = offset[::100]
    assert (huffman.unpack_bits(packed, marks, np.full(10, 100), huffman.decode_table(limited)) == ids).all()


@pytest.mark.parametrize("piece", ["  a", "a  b", " \n x", "x y z", "tail ", "\0 a b", "", "don't 've 3rd\t\t x"])
def test_pieces_keep_the_tokenizers_ids(piece):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = huffman.encoder_of(file.read())
    whole = np.array(encoder.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder([piece]) == [whole] and "".join(encoder.split(piece)) == piece


def test_kept_pieces_give_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(huffman, "CACHE_PIECES", 50)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = huffman.PieceEncoder(file.read())
    rng = np.random.default_rng(7)
    parts = ["a", "B", "é", "²", "7", " ", "  ", "\n", ".", ",", "'s", "<|endoftext|>", "_", "\0", "\u3000", "日"]
    made = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    for low in range(0, len(made), 300):
        whole = encoder.tokenizer.encode_batch(made[low : low + 300], add_special_tokens=False)
        assert encoder(made[low : low + 300]) == [np.array(x.ids, "<u4").tobytes() for x in whole]


def test_new_pieces_go_through_the_library_together():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = huffman.PieceEncoder(file.read())
    library, given = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    rng = np.random.default_rng(8)
    parts = ["pas", "Été", "ç", "×", "÷", "3", "!!", ".", ",", ":", "$", " ", " ", "\n", "\n\n", "\t", "'ll", "\u00a0", "\u2003x", "\u201cq", "e\u0301", "\r\n", "日本", "<|endoftext|>"]
    made = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(4000)]
    made += [f"w{i:x} " + "".join(chr(97 + i // 26**k % 26) for k in range(3)) + ".\nÈp" for i in range(2000)]
    for low in range(0, len(made), 500):
        ids, counts = encoder.ids_of(pa.array(made[low : low + 500]))
        wanted = [x.ids for x in library.encode_batch(made[low : low + 500], add_special_tokens=False)]
        assert ids.tolist() == [i for x in wanted for i in x] and counts.tolist() == [len(x) for x in wanted]
    given.clear()
    encoder(["one two.\nThree; four"] * 2 + [f" new{i}" for i in range(1000)])
    assert len(given) <= 5
    assert encoder.split("a pas.\nÈp, x  y") == ["a", " pas", ".\n", "Èp", ",", " x ", " y"]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    emission, step = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    total, ones, pairs = 0.0, np.zeros(4), np.zeros((2, 2))
    for code in range(16):
        tags = [code >> k & 1 for k in range(4)]
        weight = math.exp(sum(e * t for e, t in zip(emission[0], tags)) + sum(step[a, b] for a, b in zip(tags, tags[1:])))
        total += weight
        ones += weight * np.array(tags)
        for a, b in zip(tags, tags[1:]):
            pairs[a, b] += weight
    marginal, expected, norm = crf.forward_backward(emission, np.array([4]), step)
    assert np.allclose(marginal[0], ones / total) and np.allclose(expected, pairs / total) and np.isclose(norm[0], math.log(total))


def test_toxicity_learns_words_and_beginnings(spark, empty):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = sentence(1000 + i, 60).split()
        if bad:
            text.insert(int(rng.integers(0, 60)), rng.choice(["vile", f"snarl{i}"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows.append((None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.id: r for r in crf.toxicity(docs, known).collect()}
    held = [r for r in found.values() if r.held_out]
    assert {r.id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == (r.id % 4 == 0) for r in held]) > 0.95
    hit = next(r for r in held if r.predicted)
    assert any(rows[hit.id][1][s:e] == "vile" or rows[hit.id][1][s:e].startswith("snarl") for s, e in zip(hit.starts, hit.ends))
    assert found[None].predicted == 0
    kept = crf.drop_toxic(docs, known)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.predicted}
    assert crf.toxicity(empty, known.limit(0)).collect() == []


def test_positional_index(spark, docs, empty, monkeypatch):
    items = spark.createDataFrame([(1, sentence(2, 30)), (2, "MIT license"), (3, None), (4, "..."), (5, sentence(6, 20_000)[:900])], "item_id long, text string")
    windows = collections.defaultdict(set)
    for r in items.collect():
        w = ALNUM.findall((r.text or "").translate(LOWER))
        for j in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[j : j + 13])].add(str(r.item_id))
    expected = []
    for i, t in texts():
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in windows:
                    found |= windows[tuple(w[j : j + size])]
                    hit[j : j + size] = [True] * size
        expected.append((i, len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    assert rows_of(positional_index.contamination(docs, items)) == sorted(expected, key=repr)
    monkeypatch.setattr(positional_index, "PHRASE_WORDS", 50)
    assert rows_of(positional_index.contamination(docs, items)) == sorted(expected, key=repr)
    assert positional_index.contamination(empty, items).collect() == []
    assert all(r.n_hit == 0 for r in positional_index.contamination(docs, items.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "b x a y c"), (2, "a b"), (3, "a " + "z " * 40 + "b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    found = positional_index.find_near(positional_index.build_index(docs), items, slop=6)
    assert {r.id for r in found.collect() if r["items"]} == {1}


def test_rlz_factors(docs, empty):
    first = {}
    rank = lambda i: -math.inf if i is None else i
    split = [(i, SPACED.findall(t or "")) for i, t in texts()]
    for i, w in split:
        for j in range(len(w) - 12):
            key = tuple(w[j : j + 13])
            first[key] = min(first.get(key, math.inf), rank(i))
    expected = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < rank(i):
                gone[j : j + 13] = [True] * 13
        expected.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = rlz_dedup.duplicate_spans(docs)
    assert rows_of(got.select("id", "n_words", "n_removed", "kept")) == sorted(expected, key=repr)
    assert all(sum(e - s for s, e in zip(r.factor_starts, r.factor_ends)) == r.n_removed for r in got.collect())
    assert rlz_dedup.duplicate_spans(empty).collect() == []


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def test_piece_paths_equal_the_library(docs, empty, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = np.random.default_rng(5)
    alphabet = list(" ▁abtheingr日本é☃\t\nß😀|.,<>/s0x9")
    some = ["".join(rng.choice(alphabet, rng.integers(0, 15))) for _ in range(2000)] + [" " * n + "a" for n in range(40)]
    fst = piece_fst.compiled(model)
    ids = fst.encode(some)
    assert ids == library.encode(some, num_threads=1)
    assert [fst.decode(x) for x in ids] == library.decode(ids)
    random = [rng.integers(3, 400, 5).tolist() for _ in range(500)]
    assert [fst.decode(x) for x in random] == [library.decode(x) for x in random]
    found = piece_fst.encode(docs, model).collect()
    assert collections.Counter((r.id, tuple(r.ids)) for r in found) == collections.Counter((i, tuple(library.encode(t or ""))) for i, t in texts())
    assert all(r.round_trip for r in found) and piece_fst.encode(empty, model).collect() == []


def test_pieces_of_many_words_keep_nothing(model):
    """Words of all kinds composed together give the library's ids, and what an encoder holds does not grow with them."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = np.random.default_rng(8)
    alphabet = list("aeinrstuhdlc\né日😀▁,")
    words_ = ["".join(rng.choice(alphabet, n)) for n in rng.integers(1, 12, 60_000)] + ["".join(rng.choice(alphabet[:12], n)) for n in (63, 64, 65, 300)]
    some = [(" " * (k % 4 + 1)).join(words_[k : k + 100]) for k in range(0, len(words_), 100)] + ["", " ", "\n", "😀"]
    fst = piece_fst.Transducer(piece_fst.Model(model))
    fst.encode(some[:100])
    tracemalloc.start()
    ids, counts = fst.ids_of(piece_fst.spaced(pa.array(some, pa.large_string())))
    decoded = fst.texts_of(ids, counts).to_pylist()
    expected = library.encode(some, num_threads=1)
    assert ids.tolist() == [x for e in expected for x in e] and counts.tolist() == [len(e) for e in expected]
    assert decoded == [fst.decode(e) for e in expected] == [t.replace(piece_fst.META, " ") for t in some]
    del ids, counts, decoded, expected
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 2 << 20


def test_unigram_paths_are_the_lightest():
    model = piece_fst.Model(b"")
    model.pieces = [("<unk>", 0.0, piece_fst.UNKNOWN)] + [(p, s, piece_fst.NORMAL) for p, s in (("▁", -2.0), ("a", -1.5), ("b", -2.5), ("ab", -2.2), ("▁a", -2.0), ("ba", -3.9))]
    fst = piece_fst.Transducer(model)
    scores = {p: s for p, s, _ in model.pieces[1:]}

    def best(word):
        cuts = [(0.0, [])] + [None] * len(word)
        for j in range(1, len(word) + 1):
            cuts[j] = max((cuts[i][0] + scores[word[i:j]], [*cuts[i][1], word[i:j]]) for i in range(j) if word[i:j] in scores and cuts[i])
        return cuts[-1]

    for word in ("▁abab", "▁ba", "▁aab", "▁bbba"):
        path = [fst.text_of[i] for i in fst.path(word)]
        assert "".join(path) == word and math.isclose(sum(scores[p] for p in path), best(word)[0])


def test_near_duplicates(docs, empty):
    found = {r.id: r for r in order_minhash.near_duplicates(docs).collect() if r.id is not None}
    assert {i for i, r in found.items() if r.class_id == 5} == {*range(5, 12), 20}
    assert found[5].kept and not found[20].kept and found[21].class_id == 21 and found[40].class_size == 2
    assert found[30].class_id == found[31].class_id == 30 and found[32].class_id == 32
    kept = order_minhash.drop_near_copies(docs)
    assert kept.schema == docs.schema and order_minhash.near_duplicates(empty).collect() == []


def test_near_duplicates_of_one_cluster_and_a_shared_passage(spark):
    base, passage = sentence(9, 150).split(), sentence(10, 60)
    rows = []
    for i in range(60):
        copy = list(base)
        copy[2 * i] = f"new{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, passage + " " + sentence(200 + i, 60)) for i in range(60)]
    found = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in found if r.id < 100} == {0}
    assert len({r.class_id for r in found if r.id >= 100}) == 60


def test_near_duplicates_lose_no_link_of_a_run(spark):
    """Copies around the limit: every pair that shares a band and aligns is in one class, and no class has more."""
    rng = np.random.default_rng(11)
    base, rows = sentence(12, 120).split(), []
    for i in range(150):
        copy = list(base)
        for at in rng.choice(len(base), int(rng.integers(0, 6)), replace=False):
            copy[at] = f"w{i}x{at}"
        rows.append((i, " ".join(copy)))
    found = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seqs, keys = [], []
    for _, text in rows:
        own = order_minhash._word_hashes(pa.array([text]))[0]
        seqs.append((order_minhash.shingles(own) >> np.uint64(32)).astype(np.uint32))
        keys.append(set(order_minhash.sketch(order_minhash.labelled(order_minhash.shingles(own)))[0].tolist()))
    edges = [(i, j) for i in range(150) for j in range(i) if keys[i] & keys[j] and order_minhash.aligned(seqs[i], seqs[j])]
    least = list(range(150))
    for _ in least:
        for i, j in edges:
            least[i] = least[j] = min(least[i], least[j])
    assert {r.id: r.class_id for r in found} == dict(enumerate(least)) and len(set(least)) > 1


def test_candidates_of_runs_cut_at_a_border(spark):
    """Neighbours of a run stay joined however the partitions cut it."""
    rows = [(k * 10 + i, k * 10 + i, [k]) for k, n in enumerate([2, 3, 1, 9, 2, 2, 5]) for i in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 2, 5, 12, 24):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = order_minhash.candidates(spark.createDataFrame(rows, "node long, near long, keys array<long>")).collect()
            pairs = {(r.a, r.b) for r in got}
            assert {(i, i + 1) for i, _, _ in rows if (i + 1, i + 1, [i // 10]) in rows} <= pairs
            assert all(a < b and a // 10 == b // 10 for a, b in pairs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_near_duplicates_of_short_texts(spark):
    """Texts of 5 to 60 words against edited copies: all aligned pairs of at most 8 shingles are found, and nearly all others."""
    rng, rows = np.random.default_rng(21), []
    for n in range(5, 61):
        for k in range(4):
            base = sentence(1000 * n + k, n).split()
            spare = (n - 4) // 4
            head, cut, foot = rng.integers(0, max(2, spare // 2 + 1), 3)
            copies = [base, base[1:], base[:-1], ["extra", *base], [*base, "extra"], [*["extra"] * head, *base[cut:], *["extra"] * foot]]
            swapped = list(base)
            swapped[int(rng.integers(0, n))] = "other"
            rows += [(len(rows) + i, " ".join(c)) for i, c in enumerate([*copies, swapped]) if c]
    found = {r.id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    group = {}
    seqs = []
    for i, text in rows:
        seqs.append((order_minhash.shingles(order_minhash._word_hashes(pa.array([text]))[0]) >> np.uint64(32)).astype(np.uint32))
        for x in set(seqs[-1].tolist()):
            group.setdefault(x, []).append(i)
    pairs = {(a, b) for g in group.values() for a in g for b in g if a < b}
    links = [(a, b) for a, b in pairs if order_minhash.aligned(seqs[a], seqs[b])]
    lost = [(a, b) for a, b in links if found[a] != found[b]]
    assert [(a, b) for a, b in lost if max(len(seqs[a]), len(seqs[b])) <= order_minhash.TAKE] == []
    assert len(links) > 1000 and len(lost) <= 0.001 * len(links)
    keys = [set(order_minhash.keys_of(order_minhash.shingles(order_minhash._word_hashes(pa.array([t]))[0]))[0].tolist()) for _, t in rows]
    missed = [(a, b) for a, b in links if not keys[a] & keys[b]]
    assert len(missed) <= 0.001 * len(links)


def test_alignment_equals_longest_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = rng.integers(0, 30, rng.integers(5, 40)).astype(np.uint32)
        y = np.array([v for v in x if rng.random() > 0.05] + [99] * int(rng.integers(0, 3)), np.uint32)
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (a == b))
        m = table[-1, -1]
        alike = m / (len(x) + len(y) - m)
        assert order_minhash.aligned(x, y) == (pytest.approx(alike) if alike >= 0.8 else 0.0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    found = {r.node: r["class"] for r in order_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_components_from_known_classes(spark):
    """Classes found before count as links: further ones merge them, none leaves them."""
    old, new = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (30, 31), (5, 5)]
    known = order_minhash.components(spark.createDataFrame(old, "a long, b long"))
    found = {r.node: r["class"] for r in order_minhash.components(spark.createDataFrame(new, "a long, b long"), known).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 30, 31: 30}
    none = order_minhash.components(spark.createDataFrame([(4, 4)], "a long, b long"), known)
    assert {r.node: r["class"] for r in none.collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 20}


def test_main_text(spark):
    menu = "Home News Sport Weather Travel Culture Science Contact us today"
    plain = [(i, f"https://www.a.org/{i}", f"<div>{menu}</div><p>page{i} says x{i}</p><p>{menu} again</p>") for i in range(6)]
    article = """<html><head><title>T</title><script>var t="</article><p>no";</script></head><body><nav>menu</nav><header>top</header>
        <article><h1>A &amp; B</h1><p>one<b> two</b><br>three <p>four&nbsp;5 &lt;x&gt;<div class="ad">buy</div><div id=comments><p>hi</div>
        <ul><li>six<li>seven</ul></article><aside>side</aside><footer>end</footer></body>"""
    rows = [*plain, (10, "http://b.org", article), (11, None, None), (12, "odd", ""), (None, "http://c.org/", "<p>a</p><p class='cookie-notice'>ok</p>")]
    found = {r.page_id: r for r in host_suffix.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3].text == "page3 says x3"  # the last word ends a run of eight that all pages share
    assert found[10].text == "A & B\none two three\nfour 5 <x>\nsix\nseven" and found[10].n_chars == len(found[10].text)
    assert found[11].text == found[12].text == "" and found[None].text == "a" and len(found) == len(rows)
    assert host_suffix.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_main_text_with_repeats_inside_and_copies(spark):
    """Lines and passages that articles of a host share stay, however many do; copies of a page prove nothing."""
    line, passage = sentence(71, 12), sentence(72, 30)
    body = lambda i: f"<article><p>{sentence(500 + i, 40)}</p>" + (f"<p>{passage}</p>" if i < 6 else "") + f"<p>{line}</p></article>"
    rows = [(i, f"http://a.org/{i}", body(i)) for i in range(14)]
    rows += [(100 + i, f"http://b.org/{i}", body(3)) for i in range(14)]  # one text, many rows
    rows += [(200 + i, f"http://c.org/{i}", f"<p>{sentence(73, 40)}</p>") for i in range(5)]  # copies without markup
    found = {r.page_id: r.text for r in host_suffix.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(14)] == ["\n".join([sentence(500 + i, 40)] + [passage] * (i < 6) + [line]) for i in range(14)]
    assert {found[100 + i] for i in range(14)} == {"\n".join([sentence(503, 40), passage, line])}
    assert {found[200 + i] for i in range(5)} == {sentence(73, 40)} and len(found) == len(rows)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="with-sidebar"><article><p>text</article></div>', "text"),
        ('<div class="content-nav sidebar"><article><p>text</article></div><p>other', "text"),
        ('<div class="search"><main><p>text</main></div>', "text"),
        ('<article class="post comments-open"><p>text</article>', "text"),
        ('<article><section id="related-work"><h2 id="search">head</h2><p class="notice">text</section></article>', "head|text"),
        ('<article><p>text<div class="social-share">x</div></article><div class="comments"><article>y<article>z</article></article></div>', "text"),
        ('<article><p>text<section id="comments"><article class="comment">x</article><article>y</article></section></article>', "text"),
        ('<main><article class="search"><p>text</article></main>', "text"),
        ('<main><p>text<div class="related">x</div></main><div class="site-footer">y</div>', "text"),
    ],
)
def test_marks_lose_no_article(page, text):
    assert "|".join(t for t, kind in host_suffix.page_blocks(page) if kind == host_suffix.KEPT) == text


def test_prefix_groups_equal_sorted_suffixes():
    rng = np.random.default_rng(6)
    tokens, page = rng.integers(0, 3, 200).astype(np.uint64), np.repeat([1, 2, 3, 4], 50)
    order, group = host_suffix.prefix_groups(tokens, page, 5)
    starts = [i for i in range(196) if page[i] == page[i + 4]]
    assert sorted(order.tolist()) == starts
    key = {i: tuple(tokens[i : i + 5]) for i in starts}
    assert [key[i] for i in order] == sorted(key.values())
    assert all((key[a] == key[b]) == (g == h) for a, b, g, h in zip(order, order[1:], group, group[1:]))


def test_blocks_share_the_shuffle(docs):
    rows = blocks.documents(docs, "doc_id", "text")
    plan = rlz_dedup.duplicate_spans(docs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert blocks.sizes(rows)[0] == len(texts())


def test_invalid_bytes_are_replaced_one_by_one():
    assert piece_fst._lenient(b"\xff" * 200_000) == "�" * 200_000
    assert piece_fst._lenient("aé☃".encode() + b"\xe2\x98" + b"z\x80") == "aé☃��z�"


def test_broken_markup_takes_linear_time():
    """Tags without an end, unclosed quotes and deep nesting: seconds would be hours if each looked to the page's end."""
    for part in ("<a ", "<a", "<!", '<a "', "<a '\"", "<div>", "<script></script ", "<main class=ad>"):
        for tail in ("", '">', ">", "</p>" * 50_000):
            started = time.monotonic()
            host_suffix.page_blocks(part * 100_000 + tail)
            assert time.monotonic() - started < 20
    assert host_suffix.page_blocks("<p>a <b <!-- x") == [("a <b", 0)]
    assert host_suffix.page_blocks("<p>1 < 2 <i x='>y</p>") == [("1 < 2 <i x='>y", 0)]


def test_runs_of_spaces():
    """The merges of a run, leftmost first, whatever lengths are pieces; a million spaces are no matter."""

    def by_definition(n, pieces):
        symbols, at = [1] * n, 0
        while at >= 0:
            at = next((i for i in range(len(symbols) - 1) if symbols[i] + symbols[i + 1] in pieces), -1)
            if at >= 0:
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    for lengths in ((1,), (1, 2), (1, 2, 3, 4, 8, 16), (1, 2, 4, 8), (1, 2, 3, 5, 6), (1, 3)):
        model = piece_fst.Model(b"")
        model.algorithm = piece_fst.BPE
        model.pieces = [("<unk>", 0.0, piece_fst.UNKNOWN)] + [(piece_fst.META * k, -1.0, piece_fst.NORMAL) for k in lengths]
        fst = piece_fst.Transducer(model)
        for n in (1, 2, 3, 5, 17, 100, 300):
            assert [len(fst.text_of[i]) for i in fst._run(n)] == by_definition(n, lengths)
        assert sum(len(fst.text_of[i]) for i in fst._run(1_000_000)) == 1_000_000


def test_marks_joined_to_places():
    for name in ("ad", "ad-slot", "user-comments", "comments-section", "related-posts", "share-bar", "site-footer", "newsletter_form"):
        assert host_suffix.is_mark(name)
        inside = f"<article><p>a</p><div class='{name}'><p>b</p></div><p>c</p></article>"
        assert [t for t, kind in host_suffix.page_blocks(inside) if kind == host_suffix.KEPT] == ["a", "c"]
    for name in ("section-header", "with-sidebar", "related-work", "post-section", "social-section", "top", "article", "notice-period", "adverb"):
        assert not host_suffix.is_mark(name)
