"""License scans by diagonal voting.

Templates are license texts and phrases. All rolling word k-gram hashes of a document that
stand in some template are joined to the templates' positions; document position minus
template position is the diagonal a match lies on, and every joined pair is a vote for its
diagonal. Votes are counted per document, template and diagonal; neighbouring diagonals,
which inserted or deleted words cause, are merged to one span; spans with enough votes are
verified word by word against the template.

A template of at most K words uses k-grams of its whole length, so that a phrase matches
only in full; longer ones use K. The base phrases are templates themselves, matched exactly.
The hashes of the templates are a fixed list, so the scan keeps only what can join: one row
per document, with its text only if it has such hashes.

Defined cases: null and empty texts have no words; a null id is kept; rows that repeat are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktab.llm import blocks, words
from sparktab.llm.huffman import in_runs

K = 4
VOTES, ALIKE, GAP = 0.4, 0.8, 3
TEXT_RUN = 4 << 20

# The base phrases and their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Sentences of public licenses and of notices that name them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
]

SCANNED = "id long, n_words int, k array<int>, pos array<int>, hash array<long>, text string"
VERIFIED = "row long, template int, start int, end int, alike double"


def _words(text: str) -> np.ndarray:
    data = words.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words.spans(data, np.array([0, len(data)]), words.ALNUM)
    return words.hashes(data, starts, ends)


def templates(base: dict[str, str], more: list[tuple[str, str]]) -> list[dict]:
    """Templates in a fixed order: label, whether it is a base phrase, word hashes, gram size."""
    out = [{"label": label, "base": True, "words": _words(text)} for text, label in base.items()]
    out += [{"label": label, "base": False, "words": _words(text)} for label, text in more]
    for t in out:
        t["k"] = len(t["words"]) if t["base"] else min(K, len(t["words"]))
    return out


def scan(docs: DataFrame, known: list[dict], id_col: str, text_col: str) -> DataFrame:
    """One row per document: its words' number, its rolling hashes that stand in a template, and then its text."""
    wanted = {k: np.unique(np.concatenate([words.grams(t["words"], k) for t in known if t["k"] == k])) for k in {t["k"] for t in known}}

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            text = text.fill_null("") if text.null_count else text
            for low, high in in_runs(np.diff(words.buffer_of(text)[1]).tolist(), TEXT_RUN):
                part = text[low:high]
                data, offsets = words.buffer_of(part)
                data = words.LOWER[data]
                starts, ends, first = words.spans(data, offsets, words.ALNUM)
                word = words.hashes(data, starts, ends)
                found = []
                for k, hashes in wanted.items():
                    at = words.within(first, k)
                    gram = words.grams(word, k)[at]
                    near = np.minimum(np.searchsorted(hashes, gram), len(hashes) - 1)
                    hit = hashes[near] == gram
                    found.append((np.full(int(hit.sum()), k), at[hit], gram[hit]))
                size, at, gram = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(at, kind="stable")
                size, at, gram = size[order], at[order], gram[order]
                cuts = np.searchsorted(at, first)
                doc = np.searchsorted(first, at, side="right") - 1
                place = at - first[doc]
                offsets_of = pa.array(cuts, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets_of, pa.array(v, ty)) for v, ty in ((size, pa.int32()), (place, pa.int32()), (gram.view(np.int64), pa.int64()))]
                hits = np.diff(cuts) > 0
                texts = [t.as_py() if h else None for t, h in zip(part, hits)]
                columns = [batch.column("id")[low:high], pa.array(np.diff(first), pa.int32()), *lists, pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCANNED.split(", ")])

    return blocks.documents(docs, id_col, text_col).mapInArrow(run, SCANNED)


def template_positions(spark: SparkSession, known: list[dict]) -> DataFrame:
    rows = []
    for number, t in enumerate(known):
        for place, gram in enumerate(words.grams(t["words"], t["k"]).view(np.int64).tolist()):
            rows.append((t["k"], gram, number, place, len(t["words"])))
    return spark.createDataFrame(rows, "k int, hash long, template int, place int, size int")


def spans(scanned: DataFrame, known: list[dict]) -> DataFrame:
    """Candidate spans (row, template, start, end) with enough votes on neighbouring diagonals."""
    hits = scanned.where("text is not null").select("row", "n_words", F.inline(F.arrays_zip("k", "pos", "hash")))
    places = F.broadcast(template_positions(scanned.sparkSession, known))
    votes = hits.join(places, ["k", "hash"]).withColumn("diagonal", F.col("pos") - F.col("place"))
    # a passage may occur more than once on one diagonal only for another template position: a diagonal is one place
    diagonals = votes.groupBy("row", "template", "diagonal", "size", "k", "n_words").agg(F.countDistinct("place").alias("votes"))
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    grouped = diagonals.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(near) > GAP).cast("int")).withColumn(
        "part", F.sum(F.coalesce("new", F.lit(1))).over(near)
    )
    merged = grouped.groupBy("row", "template", "part", "size", "k", "n_words").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes")
    )
    enough = merged.where(F.col("votes") >= F.greatest(F.lit(1.0), VOTES * (F.col("size") - F.col("k") + 1)))
    start = F.greatest(F.lit(0), F.col("low"))
    end = F.least(F.col("n_words"), F.col("high") + F.col("size"))
    return enough.select("row", "template", start.alias("start"), end.alias("end"))


def verify(found: DataFrame, scanned: DataFrame, known: list[dict]) -> DataFrame:
    """The spans whose words agree with their template: in full for a base phrase, else at least ALIKE of its words in
    order."""
    from sparktab.llm.order_minhash import _banded

    places = found.groupBy("row").agg(F.collect_list(F.struct("template", "start", "end")).alias("found"))
    with_text = scanned.where("text is not null").select("row", "text").join(places, "row")

    def run(batches):
        for batch in batches:
            out = []
            for row, text, spans_of in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "found"))):
                word = _words(text)
                for s in spans_of:
                    t = known[s["template"]]
                    own = word[s["start"] : s["end"]]
                    size = len(t["words"])
                    if t["base"]:
                        ok, alike = len(own) == size and bool((own == t["words"]).all()), 1.0
                    else:
                        alike = _banded(t["words"].tolist(), own.tolist(), size) / size
                        ok = alike >= ALIKE
                    if ok:
                        out.append((row, s["template"], s["start"], s["end"], alike))
            columns = zip(*out) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in VERIFIED.split(", ")])

    return with_text.mapInArrow(run, VERIFIED)


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, more: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the spans
    as array<struct<label, start, end, alike>>."""
    known = templates(BASE if base is None else base, TEMPLATES if more is None else more)
    scanned = blocks.staged(scan(docs, known, id_col, text_col), "license-grams").withColumn("row", F.monotonically_increasing_id())
    labels = docs.sparkSession.createDataFrame([(i, t["label"], t["base"]) for i, t in enumerate(known)], "template int, label string, base boolean")
    # neighbouring base phrases may share a merged span: exact phrases are taken diagonal by diagonal
    exact = [i for i, t in enumerate(known) if t["base"]]
    hits = scanned.where("text is not null").select("row", F.inline(F.arrays_zip("k", "pos", "hash")))
    phrases = hits.join(F.broadcast(template_positions(docs.sparkSession, known).where(F.col("template").isin(exact))), ["k", "hash"])
    phrases = phrases.select("row", "template", F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end"))
    loose = spans(scanned, known).where(~F.col("template").isin(exact))
    found = verify(phrases.unionByName(loose), scanned, known).join(F.broadcast(labels), "template")
    per_row = found.groupBy("row").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start").cast("long"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("alike").alias("score"),
        F.array_sort(F.collect_set(F.struct("start", "end", "label", "alike"))).alias("spans"),
    )
    return scanned.select("row", "id", "n_words").join(per_row, "row", "left").select(
        "id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
