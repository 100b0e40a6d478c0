"""License scans by diagonal voting.

Every text's words are hashed whole. All rolling word k-grams are joined with the template positions that hold
the same k-gram, and hits are counted per offset diagonal (place in the text minus place in the template). A
phrase stands wherever all its k-grams vote for one diagonal. For notices, diagonals that lie next to each
other are merged, so that inserted or missing words do not split a match, and each merged span is verified:
its hits must form one chain that goes forward in text and template, the chain must hold enough of the
notice's words, each counted once, and the words that tell the notice from its relatives. Of verified spans
that overlap, the one with most words stays.

The template table has a fixed size, so the join broadcasts it and moves no text; only hits leave the scan.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import arrow_text, materialise, mix64, span_hashes, word_spans, word_table

# Fixed values of the contract: phrase -> label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The method's own templates: (label, text, words without which it does not count). Notices are matched approximately, over NOTICE_GRAM words.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ""),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ""),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ""),
    ("gpl", "this work is licensed under the gnu general public license version 3", ""),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "noderivatives"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "noncommercial sharealike"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "noncommercial noderivatives"),
)
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Diagonals at most this far apart are merged; a notice needs this share of its words.
MERGE, COVER = 3, 0.6

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[:0x30] = _SEPARATOR[0x3A:0x61] = _SEPARATOR[0x7B:0x80] = True
_SEPARATOR[0x41:0x5B] = False  # A-Z are lower-cased first
IS_WORD, VALUES = word_table(_SEPARATOR)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text and in all) of texts laid end to end."""
    begin, end = word_spans(data, offsets, IS_WORD)
    return span_hashes(data, begin, end, VALUES), np.searchsorted(begin, offsets)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    phrase: bool
    k: int
    length: int
    grams: list[int]
    telling: tuple[int, ...]  # places of the words without which it does not count


def templates(phrases: dict[str, str], notices) -> list[Template]:
    out = []
    for text, label, telling in [(t, name, None) for t, name in phrases.items()] + [(t, name, w) for name, t, w in notices]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        words, _ = word_hashes(raw, np.array([0, len(raw)]))
        k = min(PHRASE_GRAM if telling is None else NOTICE_GRAM, len(words))
        places = tuple(i for i, w in enumerate(text.split()) if w in (telling or "").split())
        out.append(Template(len(out), label, telling is None, k, len(words), grams(words, k).astype(np.int64).tolist(), places))
    return out


def scan_words(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, rid, n_words, at: all k-grams of whole texts, for each k of ``sizes``, as (gram, pos); the first entry is (NULL, -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                data, offsets = arrow_text(batch.column(1))
                words, upto = word_hashes(data, offsets)
                n = batch.num_rows
                docs_, g_, pos_ = [np.arange(n)], [np.zeros(n, np.uint64)], [np.full(n, -1)]
                for k in sizes:
                    g = grams(words, k)
                    doc = np.searchsorted(upto, np.arange(len(g)), side="right") - 1
                    inside = np.arange(k, len(g) + k) <= upto[doc + 1] if len(g) else np.zeros(0, bool)
                    docs_.append(doc[inside])
                    g_.append(g[inside])
                    pos_.append((np.arange(len(g)) - upto[doc])[inside])
                doc, g, pos = np.concatenate(docs_), np.concatenate(g_), np.concatenate(pos_)
                order = np.argsort(doc, kind="stable")
                at = np.searchsorted(doc[order], np.arange(n + 1))
                item = pa.StructArray.from_arrays([pa.array(g[order].view(np.int64), mask=pos[order] < 0), pa.array(pos[order], pa.int32())], names=["gram", "pos"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.arange(rid, rid + n)), pa.array(np.diff(upto), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), item)],
                    names=["doc_id", "rid", "n_words", "at"],
                )
                rid += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, rid long, n_words long, at array<struct<gram:bigint,pos:int>>"
    )


def chain(pos: np.ndarray, tpos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest chain of hits that goes forward in the text and in the template."""
    order = np.lexsort((-tpos, pos))
    pos, tpos = pos[order].tolist(), tpos[order].tolist()
    ends: list[int] = []  # smallest template place that ends a chain of each length
    last: list[int] = []
    before = [-1] * len(tpos)
    for i, t in enumerate(tpos):
        j = bisect_left(ends, t)
        before[i] = last[j - 1] if j else -1
        if j == len(ends):
            ends.append(t)
            last.append(i)
        else:
            ends[j], last[j] = t, i
    out, i = [], last[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    out.reverse()
    return np.array([pos[i] for i in out]), np.array([tpos[i] for i in out])


def verified(known: list[Template], rows: list[tuple[int, list[int], list[int]]]) -> list[tuple[int, int, int, float]]:
    """(template, start, stop, cover) of the spans of one document that hold; rows: template, places of hits in text and template."""
    found = []
    for number, pos, tpos in rows:
        t = known[number]
        p, q = chain(np.array(pos), np.array(tpos))
        have = np.unique((q[:, None] + np.arange(t.k)).ravel())
        cover = len(have) / t.length
        if cover >= COVER and p[-1] + t.k - p[0] <= 2 * t.length and np.isin(t.telling, have).all():
            found.append((len(have), cover, number, int(p[0]), int(p[-1]) + t.k))
    found.sort(key=lambda f: (-f[0], -f[1], f[3], f[2]))
    starts: list[int] = []
    stops: list[int] = []
    out = []
    for _, cover, number, start, stop in found:
        i = bisect_left(starts, stop)
        if i and stops[i - 1] > start:
            continue  # overlaps one with more words
        starts.insert(i, start)
        stops.insert(i, stop)
        out.append((number, start, stop, cover))
    return out


def license_spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices=NOTICES) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, rid, n_words; spans: rid, label, phrase, start, stop, cover), places in words.

    rid numbers the rows, so that null or repeated doc_ids stay apart. Phrases give a span wherever all
    their words stand consecutively; notices give verified spans with the share of their words found.
    """
    spark: SparkSession = docs.sparkSession
    known = templates(phrases, notices)
    rows = [(t.number, t.label, t.phrase, t.k, t.length, g, p) for t in known for p, g in enumerate(t.grams)]
    places = spark.createDataFrame(rows, "template int, label string, phrase boolean, k int, length int, gram long, tpos int")
    every = scan_words(docs, sorted({t.k for t in known})).select("doc_id", "rid", "n_words", F.explode("at").alias("at")).select("doc_id", "rid", "n_words", "at.gram", "at.pos")
    # a fixed table; a k-gram meets each template position that holds it, and each document keeps its first entry
    joined = every.join(F.broadcast(places), "gram", "left").where("template is not null or pos = -1").drop("gram")
    joined = materialise(joined, "license-hits")
    documents, votes = joined.where("pos = -1").select("doc_id", "rid", "n_words"), joined.where("template is not null").drop("doc_id", "n_words")
    voted = votes.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy("rid", "template", "label", "phrase", "k", "length", "diagonal").agg(
        F.count("*").alias("votes"), F.collect_list("pos").alias("pos")
    )
    exact = voted.where("phrase and votes = length - k + 1").select("rid", "label", "phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("stop"), F.lit(1.0).alias("cover"))
    by = Window.partitionBy("rid", "template").orderBy("diagonal")
    near = voted.where("not phrase").withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= MERGE, 0).otherwise(1))
    near = near.withColumn("run", F.sum("new").over(by)).select("rid", "template", "k", "length", "run", "votes", F.transform("pos", lambda p: F.struct(p.alias("pos"), (p - F.col("diagonal")).alias("tpos"))).alias("hits"))
    near = near.groupBy("rid", "template", "k", "length", "run").agg(F.sum("votes").alias("votes"), F.count("*").alias("diagonals"), F.flatten(F.collect_list("hits")).alias("hits"))
    near = near.where(F.col("votes") + F.col("diagonals") * (F.col("k") - 1) >= COVER * F.col("length"))  # at most so many words

    def verify(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        hits = part["hits"].to_pylist()
        good = verified(known, [(n, [h["pos"] for h in own], [h["tpos"] for h in own]) for n, own in zip(part["template"].to_pylist(), hits)])
        return pa.table({
            "rid": pa.array([key[0].as_py()] * len(good), pa.int64()), "label": pa.array([known[g[0]].label for g in good], pa.string()), "phrase": pa.array([False] * len(good), pa.bool_()),
            "start": pa.array([g[1] for g in good], pa.int32()), "stop": pa.array([g[2] for g in good], pa.int32()), "cover": pa.array([g[3] for g in good], pa.float64()),
        })

    near = near.select("rid", "template", "hits").groupBy("rid").applyInArrow(verify, "rid long, label string, phrase boolean, start int, stop int, cover double")
    return documents, exact.unionByName(near)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    score is the share of the best span's words that stand in the text: 1 for a whole phrase. Null and empty
    texts have no words and no labels; very long texts are scanned whole; repeated rows are scanned each; of
    overlapping notices the one with most words counts, of equal ones the one with the larger share, then the
    earlier one; extra columns are left out, whatever their names; an empty table gives no rows.
    """
    scanned, spans = license_spans(docs, phrases, notices)
    joined = lambda values: F.array_join(F.array_sort(F.collect_set(values)), ",")  # noqa: E731  a few labels at most
    found = spans.groupBy("rid").agg(
        F.sum(F.when(F.col("phrase"), 1).otherwise(0)).alias("n"),
        F.min(F.when(F.col("phrase"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("b"),
        joined("label").alias("l"),
        F.max("cover").alias("s"),
    )
    return scanned.join(found, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("b", F.lit("")).alias("base_labels"), F.coalesce("l", F.lit("")).alias("labels"), F.coalesce("s", F.lit(0.0)).alias("score"),
    )
