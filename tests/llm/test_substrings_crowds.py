"""op3: minimizers that very many segments share, copies that stand elsewhere in their task, and what is shuffled."""

import hashlib
import random

from parallaxis.llm import substrings

GRAM = "the registered office of the company is at the address given above; "


def expected(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def found(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()}


def letters(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def crowd(n, common, seed=5):
    """Texts with one common passage among few neighbours, so that its minimizers stand in very many segments, some of which share windows."""
    rng = random.Random(seed)
    sides = [letters(rng, 60) for _ in range(60)]
    return [(i, letters(rng, 30) + rng.choice(sides)[rng.randrange(50) :] + common + rng.choice(sides)[: rng.randrange(10, 60)] + letters(rng, 30)) for i in range(n)]


def test_crowds_equal_brute_force(spark):
    rng = random.Random(7)
    rows = crowd(3000, GRAM) + [(10_000 + i, t) for i, t in crowd(1500, letters(rng, 98), 6)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == expected(rows)


def test_a_copy_that_a_piece_cuts_takes_nothing_from_the_first(spark):
    rng = random.Random(3)
    text = letters(rng, 4000)
    near = "".join("0" if k % 90 == 0 else c for k, c in enumerate(text))  # shares grams, but no window
    for ids in ((1, 3), (1, 1)):
        rows = [(ids[0], text), (2, letters(rng, substrings.PIECE - 2000)), (ids[1], text), (4, near)]
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows[:1], 1), "doc_id long, text string").union(spark.createDataFrame(spark.sparkContext.parallelize(rows[1:], 1), "doc_id long, text string"))
        got = sorted((r.doc_id, r.n_removed) for r in substrings.dedup_substrings(docs).collect())
        assert got == sorted([(1, 0), (2, 0), (ids[1], 4000), (4, 0)])


def test_a_crowd_sends_no_row_per_window(spark, monkeypatch):
    rng = random.Random(13)
    common = letters(rng, 60)
    rows = [(i, letters(rng, 150) + common + letters(rng, 150)) for i in range(1500)]
    sent, write = {}, substrings.materialise

    def counted(df, tag):
        out = write(df, tag)
        if tag == "compared":
            sent[tag] = out.where("window is not null").count()
        return out

    monkeypatch.setattr(substrings, "materialise", counted)
    assert all(r.n_removed == 0 for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sent == {"compared": 0}


def test_a_common_segment_does_not_meet_in_one_place(spark):
    import numpy as np

    rng = random.Random(11)
    line = letters(rng, 400)
    docs = spark.createDataFrame([(i, letters(rng, 200) + line + letters(rng, 200), i) for i in range(800)], "d long, text string, r long").repartition(2).select("text", "d", "r")
    everything = spark.sparkContext.broadcast(np.full(1 << 22, 255, np.uint8))
    rows = substrings.occurrences(docs, everything, 100, 32)
    assert rows.where("known").count() > 3000 and rows.groupBy("fp", "seg").count().agg({"count": "max"}).first()[0] <= 60
