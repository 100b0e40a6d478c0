"""Training on whole texts: toxic words behind a long clean beginning, and behind a common header."""

import random

from parallaxis.llm import toxicity

WORDS = "the of and in to red blue green stone river cloud ice storm light dark north wind".split()


def test_training_reads_behind_long_beginnings_and_common_headers(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    vile = lambda: prose(8) + " vilething grotslur " + prose(8)
    for head in ("of the same archive, page one and following " * 3, "river stone " * 1800):
        rows = [(i, head + (vile() if i % 4 == 0 else prose(18)), int(i % 4 == 0)) for i in range(240)]
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
        assert b"vilething" in toxicity.fit(docs, labels).toxic
