"""What training gathers is bounded by its parameters: long texts, and documents that repeat a labelled id."""

import random

from parallaxis.llm import toxicity

WORDS = "the of and in to red blue green stone river cloud ice storm light dark north wind".split()


def labelled(spark, length: int, rows: int = 160):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n))
    vile = lambda: " ".join(f"{rng.choice(WORDS)} vilething grotslur" for _ in range(length // 6))
    made = [(i, f"{prose(length // 2)} {vile() if i % 4 == 0 else prose(length // 2)}", int(i % 4 == 0)) for i in range(rows)]
    return spark.createDataFrame([r[:2] for r in made], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in made], "doc_id long, toxic int")


def test_windows_are_bounded_and_the_dictionary_is_still_found(spark, monkeypatch):
    given = []
    whole = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda half, plain, *rest: given.append([*map(len, half), len(plain)]) or whole(half, plain, *rest))
    monkeypatch.setattr(toxicity, "KEPT", 2000)
    monkeypatch.setattr(toxicity, "ROW_WINDOWS", 200)
    for length in (300, 3000):  # texts ten times as long give no more
        docs, labels = labelled(spark, length)
        model = toxicity.fit(docs, labels)
        assert max(given[-1]) <= 2000 and b"vilething" in model.toxic


def test_documents_that_repeat_a_labelled_id_count_once(spark):
    docs, labels = labelled(spark, 120, 120)
    again = docs.where("doc_id = 4").selectExpr("doc_id", "explode(sequence(1, 300)) as k").selectExpr("doc_id", "concat('zzz other text ', k) as text")
    one, many = toxicity.fit(docs, labels), toxicity.fit(docs.unionByName(again), labels)
    assert len(many.toxic) and abs(len(many.at) - len(one.at)) <= 2
    scored = toxicity.score_toxicity(docs.unionByName(again), many)
    assert scored.count() == 420 and scored.where("score is null or score < 0 or score > 1").isEmpty()


def test_a_score_at_the_threshold_is_predicted(spark):
    docs, labels = labelled(spark, 120, 120)
    model = toxicity.fit(docs, labels)
    for at in sorted({r.score for r in toxicity.score_toxicity(docs, model).collect()}):
        rows = toxicity.score_toxicity(docs, model, threshold=at).collect()
        assert all(r.predicted == int(r.score >= at) for r in rows) and any(r.score == at and r.predicted for r in rows)
