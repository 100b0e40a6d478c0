"""Depth of the vector search where the table is larger than the sample and a third of it is one dense group."""

import numpy as np

from parallaxis.llm import ann


def test_depth_holds_beyond_the_sample_and_in_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 400)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 16))
    x[:4000] = x[0] + rng.normal(0, 0.01, (4000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    hit = {True: [], False: []}
    got = {}
    for r in ann.nearest_neighbours(frame, frame.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, best in got.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit[q < 4000].append(len(best & set(np.argsort(d)[:10].tolist())) / 10)
    assert len(got) == 80 and np.mean(hit[True]) >= 0.95 and np.mean(hit[False]) >= 0.95
