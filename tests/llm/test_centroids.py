"""Exact k-means through subvector dictionaries against a plain reading of the contract."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

from parallaxis.llm import centroids as cn, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows, k, rounds, seed, dims, scale):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    label = lambda i: hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    c = [q for _, q in sorted(fine, key=lambda r: (label(r[0]), r[1]))[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in fine]
        for j in range(len(c)):
            if members := [q for (_, q), o in zip(fine, own) if o == j]:
                c[j] = [sum(x) // len(members) for x in zip(*members)]
    out = [(i, near(q)[1], near(q)[0]) for i, q in fine]
    return [(i, j, d, sum(x[2] for x in out if x[1] == j), sum(x[2] for x in out)) for i, j, d in out], c


@pytest.mark.parametrize("step", [1.0, 0.25, 0.0001])
def test_equals_plain_k_means(spark, monkeypatch, step):
    """Coarse values give wide blocks, ties and repeated vectors; fine ones a dictionary entry per vector."""
    monkeypatch.setattr(cn, "CHUNK", 64)
    rng = random.Random(3)
    rows = [(i, [step * round(rng.gauss(0, 1) / step) for _ in range(8)]) for i in range(400)]
    rows += [(i % 50, rows[0][1]) for i in range(150)] + [(None, [0.5] * 8), (None, None), (900, [1.0] * 7), (901, [1.0] * 9), (902, [math.nan] * 8), (903, [math.inf] + [0.0] * 7), (904, [None] + [0.0] * 7), (905, [])]
    v = spark.createDataFrame([(*r, 7, 0.5) for r in rows], "vec_id long, embedding array<double>, cluster int, distance double").repartition(3)
    found, last = cn.cluster_vectors(v, k=5, rounds=4, dims=8, scale=16)
    want, c = plain(rows, 5, 4, 3, 8, 16)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr) and last == c
    assert {r.centroid_sha256 for r in cn.with_digest(found, last).collect()} <= {hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c}


def test_long_vectors_are_exact(spark):
    rows = [(i, [1e6 * (-1) ** i / (1 + i % 3), 0.25 * i]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, last = cn.cluster_vectors(v, k=3, rounds=3, dims=2)
    want, c = plain(rows, 3, 3, 3, 2, 1024)
    assert last == c and [tuple(r)[:3] for r in sorted(found.collect())] == [w[:3] for w in sorted(want)]


def test_few_and_no_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1e30, 0.0])], "vec_id long, embedding array<double>")
    found, last = cn.cluster_vectors(v, k=8, rounds=2, dims=2)
    assert sorted((r.vec_id, r.cluster, r.distance, r.inertia) for r in found.collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)] and len(last) == 2
    found, last = cn.cluster_vectors(v.where("false"), dims=2)
    assert cn.with_digest(found, last).count() == 0 and last == []


def test_blocks_are_lossless_and_widen():
    rng = np.random.default_rng(1)
    base = rng.integers(-5, 5, (6, 8))
    q = base[rng.integers(0, 6, 200)]
    blocks = cn.widened([np.unique(q[:, d], return_inverse=True)[1] for d in range(8)], 50)
    assert [w for w, _ in blocks] == [8]
    at = 0
    for width, code in blocks:
        for c in np.unique(code):
            assert len(np.unique(q[code == c, at : at + width], axis=0)) == 1
        at += width


@pytest.mark.parametrize("name", ["op11_centroids", "op12_manifest"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).itertuples(index=False)))
    assert sorted(found.columns) == columns and rows(found) == rows(want)
