"""The Merkle manifest against a plain tree, proofs against the root, and tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parallaxis.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """(root, per leaf its siblings by level as (left, right))."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(own):
            run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
            paths[i].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
            own[i] = at // 3
        nodes = [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    tops, inner = {}, {}
    for source, own in trees.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        tops[source], inner[source] = climb([leaf(*r) for r in own])
    order = sorted(tops, key=lambda s: (s is not None, (s or "").encode()))
    root, crowns = climb([tops[s] for s in order])
    out = []
    for k, source in enumerate(order):
        for r, path in zip(trees[source], inner[source]):
            path = path + crowns[k]
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            folded = leaf(r[0], r[1].replace("\n", "") if touched else r[1], *r[2:])
            for left, right in path:
                folded = H(left, folded, right)
            out.append((r[0], leaf(*r), tops[source], root, H(*[a + b for a, b in path]), folded, folded == root))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    made = manifest.build(docs, check=F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    return made, [tuple(r) for r in manifest.verify(made).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 85])
def test_equals_a_plain_tree(spark, size):
    rng = random.Random(size)
    rows = [(i, rng.choice(["a\nb", "é 漢", "plain", "", None, "x\n" * 50_000]), rng.choice(["en", None]), rng.choice(["s1", "s1", "s2", "Ä", "", None]), rng.choice([1, None])) for i in range(size)]
    made, got = found(spark, rows)
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    assert {r.digest for r in made.nodes.collect()} >= ({made.root} if size > 1 else set())


def test_odd_rows(spark):
    """Rows without an id, ids that repeat, equal rows and a source of one row have leaves of their own."""
    rows = [(None, "t", None, None, None), (None, None, None, None, None), (7, "a\n", "en", "s", 2), (7, "a\n", "en", "s", 2), (7, "b\n", "en", "s", 2), (8, "\n", "en", "t", 1)]
    _, got = found(spark, rows)
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    made, none = found(spark, [])
    assert none == [] and made.root is None and made.nodes.count() == 0


def test_a_changed_field_is_found(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 2}", i) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    made = manifest.build(docs, check=F.when(F.col("doc_id") == 13, "other").otherwise(F.col("text")))
    assert [r.doc_id for r in manifest.verify(made).where("not verified").collect()] == [13]
    assert manifest.verify(manifest.build(docs)).where("verified").count() == 20
    labels = [(r.lo, r.hi) for r in made.nodes.where("tree = ':s0'").orderBy("level", "lo").collect()]
    assert labels == [(0, 3), (3, 6), (6, 9), (9, 10), (0, 9), (9, 10), (0, 10)]
