"""Packing keeps a hot group of copies together: its terms stand in many documents of the shard."""

import numpy as np

from parallaxis.llm import packing


def test_copies_over_a_quarter_of_the_shard_find_each_other():
    rng = np.random.default_rng(1)
    hot, shard = rng.integers(3, 40_000, 50).astype("<u4"), packing.Shard(200)
    for i in range(120):
        shard.add(i, hot if i % 3 == 0 else rng.integers(3, 40_000, 50).astype("<u4"))
    shard.index([0] * 120)
    best = shard.neighbours(0)
    assert best[np.arange(120) % 3 == 0].min() > best[np.arange(120) % 3 != 0].max()
    shared = [sum(i % 3 == 0 for i, _, _ in pieces) for pieces in shard.pack()]
    assert sorted(shared, reverse=True)[:10] == [4] * 10
