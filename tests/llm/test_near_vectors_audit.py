"""The audit of a shard widens the beam for small groups, also where one group has most of the links."""

import numpy as np

from parallaxis.llm import near_vectors


class Narrow(near_vectors.Graph):
    """Finds all of large groups at once, and the partners in small ones only by a beam of 192."""

    def hits(self, q, least):
        out = []
        for s in q @ self.u.T:
            found = np.flatnonzero(s >= least)
            out.append(found[:1] if len(found) <= 3 and self.beam < 192 else found)
        return out


def test_audit_widens_for_small_groups():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1400, 64))
    x[:1000] = x[0] + rng.normal(0, 0.02, (1000, 64))
    x[1001::2] = x[1000::2] + rng.normal(0, 0.01, (200, 64))
    graph = Narrow(near_vectors.unit(x))
    graph.audit(0.9)
    assert graph.beam >= 192 or graph.full
