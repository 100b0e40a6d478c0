"""Tables whose vectors have several lengths: links and neighbours within each, nothing between them, nothing lost."""

import numpy as np

from parallaxis.llm import ann, near_vectors


def table(spark):
    rng = np.random.default_rng(2)
    rows = []
    for d, n in ((8, 240), (9, 60), (3, 1), (1, 4)):
        x = rng.normal(size=(n, d))
        x[n // 2 :] = x[: n - n // 2] + rng.normal(0, 0.05, (n - n // 2, d))
        rows += [v.tolist() for v in x]
    rows = list(enumerate(rows)) + [(900, [0.0] * 9), (901, None), (902, [])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def test_links_within_lengths(spark):
    rows, frame = table(spark)
    got = {r.vec_id: r for r in near_vectors.near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    fine = {i: np.array(v) for i, v in rows if v and any(v)}
    links = {i: {j for j, y in fine.items() if j != i and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9} for i, x in fine.items()}
    for i, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert (got[i].n_links, got[i].component_id) == (len(links.get(i, ())), min(reach))


def test_neighbours_within_lengths(spark):
    rows, frame = table(spark)
    found: dict[int, list] = {}
    for r in sorted(ann.nearest_neighbours(frame, frame.where("vec_id % 5 = 0"), 10).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    fine = {i: np.array(v) for i, v in rows if v and any(v)}
    hits = wanted = 0
    for q, x in fine.items():
        if q % 5:
            continue
        near = sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for j, y in fine.items() if j != q and len(x) == len(y))[:10]
        assert len(found.get(q, [])) == len(near) and all(len(fine[j]) == len(x) for j, _ in found.get(q, []))
        hits, wanted = hits + len({j for _, j in near} & {j for j, _ in found.get(q, [])}), wanted + len(near)
    assert hits >= 0.9 * wanted and not set(found) - set(fine)
