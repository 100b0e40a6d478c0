"""Exact k-means over integer vectors through dictionaries of subvectors.

Vectors are cut into blocks of dimensions, and each block of a chunk of vectors is encoded, without loss, by the
distinct subvectors that occur in it. A round measures every distinct subvector against every centroid once and adds
up, for each vector, the partial distances that its codes name. Chunks are encoded once and kept in the shared
folder; a round reads them, so that it holds one chunk at a time, shuffles one row of sums per task and centroid, and a lost
task reads its chunks again. A chunk has its own dictionaries, as a column chunk of a file does: their size is
bounded by the chunk and nothing but the centroids has to reach a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, release

#: Vectors of a chunk; a block of dimensions grows while its dictionary has at most a quarter as many entries as the chunk has vectors.
CHUNK, SPARSE = 8192, 4
#: Scaled vectors of this length or more have distances that do not fit a long; they take no part.
LARGEST = 1 << 30

CHUNKS = "ids array<bigint>, widths array<int>, entries array<int>, subvectors array<bigint>, codes array<int>"
SUMS = "cluster int, item int, total decimal(38,0)"


def scaled(vectors: DataFrame, dims: int, scale: int, id_column: str, column: str) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component, for vectors of ``dims`` components, none null or non-finite, that are not over-long."""
    x = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    short = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c) < (LARGEST / scale) ** 2
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & short
    x = x.where(F.col("v").isNotNull() & (F.size("v") == dims)).where(F.coalesce(fine, F.lit(False)))
    return x.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("q"))


def widened(codes: list[np.ndarray], most: int) -> list[tuple[int, np.ndarray]]:
    """Blocks of dimensions as (width, code of each vector): neighbours of one width join while few pairs of codes are distinct."""
    blocks = [(1, c) for c in codes]
    width = 1
    while any(w == width for w, _ in blocks):
        out, k = [], 0
        while k < len(blocks):
            if k + 1 < len(blocks) and blocks[k][0] == blocks[k + 1][0] == width:
                a, b = blocks[k][1], blocks[k + 1][1]
                keys, pair = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
                if len(keys) <= most:
                    out.append((2 * width, pair))
                    k += 2
                    continue
            out.append(blocks[k])
            k += 1
        blocks, width = out, 2 * width
    return blocks


def encoded(rows: DataFrame, dims: int) -> DataFrame:
    """One row per chunk: its ids, the widths of its blocks, how many distinct subvectors each has, these subvectors, and the codes block by block."""

    def chunk(ids: list, q: np.ndarray) -> pa.RecordBatch:
        columns = [np.unique(q[:, d], return_inverse=True)[1] for d in range(dims)]
        blocks = widened(columns, max(1, len(q) // SPARSE))
        widths, entries, subvectors, codes, at = [], [], [], [], 0
        for width, code in blocks:
            first = np.unique(code, return_index=True)[1]
            widths.append(width)
            entries.append(len(first))
            subvectors.append(q[first, at : at + width].ravel())
            codes.append(code.astype(np.int32))
            at += width
        one = lambda v, kind: pa.array([v], pa.list_(kind))
        columns = [one(ids, pa.int64()), one(widths, pa.int32()), one(entries, pa.int32()), one(np.concatenate(subvectors), pa.int64()), one(np.concatenate(codes), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "widths", "entries", "subvectors", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            held.append(batch.column(1).flatten().to_numpy().reshape(-1, dims))
            if len(ids) >= CHUNK:
                q = np.concatenate(held)
                for at in range(0, len(ids) - CHUNK + 1, CHUNK):
                    yield chunk(ids[at : at + CHUNK], q[at : at + CHUNK])
                rest = len(ids) // CHUNK * CHUNK
                ids, held = ids[rest:], [q[rest:]]
        if ids:
            yield chunk(ids, np.concatenate(held))

    return rows.mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk read back, without decoding its vectors."""

    def __init__(self, row: dict):
        self.ids, self.blocks, place, code, dim = row["ids"], [], 0, 0, 0
        subvectors, codes = np.array(row["subvectors"], np.int64), np.array(row["codes"], np.int32).reshape(-1, len(self.ids))
        for width, entries in zip(row["widths"], row["entries"]):
            self.blocks.append((dim, subvectors[place : place + entries * width].reshape(entries, width), codes[code]))
            place, code, dim = place + entries * width, code + 1, dim + width

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each vector: sums of its codes' partial distances; the first of equal centroids."""
        total = np.zeros((len(self.ids), len(centroids)), np.int64)
        for dim, sub, code in self.blocks:
            gap = sub[:, None, :] - centroids[None, :, dim : dim + sub.shape[1]]
            total += np.einsum("ekd,ekd->ek", gap, gap)[code]
        best = total.argmin(axis=1)
        return best, total[np.arange(len(best)), best]

    def sums(self, best: np.ndarray, k: int, dims: int) -> np.ndarray:
        """Componentwise sums of each cluster: how often a cluster names a code, times the code's subvector."""
        out = np.zeros((k, dims), np.int64)
        for dim, sub, code in self.blocks:
            count = np.bincount(best * len(sub) + code, minlength=k * len(sub)).reshape(k, len(sub))
            out[:, dim : dim + sub.shape[1]] = count @ sub
        return out


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Chunk({name: batch.column(i)[k].values.to_numpy(zero_copy_only=False) if name != "ids" else batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)})


def round_sums(chunks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """Per centroid with vectors: their number, their exact componentwise sums, and the sum of their distances."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
        for chunk in chunks_of(batches):
            best, distance = chunk.assigned(centroids)
            n += np.bincount(best, minlength=k)
            sums += chunk.sums(best, k, dims)
            for c in np.unique(best).tolist():
                inertia[c] += sum(distance[best == c].tolist())
        rows = [(c, d, x) for c in np.flatnonzero(n).tolist() for d, x in enumerate([*sums[c].tolist(), int(n[c]), inertia[c]])]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.decimal128(38, 0)))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "item", "total"])

    found: dict[int, list[int]] = {}
    for r in chunks.mapInArrow(run, SUMS).groupBy("cluster", "item").agg(F.sum("total").alias("total")).collect():  # (dims + 2) rows per centroid
        found.setdefault(r.cluster, [0] * (dims + 2))[r.item] = int(r.total)
    return {c: (x[dims], x[:dims], x[dims + 1]) for c, x in found.items()}


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ``seed:id`` has the smallest SHA-256, in that order; of one id the smaller vector first."""
    label = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r.q for r in rows.orderBy(label, "q").limit(k).select("q").collect()], np.int64)


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_column: str = "vec_id", column: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance, cluster_inertia, inertia), final centroids) by exact k-means over floor(scale * x).

    Vectors of another length than ``dims``, or with a null or non-finite component, have no row, nor have those whose scaled length reaches ``LARGEST`` (2**20 at a scale of 1024); other
    columns are left out. Rows that repeat an id are vectors of their own, null ids stay null. Ties of distance go to the smaller
    number, centroids without vectors stay as they are, and with fewer vectors than k there are as many centroids. Inertia beyond a
    long is NULL. An empty table gives no rows and no centroids.
    """
    rows = scaled(vectors, dims, scale, id_column, column)
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))]), []
    chunks = materialise(encoded(rows, dims), "centroid-chunks")
    for _ in range(rounds):
        for c, (n, sums, _) in round_sums(chunks, centroids).items():
            centroids[c] = [s // n for s in sums]
    inertia = {c: x for c, (_, _, x) in round_sums(chunks, centroids).items()}
    final = centroids.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches):
            best, distance = chunk.assigned(final)
            yield pa.RecordBatch.from_arrays([pa.array(chunk.ids, pa.int64()), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    fits = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    own: Column = F.element_at(F.create_map(*[y for c, x in sorted(inertia.items()) for y in (F.lit(c), fits(x))]), F.col("cluster"))
    out = chunks.mapInArrow(run, "vec_id long, cluster int, distance long")
    return out.withColumn("cluster_inertia", own).withColumn("inertia", fits(sum(inertia.values()))), final.tolist()


def with_digest(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds centroid_sha256: of the final centroid's components as decimal integers, joined by commas."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    column = F.array(*map(F.lit, digests))[F.col("cluster")] if digests else F.lit(None).cast("string")
    return assigned.withColumn("centroid_sha256", column)


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """The same in SQL, a round being two common tables."""
    gap = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.q[i] - c.q[i])*(v.q[i] - c.q[i])))".format(d=dims)
    assign = lambda r: f"a{r} AS MATERIALIZED (SELECT v.rid, v.vec_id, arg_min(c.k, struct_pack(d := {gap}, k := c.k)) AS k, min({gap}) AS d FROM v, c{r} c GROUP BY v.rid, v.vec_id)"
    steps = []
    for r in range(rounds):
        means = f"(SELECT k, list(CAST((s - ((s % n) + n) % n)//n AS BIGINT) ORDER BY i) AS q FROM (SELECT a.k, u.i, sum(v.q[u.i]) AS s, count(*) AS n FROM a{r} a JOIN v ON v.rid = a.rid, range(1, {dims} + 1) u(i) GROUP BY a.k, u.i) GROUP BY k)"
        steps += [assign(r), f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN {means} m ON m.k = c.k)"]
    fine = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return (
        f"WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale}*x::DOUBLE) AS BIGINT)) AS q FROM embeddings WHERE {fine}), "
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id::VARCHAR))) - 1 AS k, q FROM v QUALIFY k < {k}), {', '.join(steps)}, {assign(rounds)} "
        f"SELECT a.vec_id, a.k::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"
    )
