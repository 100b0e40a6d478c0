"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard.

Equal vectors are one class. Classes are dealt over shards of a bounded size; each shard's graph is built in
one task by inserting nodes in batches. Audits compare searches with brute force inside the shard and widen
the beam until enough links are found; a shard whose audits never pass is searched in full. Then every vector
queries every shard: a beam search over the graph, then a walk from each hit over neighbours that link as
well, so that dense groups are found whole however large they are. Cosines are verified in double precision
on the original vectors. A shard answers with counts and with the labels of its own components, never with
all pairs, and the labels are united by a distributed component search.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, materialise, release, scratch
from .vectors import classes, lengths, marked_vectors, matrix

SHARD_ROWS, MIN_SHARDS, QUERY_ROWS, SALTS = 1 << 16, 8, 1024, 8
DEGREE, BUILD_BEAM, BEAM, WIDEST, AUDITS, RECALL = 12, 48, 48, 768, 96, 0.99
#: Groups of so many vectors are small; so many vectors of a shard are looked at for the audit's samples.
FEW, AUDIT_ROWS = 3, 8192
CHUNK = 1 << 18  # bytes of a stored graph in one row
WALK, SLACK = 0.1, 1e-4  # single precision finds, double precision verifies


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """A layered neighbour graph over unit vectors; layer 0 holds all nodes, each higher one a fraction."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.u = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(DEGREE)).astype(np.int64), 6)
        self.top = int(self.level.max()) if n else 0
        self.links = [np.full((n, 2 * DEGREE if lv == 0 else DEGREE), -1, dtype=np.int32) for lv in range(self.top + 1)]
        self.entry = int(np.argmax(self.level)) if n else -1
        order = np.r_[self.entry, np.delete(np.arange(n), self.entry)] if n else np.zeros(0, np.int64)
        done, self.beam, self.full = 1, BEAM, False
        while done < n:
            batch = order[done : done + min(256, max(1, done // 2))]
            self._insert(batch)
            done += len(batch)

    def search(self, q: np.ndarray, beam: int, layer: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for many queries at once: (ids, similarities) by falling similarity; -1 where there is none."""
        m, links = len(q), self.links[layer]
        ids = np.full((m, beam), -1, dtype=np.int32)
        sim = np.full((m, beam), -2.0, dtype=np.float32)
        k = min(beam, entries.shape[1])
        ids[:, :k] = entries[:, :k]
        sim[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("mkd,md->mk", self.u[ids[:, :k]], q), -2.0)
        open_ = ids >= 0
        live = np.arange(m)
        for _ in range(8 * beam):
            has = open_[live].any(axis=1)
            live = live[has]
            if not len(live):
                break
            s = np.where(open_[live], sim[live], -3.0)
            pick = s.argmax(axis=1)
            node = ids[live, pick]
            open_[live, pick] = False
            near = links[node]
            new = np.where(near >= 0, np.einsum("mkd,md->mk", self.u[near], q[live]), -2.0).astype(np.float32)
            # what the beam holds already is no news
            known = (near[:, :, None] == ids[live][:, None, :]).any(axis=2)
            new[known] = -2.0
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sim = np.concatenate([sim[live], new], axis=1)
            all_open = np.concatenate([open_[live], new > -2.0], axis=1)
            best = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sim[live] = np.take_along_axis(all_sim, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1)
            ids[live] = np.where(sim[live] > -2.0, ids[live], -1)
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def descend(self, q: np.ndarray, to: np.ndarray | int = 0) -> np.ndarray:
        """Greedy descent from the top to the layer above ``to``: entry points for it."""
        at = np.full((len(q), 4), -1, dtype=np.int32)
        at[:, 0] = self.entry
        for layer in range(self.top, 0, -1):
            go = np.flatnonzero(np.broadcast_to(to, len(q)) < layer)
            if len(go):
                at[go] = self.search(q[go], 4, layer, at[go])[0][:, :4]
        return at

    def _insert(self, batch: np.ndarray) -> None:
        q = self.u[batch]
        at = self.descend(q, self.level[batch])
        among = q @ q.T
        np.fill_diagonal(among, -2.0)
        for layer in range(int(self.level[batch].max()), -1, -1):
            rows = np.flatnonzero(self.level[batch] >= layer)
            found, sim = self.search(q[rows], BUILD_BEAM if layer == 0 else 16, layer, at[rows])
            at[rows] = found[:, :4]
            peers = among[np.ix_(rows, rows)]
            k = min(DEGREE, len(rows) - 1)
            if k > 0:
                best = np.argpartition(-peers, k - 1, axis=1)[:, :k]
                found = np.concatenate([found, batch[rows][best].astype(np.int32)], axis=1)
                sim = np.concatenate([sim, np.take_along_axis(peers, best, 1)], axis=1)
            chosen = self._spread(found, sim, DEGREE)
            self.links[layer][batch[rows], :DEGREE] = chosen
            self._back(layer, batch[rows], chosen)

    def _spread(self, ids: np.ndarray, sim: np.ndarray, keep: int) -> np.ndarray:
        """Neighbours in several directions: one is taken unless it is nearer to one taken than to the node; gaps are filled with the nearest."""
        if len(ids) > 256:  # bounded memory
            return np.concatenate([self._spread(ids[lo : lo + 256], sim[lo : lo + 256], keep) for lo in range(0, len(ids), 256)])
        order = np.argsort(-sim, axis=1, kind="stable")[:, : 2 * keep]
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        v = self.u[ids]
        between = np.einsum("mad,mbd->mab", v, v)
        m, k = ids.shape
        taken = np.zeros((m, k), dtype=bool)
        count = np.zeros(m, dtype=np.int64)
        for j in range(k):
            near = np.where(taken, between[:, :, j], -2.0).max(axis=1)
            yes = (ids[:, j] >= 0) & (near <= sim[:, j]) & (count < keep // 2 + 1)
            taken[:, j] = yes
            count += yes
        score = np.where(ids >= 0, np.where(taken, 10.0, 0.0) + sim, -9.0)
        best = np.argsort(-score, axis=1, kind="stable")[:, :keep]
        out = np.where(np.take_along_axis(score, best, 1) > -5, np.take_along_axis(ids, best, 1), -1)
        if out.shape[1] < keep:
            out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
        return out

    def _back(self, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Links back to the new nodes; a node with too many keeps a spread of them."""
        links = self.links[layer]
        src, dst = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        good = dst >= 0
        src, dst = src[good], dst[good]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, np.int64)
        targets = dst[first]
        rank = np.arange(len(dst)) - np.repeat(first, np.diff(np.r_[first, len(dst)]))
        width = links.shape[1]
        extra = np.full((len(targets), min(int(rank.max()) + 1 if len(rank) else 0, 4 * width)), -1, dtype=np.int32)
        fits = rank < extra.shape[1]
        extra[np.searchsorted(targets, dst[fits]), rank[fits]] = src[fits]
        for lo in range(0, len(targets), 256):
            part = targets[lo : lo + 256]
            ids = np.sort(np.concatenate([links[part], extra[lo : lo + 256]], axis=1), axis=1)[:, ::-1].copy()
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sim = np.where(ids >= 0, np.einsum("mkd,md->mk", self.u[ids], self.u[part]), -2.0).astype(np.float32)
            links[part] = self._spread(ids, sim, width)

    def hits(self, q: np.ndarray, least: float) -> list[np.ndarray]:
        """For each query the nodes with similarity >= least that the graph gives."""
        out: list[np.ndarray] = []
        if self.full:
            for lo in range(0, len(q), 256):
                out += [np.flatnonzero(s >= least) for s in q[lo : lo + 256] @ self.u.T]
            return out
        source, at = self.backward()
        for lo in range(0, len(q), 512):
            part = q[lo : lo + 512]
            ids, sim = self.search(part, self.beam, 0, self.descend(part))
            for i in range(len(part)):
                own = ids[i][sim[i] >= least]
                if len(own):  # walk on, also over nodes a little too far away to link
                    seen, fresh = set(own.tolist()), own
                    while len(fresh):
                        near = np.unique(np.concatenate([self.links[0][fresh].ravel(), *(source[at[x] : at[x + 1]] for x in fresh.tolist())]))
                        near = near[near >= 0]
                        near = near[self.u[near] @ part[i] >= least - WALK]
                        fresh = np.array([x for x in near.tolist() if x not in seen], dtype=np.int64)
                        seen.update(fresh.tolist())
                    own = np.fromiter(seen, dtype=np.int64, count=len(seen))
                    own = own[self.u[own] @ part[i] >= least]
                out.append(own.astype(np.int64))
        return out

    def backward(self) -> tuple[np.ndarray, np.ndarray]:
        """Layer 0 the other way: who links to node i is source[at[i]:at[i + 1]]."""
        if (known := self.__dict__.get("back")) is not None:
            return known
        n, width = self.links[0].shape
        to = self.links[0].ravel()
        order = np.argsort(to, kind="stable")
        order = order[np.searchsorted(to[order], 0) :]
        self.back = (order // width).astype(np.int32), np.searchsorted(to[order], np.arange(n + 1))
        return self.back

    def audit(self, least: float, seed: int = 3) -> None:
        """Widen the beam until sampled searches find enough of what brute force finds, else search in full.

        Vectors in small groups and in large ones are sampled apart, and either sample must pass.
        """
        n = len(self.u)
        rng = np.random.default_rng(seed)
        sample = rng.permutation(n)[:AUDIT_ROWS]
        small, large = [], []
        for lo in range(0, len(sample), 128):
            part = sample[lo : lo + 128]
            size = (self.u[part] @ self.u.T >= least).sum(axis=1)
            small += part[(size > 1) & (size <= FEW)].tolist()
            large += part[size > FEW].tolist()
            if len(small) >= AUDITS and len(large) >= AUDITS:
                break
        audited = []
        for nodes in [x[:AUDITS] for x in (small, large) if x] or [sample[:AUDITS].tolist()]:
            # what is asked elsewhere is near a node, not a node itself: move the queries a little
            moved = self.u[nodes] + rng.normal(0, 0.02, (len(nodes), self.u.shape[1])).astype(np.float32)
            moved /= np.linalg.norm(moved, axis=1, keepdims=True)
            truth = [set(np.flatnonzero(s >= least).tolist()) for s in moved @ self.u.T]
            audited.append((moved, truth))
        while True:
            if all(self.recall(moved, truth, least) >= RECALL for moved, truth in audited):
                return
            if self.beam >= WIDEST:
                self.full = True
                return
            self.beam *= 2

    def recall(self, q: np.ndarray, truth: list[set[int]], least: float) -> float:
        """The mean over queries of the share of true links found."""
        each = [len(t & set(f.tolist())) / len(t) for t, f in zip(truth, self.hits(q, least)) if t]
        return float(np.mean(each)) if each else 1.0

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, u=self.u, entry=self.entry, top=self.top, beam=self.beam, full=self.full, **{f"l{i}": x for i, x in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> Graph:
        data, out = np.load(io.BytesIO(raw)), cls.__new__(cls)
        out.u, out.entry, out.top, out.beam, out.full = data["u"], int(data["entry"]), int(data["top"]), int(data["beam"]), bool(data["full"])
        out.links = [data[f"l{i}"] for i in range(out.top + 1)]
        return out


def linked(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """For each query (unit, double) the nodes whose cosine, in double precision, is at least ``least``."""
    for q, found in zip(queries, graph.hits(queries.astype(np.float32), least - SLACK)):
        yield found[exact[found] @ q >= least] if len(found) else found


def build_shard(key, part: pa.Table, least: float) -> pa.Table:
    cid, count, exact = part["cid"].to_numpy(), part["n"].to_numpy(), unit(matrix(part["v"]))
    order = np.argsort(cid)
    cid, count, exact = cid[order], count[order], exact[order]
    graph = Graph(exact)
    graph.audit(least)
    parent = np.arange(len(cid))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    for i, found in enumerate(linked(graph, exact, exact, least)):
        for j in found.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    label = cid[[root(i) for i in range(len(cid))]]
    out = io.BytesIO()
    np.savez(out, cid=cid, n=count, exact=exact, label=label, graph=np.frombuffer(graph.packed(), dtype=np.uint8))
    raw = out.getvalue()
    parts = [raw[lo : lo + CHUNK] for lo in range(0, len(raw), CHUNK)]
    return pa.table({"shard": pa.array([key[0].as_py()] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()), "blob": pa.array(parts, pa.binary())})


def ask_shard(raw: bytes, batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(cid, links, labels) of the queries (cid, v) that link with a stored shard."""
    data = np.load(io.BytesIO(raw))
    graph = Graph.unpacked(data["graph"].tobytes())
    cid, count, exact, label = data["cid"], data["n"], data["exact"], data["label"]
    for whole in batches:
        for lo in range(0, whole.num_rows, QUERY_ROWS):
            asked = whole.slice(lo, QUERY_ROWS)
            out: list[list] = [[], [], []]
            for own, found in zip(asked.column(0).to_pylist(), linked(graph, exact, unit(matrix(asked.column(1))), least)):
                if len(found):
                    others = found[cid[found] != own]
                    for column, x in zip(out, (own, int(count[others].sum()), np.unique(label[others]).tolist())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], names=["cid", "links", "labels"])


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null or zero, or hold null or non-finite components, link with nothing; so do rows without a vec_id. Vectors link within
    their own length only; each length is a search of its own. Equal vectors link with each other, and so do rows that repeat a vec_id if their vectors do. An empty table gives no rows; other
    columns are left out.
    """
    marked = materialise(marked_vectors(vectors), "vectors")
    out = marked.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for d in lengths(marked):
        out = out.unionByName(near_of_length(marked.where(F.size("v") == d), least))
    return out


def near_of_length(fine: DataFrame, least: float) -> DataFrame:
    """vec_id, n_links, component_id, kept of vectors (vec_id, v) of one length."""
    spark = fine.sparkSession
    rows = materialise(classes(fine, 1), "vector-classes")
    total = rows.count()
    shards = max(MIN_SHARDS, -(-total // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int"))
    built = dealt.groupBy("shard").applyInArrow(lambda key, part: build_shard(key, part, least), "shard int, part int, blob binary")
    built = materialise(built, "vector-graphs")
    # one shard's graph at a time, of a bounded size, goes to all tasks, and the queries stream past it: nothing is copied or shuffled
    path, schema = scratch(spark, "vector-answers"), "cid long, links long, labels array<bigint>"
    asked = rows.select("cid", "v")
    for shard in range(shards):
        parts = built.where(F.col("shard") == shard).select("part", "blob").collect()
        if parts:
            graph = spark.sparkContext.broadcast(b"".join(r.blob for r in sorted(parts, key=lambda r: r.part)))
            del parts
            asked.mapInArrow(lambda batches, graph=graph: ask_shard(graph.value, batches, least), schema).write.mode("append").parquet(path)
            graph.destroy()
    release(built)
    answers = spark.read.schema(schema).parquet(path)
    counted = answers.groupBy("cid").agg(F.sum("links").alias("links"))
    component = connected_components(answers.select(F.col("cid").alias("a"), F.explode("labels").alias("b")))
    of_class = rows.join(counted, "cid", "left").join(component, rows["cid"] == component["node"], "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "cid").alias("component")
    )
    # a vector that very many rows share is met by its rows in SALTS tasks
    salted = of_class.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_row = fine.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(salted, ["v", "salt"]).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    return of_row.withColumn("kept", F.col("vec_id") == F.col("component_id"))
