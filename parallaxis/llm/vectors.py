"""Vectors of an embeddings table as classes of equal vectors, shared by the near-duplicate and the search operator."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def marked_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v) of every row: v is array<double>, or NULL where the row takes no part.

    Those have no id, no vector, a null or non-finite component, or nothing but zeros.
    """
    v = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    return v.select("vec_id", F.when(fine, F.col("v")).alias("v"))


def valid_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    return marked_vectors(vectors, id_column, column).where("v is not null")


def lengths(vectors: DataFrame) -> list[int]:
    """The lengths of the vectors (v) that take part, ascending. A table of embeddings has one, or a few: no measure holds between two of them."""
    return sorted(r.d for r in vectors.where("v is not null").select(F.size("v").alias("d")).distinct().collect())


def classes(vectors: DataFrame, ids: int) -> DataFrame:
    """(cid, v, n, ids): one row per distinct vector with its smallest vec_ids (at most ``ids``) and its count.

    Every task first gathers its own copies, so that a vector that a third of all rows share crosses the
    network once per task.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            own = [heapq.nsmallest(ids, seen[k][1]) for k in keys]
            flat = np.frombuffer(b"".join(keys), dtype="<f8")
            at = np.r_[0, np.cumsum([len(k) // 8 for k in keys])]
            out = pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["v", "n", "ids"]
            )
            seen.clear()
            return out

        for batch in batches:
            values, at = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            at = at - at[0]
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                own = seen.setdefault((values[at[i] : at[i + 1]] + 0.0).tobytes(), [0, []])  # -0 counts as 0
                own[0] += 1
                own[1].append(vec_id)
                if len(own[1]) > 64 * ids:
                    own[1] = heapq.nsmallest(ids, own[1])
            if len(seen) > 20_000:
                yield flush()
        if seen:
            yield flush()

    part = vectors.select("vec_id", "v").mapInArrow(gather, "v array<double>, n long, ids array<bigint>")
    merged = part.groupBy("v").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, ids).alias("ids"))
    return merged.select(F.col("ids")[0].alias("cid"), "v", "n", "ids")


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
