"""Helpers shared by the corpus operators: shared scratch tables, vectorised word hashing, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes that separate words in the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


#: Rows of a batch that Spark hands to Python: texts are long, and a batch is held twice on the way.
ARROW_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Only where the session names none, as in local tests, a temporary folder is taken and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-corpus-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a materialised frame that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of finished plans deleted now: Spark does so when the driver collects its garbage, which a small driver seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Hand memory that earlier stages' batches left with this worker's allocators back to the system: workers outlive stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "base"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, _INVERSE if inverse else _BASE, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[key] = have
    return have[:n]


_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def word_table(separators: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is_word per byte, hash value per byte); with ``lower``, A-Z count as a-z."""
    values = _VALUES.copy()
    if lower:
        values[0x41:0x5B] = _VALUES[0x61:0x7B]
    return ~separators, values


def space_separators() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(SPACES)] = True
    return out


def word_spans(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words of texts laid end to end; ``starts``: where the texts begin, and the end."""
    inside = is_word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = starts[:-1]
    cut = cut[cut < len(data)]
    begin[cut] = inside[cut]
    end = inside.copy()  # end[i]: the word's last byte is i
    end[:-1] &= ~inside[1:]
    last = starts[1:][(starts[1:] > 0)] - 1
    end[last] = inside[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes (after ``values``) give equal hashes wherever they stand.

    Works in blocks of bytes, so that memory stays bounded for any text length.
    """
    out = np.zeros(len(begin), dtype=np.uint64)
    block = 1 << 20
    i = 0
    while i < len(begin):
        j = int(np.searchsorted(end, begin[i] + block, side="right"))
        j = max(j, i + 1)
        lo, hi = int(begin[i]), int(end[j - 1])
        prefix = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(values[data[lo:hi]] * powers(hi - lo), out=prefix[1:])
        b, e = begin[i:j] - lo, end[i:j] - lo
        out[i:j] = mix64((prefix[e] - prefix[b]) * powers(hi - lo + 1, inverse=True)[b] + (e - b).astype(np.uint64))
        i = j
    return out


def arrow_text(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow text column laid end to end; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: Bits of the bitmaps that keep rows without a partner from being shuffled: a fixed size, whatever the input.
FILTER_BITS = 25


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """A packed bitmap of fixed size over the top bits of a hash column."""
    place = rows.select(F.expr(f"shiftrightunsigned({column}, {64 - FILTER_BITS})").alias("i"))
    words = place.select(F.floor(F.col("i") / 60).alias("w"), F.expr("shiftleft(1L, cast(i % 60 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros((1 << FILTER_BITS) + 60, dtype=bool)
    w, m = words["w"].to_numpy(), words["m"].to_numpy()
    for k in range(60):
        bits[60 * w[(m >> k & 1) > 0] + k] = True
    return np.packbits(bits)


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    i = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[i >> 3] >> (7 - (i & 7)).astype(np.uint8) & 1).astype(bool)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of an undirected graph of (a, b): component is the smallest node reached.

    Alternating large-star and small-star steps; each is a grouped minimum and a join, so no node's
    neighbours are ever gathered. Lineage is cut after each pair of steps. Loops and repeated edges are fine.
    """
    e = materialise(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u points to u's smallest neighbour (or u itself)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u's smaller neighbours and u itself point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        new = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        nxt = materialise(new, "cc")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(e)
        e = nxt
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
