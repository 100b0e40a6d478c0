"""Toxicity by compression distance: two zstandard dictionaries, one trained on ordinary and one on toxic text.

Each window of a few words is compressed with the ordinary dictionary and with the ordinary dictionary
followed by the toxic one, since toxic documents are mostly ordinary prose; what the toxic text saves is the window's
distance. Windows count by how far their distance is above a threshold, a document by its windows. The windows'
threshold, the weight of a document's length and the map from its distance to a probability are calibrated on labelled rows
which neither dictionary has seen.

What in a toxic document is toxic is found in rounds. The documents are split in halves, a dictionary of one half
measures the windows of the other, and the words that stand in toxic documents far beyond their share in ordinary
ones, wherever those windows hold them, are the samples that zstandard trains the next round's dictionary on.

Only the training reads labels, on at most FIT rows per class and CALIBRATE rows (documented bounds, chosen by
hash), and reads their texts whole: tasks cut them into windows and measure them. A row gives at most ROW_WINDOWS of
its distinct windows, drawn from anywhere in its text, and each side the KEPT ones that most of its rows gave, so that
what the driver gets is bounded however long the texts are. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import materialise, release

FIT, CALIBRATE = 1000, 4000
#: Distinct windows that a training row gives at most, and that each half and the ordinary side keep.
ROW_WINDOWS, KEPT = 4096, 1 << 19
FOLDS, HELD_OUT, CALIBRATION_FOLD = 4, 2, 3
THRESHOLD = 0.3
#: Words in a window and from one window to the next, when scoring and when training.
WINDOW, STRIDE, FIT_WINDOW, FIT_STRIDE = 4, 3, 2, 1
ORDINARY_BYTES, TOXIC_BYTES, LEVEL, ROUNDS = 32_768, 4096, 3, 3
#: Thresholds of a window's distance and powers of a document's length to choose from.
THRESHOLDS, POWERS = (0, 1, 2, 3, 4), (0.5, 0.75, 1.0)
#: A word is taken if it stands in so many windows of one half, at least and per document.
SEEN, SEEN_SHARE = 5, 0.02
#: Words of a half, best savers first, that samples are taken of.
WORDS = 1000


def windows(text: str, size: int = WINDOW, stride: int = STRIDE) -> list[bytes]:
    w = text.lower().split()
    return [f" {' '.join(w[i : i + size])} ".encode() for i in range(0, max(1, len(w) - size + stride), stride)] if w else []


def compressor(content: bytes):
    import zstandard

    if len(content) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def lengths(c, parts: list[bytes]) -> np.ndarray:
    compress = c.compress
    return np.fromiter((len(compress(p)) for p in parts), dtype=np.int32, count=len(parts))


def trained(parts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of these samples; too few samples stand for themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: int = 2
    power: float = 0.75
    #: Calibration: distances and probabilities of its knots, both rising.
    at: tuple[float, ...] = (0.0,)
    probability: tuple[float, ...] = (0.0,)

    def measure(self, text: str, plain, both) -> list[float]:
        """Per threshold the sum of what windows are above it, and the number of windows."""
        parts = windows(text)
        if not parts:
            return [0.0] * len(THRESHOLDS) + [1.0]
        x = lengths(plain, parts) - lengths(both, parts)
        return [float(np.maximum(x - t, 0).sum()) for t in THRESHOLDS] + [float(len(parts))]

    def distance(self, measured: np.ndarray) -> np.ndarray:
        return measured[:, THRESHOLDS.index(self.threshold)] / measured[:, -1] ** self.power

    def score(self, measured: np.ndarray) -> np.ndarray:
        return np.interp(self.distance(measured), self.at, self.probability) if len(measured) else np.zeros(0)

    def calibrate(self, measured: np.ndarray, toxic: np.ndarray) -> None:
        """The threshold and power that rank best, then rising probabilities by pooling neighbours that are out of order."""
        best = -1.0
        for t in THRESHOLDS:
            for power in POWERS:
                x = measured[:, THRESHOLDS.index(t)] / measured[:, -1] ** power
                if (rank := ranking(x, toxic)) > best:
                    best, self.threshold, self.power = rank, t, power
        x = self.distance(measured)
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # sum of distances, of labels, and rows
        for a, y in zip(x[order].tolist(), toxic[order].tolist()):
            pools.append([a, y, 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], last)]
        self.at = tuple(p[0] / p[2] for p in pools)
        self.probability = tuple(p[1] / p[2] for p in pools)

    def scorers(self):
        return compressor(self.ordinary), compressor(self.ordinary + self.toxic)


def ranking(x: np.ndarray, y: np.ndarray) -> float:
    """The chance that a toxic row ranks above another (ties count half)."""
    n1 = y.sum()
    if not 0 < n1 < len(y):
        return 0.5
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)))


def train(half: list[list[bytes]], plain: list[bytes], toxic: int) -> Model:
    """The two dictionaries from the distinct windows of two halves of ``toxic`` texts, and of ordinary ones."""
    model = Model()
    half, plain = [sorted(h) for h in half], sorted(plain)
    if toxic and plain:
        rng = np.random.default_rng(1)
        rng.shuffle(plain)
        model.ordinary = trained(plain[: len(plain) // 2 + 1], ORDINARY_BYTES)
        counted = Counter(w.strip(".,;:!?") for p in plain[len(plain) // 2 :] for w in p.decode().split())
        share = [len(h) / max(1, len(plain) - len(plain) // 2) for h in half]
        base = compressor(model.ordinary)
        before = [lengths(base, h) for h in half]
        parts = [trained(h, 2 * TOXIC_BYTES) for h in half]
        seen, samples = max(SEEN, SEEN_SHARE * toxic / 2), [[], []]
        for _ in range(ROUNDS):
            for k in (0, 1):
                gain = before[k] - lengths(compressor(model.ordinary + parts[1 - k]), half[k])
                by_word: dict[str, list[int]] = defaultdict(list)
                for p, g in zip(half[k], gain.tolist()):
                    for w in p.decode().split():
                        by_word[w.strip(".,;:!?")].append(g)
                keep = sorted((sum(v) / (len(v) + 3), w) for w, v in by_word.items() if len(v) >= seen + 5 * counted[w] * share[k])
                chosen = {w for _, w in keep[-WORDS:]}
                samples[k] = [f" {w} ".encode() for p in half[k] for w in p.decode().split() if w.strip(".,;:!?") in chosen]
            parts = [trained(x, TOXIC_BYTES) for x in samples]
        model.toxic = trained(samples[0] + samples[1], TOXIC_BYTES)
    return model


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out fold.

    The sample is chosen among ids and labels, at most FIT + FIT + CALIBRATE of them, so that the join with
    the texts broadcasts it. Of documents that repeat a labelled id one is used. Long texts are read whole, and
    give as many windows as a text of ROW_WINDOWS distinct ones.
    """
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.withColumn("f", fold(F.col("doc_id"))).where(F.col("f") != HELD_OUT)
    pick = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(n)
    learn = known.where(F.col("f") != CALIBRATION_FOLD)
    sample = (
        pick(learn.where("toxic = 1"), FIT)
        .unionByName(pick(learn.where("toxic = 0"), FIT))
        .unionByName(pick(known.where(F.col("f") == CALIBRATION_FOLD), CALIBRATE))
    )
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    # one row per sampled label: of documents that share an id, the text with the smallest digest
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "f").agg(F.min(F.struct("digest", "text")).alias("d"))
    rows = materialise(rows.select("doc_id", "toxic", "f", "d.digest", "d.text"), "toxicity-sample")
    learn, calibrate = rows.where(F.col("f") != CALIBRATION_FOLD), rows.where(F.col("f") == CALIBRATION_FOLD)
    # copies are one text, and stand in one half: halves are dealt by digest
    toxic = sorted(r.digest for r in learn.where("toxic = 1").select("digest").distinct().collect())
    dealt = docs.sparkSession.createDataFrame([(d, k % 2) for k, d in enumerate(toxic)], "digest string, side int")
    sides = learn.where("toxic = 1").join(F.broadcast(dealt), "digest").select("side", "text").unionByName(learn.where("toxic = 0").select(F.lit(2).alias("side"), "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(*(c.to_pylist() for c in batch.columns)):
                w = sorted(set(windows(text, FIT_WINDOW, FIT_STRIDE)))
                if len(w) > ROW_WINDOWS:  # each row draws its own, so that what many rows hold is met
                    seed = xxhash.xxh64_intdigest(text.encode())
                    w = sorted(w, key=lambda x: (xxhash.xxh64_intdigest(x, seed), x))[:ROW_WINDOWS]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(w), pa.int32()), pa.array(w, pa.binary())], names=["side", "w"])

    found = materialise(sides.mapInArrow(cut, "side int, w binary").groupBy("side", "w").agg(F.count("*").alias("rows")), "toxicity-windows")
    most = lambda k: found.where(F.col("side") == k).orderBy(F.desc("rows"), F.xxhash64("w"), "w").limit(KEPT)
    of = lambda k: most(k).select("w").toArrow()["w"].to_pylist()
    model = train([of(0), of(1)], of(2), len(toxic))
    release(found)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, both = model.scorers()
        for batch in batches:
            x = [model.measure(t, plain, both) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    measured = calibrate.select("doc_id", "toxic", "text").mapInArrow(measure, "doc_id long, toxic int, x array<double>").collect()
    if measured:
        measured.sort(key=lambda r: (r.doc_id, r.x, r.toxic))
        model.calibrate(np.array([r.x for r in measured]), np.array([r.toxic for r in measured], dtype=float))
    release(rows)
    return model


def scored(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """(row, score, predicted): each row of ``docs`` as one struct, so that no name of its own can clash."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, both = model.scorers()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                score = model.score(np.array([model.measure(t or "", plain, both) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    return boxed.mapInArrow(run, T.StructType([boxed.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold) added; only ``text`` is an input.

    Null and empty texts have no windows and get the score of a text without any distance. Very long texts are
    scored whole. Equal texts have equal scores. All rows stay, repeated ones each; an empty table gives no rows.
    Columns of the input named score or predicted give way to the model's.
    """
    x = scored(docs, model, threshold)
    return x.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("score", "predicted")], "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns as they are, whatever their names, without the rows that score ``threshold`` or more.

    Null and empty texts stay. Without labels nothing is toxic. An empty table gives no rows.
    """
    return scored(docs, fit(docs, labels), threshold).where("predicted = 0").select("row.*")
