"""Exact substring deduplication over suffix arrays built by Lyndon grouping.

Every window of WINDOW bytes belongs to the rarest-looking k-gram inside it (its minimizer), which is a
function of the window's bytes alone, so equal windows meet wherever they stand. A run of neighbouring windows with one
minimizer is a segment. Segments whose minimizer stands in one place only have no repeat and leave at once.
Equal segments of one minimizer are told by a digest: all but the earliest go. What is left are minimizers with
several different segments, where a repeat begins or ends: their texts are dealt by minimizer into shards of bounded
size, a suffix array per shard brings equal windows together, and all but the earliest go. The segments of a minimizer
that very many share are cut by where the minimizer stands in the window: all windows of such a part share more bytes
around the minimizer, and the part is dealt by these. Only where very many share those too, the earliest windows of
several shards meet once more by digest.

Rows of segments are shuffled once, by minimizer, without text; texts are shuffled once to the list of their segments
that are compared, and where they lose bytes. A text is known by its digest and its row's doc_id, so that equal texts,
which are one class throughout, need no table of classes until their spans are gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_text, bitmap, in_bitmap, let_go, materialise, mix64, powers, release, span_hashes
from .lyndon import suffix_array

WINDOW, GRAM = 100, 32
#: Bytes hashed at once; segments in a shard; segments of one minimizer that are not cut into parts.
PIECE, SHARD_SEGMENTS, TOGETHER = 1 << 18, 800, 256
#: Texts a task remembers; minimizers it holds before it sends them; bytes of text behind one bucket of minimizers.
RECENT, HELD, BUCKET_BYTES = 1 << 17, 1 << 20, 1 << 25
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LOW = np.uint64((1 << 24) - 1)


def class_key(text: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def segments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, minimizer hash, its place, first window, last window) of the segments of texts laid end to end; places are in the text.

    Works on pieces of bounded size, whatever the lengths of texts; windows never cross a text's end.
    """
    out = []
    for lo in range(0, max(0, len(data) - window + 1), PIECE):
        part = data[lo : lo + PIECE + window - 1]
        if len(part) < window:
            break
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[part] * powers(len(part)), out=prefix[1:])
        h = mix64((prefix[gram:] - prefix[:-gram]) * powers(len(part) - gram + 1, inverse=True))
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # of equal grams the leftmost
        span, have = window - gram + 1, 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        p = (least & _LOW).astype(np.int64)
        # windows that begin less than a window before their text's end belong to no text
        i, j = np.searchsorted(offsets, [lo, lo + len(p)], side="right")
        ends = offsets[max(i, 1) : j + 1]
        step = np.zeros(len(p) + 1, dtype=np.int32)
        np.add.at(step, np.clip(np.maximum(ends - window + 1, offsets[max(i, 1) - 1 : max(i, 1) - 1 + len(ends)]) - lo, 0, len(p)), 1)
        np.add.at(step, np.clip(ends - lo, 0, len(p)), -1)
        whole = np.cumsum(step[:-1]) == 0
        new = np.r_[True, (p[1:] != p[:-1]) | (whole[1:] != whole[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(p)] - 1
        keep = whole[first]
        first, last = first[keep], last[keep]
        owner = np.searchsorted(offsets, first + lo, side="right") - 1
        begin = lo - offsets[owner]
        out.append((owner, h[p[first]], p[first] + begin, first + begin, last + begin))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    owner, fp, p, first, last = (np.concatenate(c) for c in zip(*out))
    # a segment that two pieces have is one, so that segments of a text do not depend on what lies before it
    new = np.r_[True, (owner[1:] != owner[:-1]) | (p[1:] != p[:-1])]
    return owner[new], fp[new], p[new], first[new], last[np.r_[new[1:], True]]


class Texts:
    """Texts of at least ``window`` bytes laid end to end, each with its key and its row's place in the order (d, r)."""

    def __init__(self, raws: list[bytes], keys: list[tuple[int, int]], order: list[tuple[int, int]]):
        self.raws = raws
        self.k1, self.k2, self.d, self.r = (np.array([x[i] for x in rows], np.int64) for rows in (keys, order) for i in (0, 1))
        self.data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        self.offsets = np.r_[0, np.cumsum([len(r) for r in raws])].astype(np.int64)


def distinct_texts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[Texts]:
    """Of batches (text, d, r): texts lately seen in this task are left out, unless this row is earlier than that one."""
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    raws, keys, order, size = [], [], [], 0
    for batch in batches:
        data, offsets = arrow_text(batch.column(0))
        for a, b, *at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if b - a >= least:
                raw = data[a:b].tobytes()
                key = class_key(raw)
                if key not in seen or tuple(at) < seen[key]:
                    seen[key] = tuple(at)
                    raws.append(raw)
                    keys.append(key)
                    order.append(seen[key])
                    size += len(raw)
                    if size >= PIECE:
                        yield Texts(raws, keys, order)
                        raws, keys, order, size = [], [], [], 0
        if len(seen) > RECENT:
            seen.clear()
    if raws:
        yield Texts(raws, keys, order)


def extremes(fp: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every fp its smallest and its largest place, as one entry or two."""
    order = np.lexsort((place, fp))
    fp, place = fp[order], place[order]
    first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
    last = np.r_[first[1:], len(fp)] - 1
    last = last[place[last] != place[first]]
    keep = np.sort(np.r_[first, last])
    return fp[keep], place[keep]


def repeated_minimizers(texts: DataFrame, total: int, window: int, gram: int) -> DataFrame:
    """fp: minimizer hashes that stand in at least two places (of different texts, or of one).

    A task reduces what it has to two places per hash, and sends hashes to buckets of a bounded size (their number
    grows with ``total`` bytes) as packed pairs of 16 bytes, a fraction of what rows would take.
    """
    buckets = max(64, -(-total // BUCKET_BYTES))

    def run(batches):
        parts: list[list] = [[], []]
        size = 0

        def send() -> pa.RecordBatch:
            fp, place = extremes(np.concatenate(parts[0]), np.concatenate(parts[1]))
            at = (fp >> np.uint64(20)) % np.uint64(buckets)  # bits that neither the sort nor the filter looks at first
            order = np.argsort(at, kind="stable")
            pairs = np.ascontiguousarray(np.stack([fp[order], place[order]], axis=1))
            first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            blobs = [pairs[x:y].tobytes() for x, y in zip(first.tolist(), [*first[1:].tolist(), len(pairs)])]
            return pa.RecordBatch.from_arrays([pa.array(at[order][first].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "pairs"])

        for t in distinct_texts(batches, window):
            owner, fp, p, _, _ = segments(t.data, t.offsets, window, gram)
            parts[0].append(fp)
            parts[1].append(mix64(mix64(p.astype(np.uint64)) ^ t.k1[owner].view(np.uint64)))
            size += len(fp)
            if size > HELD:
                yield send()
                parts, size = [[], []], 0
        if size:
            yield send()

    def meet(bucket: pa.Table) -> pa.Table:
        pairs = np.frombuffer(b"".join(bucket["pairs"].to_pylist()), dtype=np.uint64).reshape(-1, 2)
        fp, _ = extremes(pairs[:, 0], pairs[:, 1])
        return pa.table({"fp": pa.array(fp[1:][fp[1:] == fp[:-1]].view(np.int64))})

    return texts.mapInArrow(run, "bucket int, pairs binary").groupBy("bucket").applyInArrow(meet, "fp long")


def occurrences(texts: DataFrame, bits, window: int, gram: int) -> DataFrame:
    """fp, seg, d, r, k1, place, known: segments whose minimizer is in the bitmap; seg is a digest.

    ``place`` has the minimizer's place and how far before it the first and the last window begin, each below ``span``.
    ``known``: an equal segment stands earlier in this task. Such rows need not meet any other, so their fp is one of
    their own: what very many texts share does not go to one task.
    """
    span = window - gram + 1
    names = ["fp", "seg", "d", "r", "k1", "place"]

    def run(batches):
        seen: dict[tuple[int, int], tuple[int, ...]] = {}
        for t in distinct_texts(batches, window):
            owner, fp, p, a, b = segments(t.data, t.offsets, window, gram)
            hit = np.flatnonzero(in_bitmap(bits.value, fp))
            if len(hit):
                owner, fp, p, a, b = owner[hit], fp[hit], p[hit], a[hit], b[hit]
                seg = span_hashes(t.data, t.offsets[owner] + a, t.offsets[owner] + b + window, _VALUES)
                d, r, k1, place = t.d[owner], t.r[owner], t.k1[owner], (p * span + p - a) * span + p - b
                known = np.zeros(len(hit), dtype=bool)
                for i, (key, now) in enumerate(zip(zip(fp.tolist(), seg.tolist()), zip(d.tolist(), r.tolist(), place.tolist(), k1.tolist()))):
                    was = seen.get(key)
                    if was is None or now < was:
                        seen[key] = now
                    else:
                        known[i] = was[0] != now[0] or was[2:] != now[2:]  # a copy of the same row's text is no repeat
                if len(seen) > RECENT:
                    seen.clear()
                own = mix64(seg ^ mix64(place.view(np.uint64) ^ mix64(k1.view(np.uint64) ^ r.view(np.uint64))))
                parts = (np.where(known, own, fp).view(np.int64), seg.view(np.int64), d, r, k1, place)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in parts), pa.array(known)], names=[*names, "known"])

    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", known boolean")


PART = "key long, d long, r long, k1 long, start long, text binary"


def parts_of(p: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(segment, first window, last window, begin and end of the bytes that all windows of the part share) for each part of segments.

    A part has the windows in which the minimizer stands between two places; equal windows are in the same part.
    """
    span = window - gram + 1
    for j in range(parts):
        low, high = j * span // parts, (j + 1) * span // parts - 1
        first, last = np.maximum(a, p - high), np.minimum(b, p - low)
        own = np.flatnonzero(first <= last)
        yield own, first[own], last[own], p[own] - low, p[own] - high + window


def cut_segments(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """PART rows from (d, k1, r, raw, found: fp, p, a, b, parts): the text of each segment, or of each of its parts."""
    for batch in batches:
        d, k1, r = (batch.column(i).to_numpy() for i in range(3))
        raws, found = batch.column(3).to_pylist(), batch.column(4)
        owner = np.repeat(np.arange(len(raws)), np.diff(found.offsets.to_numpy()))
        fp, p, a, b, parts = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in found.flatten().flatten())
        order = np.lexsort((p, owner))
        owner, fp, p, a, b, parts = (x[order] for x in (owner, fp, p, a, b, parts))
        data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        begin = np.cumsum([0] + [len(x) for x in raws])[:-1]
        for n in np.unique(parts).tolist():
            of = np.flatnonzero(parts == n)
            for j, (own, first, last, x, y) in enumerate(parts_of(p[of], a[of], b[of], n, window, gram)):
                own = of[own]
                o, key = owner[own], fp[own].view(np.uint64)
                if n > 1:
                    key = mix64(span_hashes(data, begin[o] + x, begin[o] + y, _VALUES) ^ mix64(key + np.uint64(j)))
                texts = [raws[i][s:e] for i, s, e in zip(o.tolist(), first.tolist(), (last + window).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key.view(np.int64), d[o], r[o], k1[o], first)] + [pa.array(texts, pa.binary())], names=["key", "d", "r", "k1", "start", "text"])


SPAN = "k1 long, d long, r long, start long, stop long, window binary"


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(PART rows, whether other shards have rows of this one's key) from rows in the order of keys: whole keys, as far as ``most`` rows hold them."""
    held, carried = None, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        while held.num_rows > most:
            keys = held["key"].to_numpy()
            ends = np.flatnonzero(keys[1 : most + 1] != keys[:most]) + 1  # where a new key begins
            cut = int(ends[-1]) if len(ends) else most
            split = np.zeros(cut, dtype=bool) if carried is None else keys[:cut] == carried
            carried = None
            if not len(ends):
                split, carried = np.ones(cut, dtype=bool), int(keys[0])
            yield held.slice(0, cut), split
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held, np.zeros(held.num_rows, dtype=bool) if carried is None else held["key"].to_numpy() == carried


def equal_windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, is later) of every window: it is later if an equal one stands in an earlier text, or earlier in its own.

    A suffix array of all texts end to end, by Lyndon grouping, brings equal windows together.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.r_[0, np.cumsum(size + 1)]
    raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    joined = raw.astype(np.int64) + 1
    joined[at[1:] - 1] = 0  # ends of texts are below all bytes
    sa = suffix_array(joined)
    owner = np.searchsorted(at, sa, side="right") - 1
    begins = sa - at[owner] + window <= size[owner]
    sa, owner = sa[begins], owner[begins]
    rows = np.lib.stride_tricks.sliding_window_view(raw, window)
    same = np.zeros(len(sa), dtype=bool)
    for lo in range(1, len(sa), 20_000):
        hi = min(len(sa), lo + 20_000)
        same[lo:hi] = (rows[sa[lo:hi]] == rows[sa[lo - 1 : hi - 1]]).all(axis=1)
    group = np.cumsum(~same)
    order = np.lexsort((sa, group))
    sa, owner, group = sa[order], owner[order], group[order]
    return owner, sa - at[owner], np.r_[False, group[1:] == group[:-1]]


def compare_shard(part: pa.Table, split: np.ndarray, window: int) -> pa.Table:
    """Removed spans of a shard's segments, and the earliest windows of those that other shards share (``split``).

    Windows whose rolling hash stands once in the shard repeat nothing here, so the suffix array is built
    over the runs of the others, equal runs once.
    """
    order = np.lexsort([part[c].to_numpy() for c in ("start", "r", "d")])  # earliest first
    part, split = part.take(order), split[order].tolist()
    texts = part["text"].to_pylist()
    k1, d, r, start = (part[c].to_numpy() for c in ("k1", "d", "r", "start"))
    start = start.tolist()
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.cumsum(size) - size
    count = size - window + 1
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[raw] * powers(len(raw)), out=prefix[1:])
    x = at[owner] + place
    h = (prefix[x + window] - prefix[x]) * powers(len(raw) + 1, inverse=True)[x]
    _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    # runs of windows that may repeat
    hit = np.flatnonzero(again)
    head = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)]) if len(hit) else hit
    tail = np.r_[head[1:], len(hit)] - 1 if len(hit) else hit
    spans: list[tuple[int, int, int]] = []  # (segment, first window, last window) that go
    known: dict[bytes, int] = {}
    runs: list[tuple[int, int]] = []
    for o, a, b in zip(owner[hit[head]].tolist(), place[hit[head]].tolist(), place[hit[tail]].tolist()):
        text = texts[o][a : b + window]
        if text in known:
            spans.append((o, a, b))
        else:
            known[text] = len(runs)
            runs.append((o, a))
    stay: list[tuple[int, int]] = []
    if runs:
        of, where, later = equal_windows(list(known), window)
        run_owner, run_at = (np.array(c) for c in zip(*runs))
        of, where = run_owner[of], run_at[of] + where
        gone = np.lexsort((where[later], of[later]))
        go, gw = of[later][gone], where[later][gone]
        head = np.flatnonzero(np.r_[True, (np.diff(gw) != 1) | (np.diff(go) != 0)]) if len(go) else go
        tail = np.r_[head[1:], len(go)] - 1 if len(go) else go
        spans += zip(go[head].tolist(), gw[head].tolist(), gw[tail].tolist())
        stay = list(zip(of[~later].tolist(), where[~later].tolist()))
    once = np.flatnonzero(~again)
    stay += zip(owner[once].tolist(), place[once].tolist())
    stay = [(o, w) for o, w in stay if split[o]]
    o = np.array([s[0] for s in spans] + [s[0] for s in stay], dtype=np.int64)
    digests = [hashlib.blake2b(texts[i][w : w + window], digest_size=16).digest() for i, w in stay]
    return pa.table({
        "k1": pa.array(k1[o]), "d": pa.array(d[o]), "r": pa.array(r[o]), "start": pa.array([start[i] + a for i, a, _ in spans] + [start[i] + w for i, w in stay], pa.int64()),
        "stop": pa.array([start[i] + b + window for i, _, b in spans] + [start[i] + w + window for i, w in stay], pa.int64()),
        "window": pa.array([None] * len(spans) + digests, pa.binary()),
    })


def found_segments(texts: DataFrame, repeated: DataFrame, window: int, gram: int) -> DataFrame:
    """d, k1, place, r, fp, n: with fp null, segments that equal an earlier one; else the earliest ones of minimizers with n > 1 different segments."""
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(repeated, "fp"))
    same, one = Window.partitionBy("fp", "seg").orderBy("d", "r", "place"), Window.partitionBy("fp")
    meets = repeated.withColumn("meets", F.lit(True)).hint("merge")
    rows = occurrences(texts, bits, window, gram).join(meets, "fp", "left").where("known or meets")
    rows = rows.withColumn("at", F.row_number().over(same))
    rows = rows.withColumn("later", F.col("known") | (F.struct("d", "k1", "place") != F.first(F.struct("d", "k1", "place")).over(same)))
    rows = rows.withColumn("n", F.sum((~F.col("known") & (F.col("at") == 1)).cast("long")).over(one)).where("later or (at = 1 and n > 1)")
    return rows.select("d", "k1", "place", *(F.when(~F.col("later"), F.col(c)).alias(c) for c in ("r", "fp", "n")))


def removed_spans(texts: DataFrame, firsts: DataFrame, total: int, window: int, gram: int) -> DataFrame:
    """(k1, k2, spans): the spans (start, stop) of class texts that repeat earlier ones; they may overlap.

    ``texts`` has (text, d, r); ``firsts`` has (k1, k2, d): the first row of each class. ``total``: bytes of all texts.
    """
    spark, span = texts.sparkSession, window - gram + 1
    repeated = materialise(repeated_minimizers(texts, total, window, gram), "minimizers")
    let_go(spark)
    found = materialise(found_segments(texts, repeated, window, gram), "segments")
    release(repeated)
    let_go(spark)
    p = F.expr(f"place div {span * span}").alias("p")
    a, b = (p - F.expr(f"place div {span} % {span}")).alias("a"), (p - F.expr(f"place % {span}")).alias("b")
    parts = F.when(F.col("n") <= TOGETHER, 1).when(F.col("n") <= 16 * TOGETHER, 2).when(F.col("n") <= 256 * TOGETHER, 4).otherwise(8).alias("parts")
    lists = found.where("fp is not null").groupBy("d", "k1").agg(F.min("r").alias("r"), F.collect_list(F.struct("fp", p, a, b, parts)).alias("found"))

    def whole(batches):
        for t in distinct_texts(batches, window):
            yield pa.RecordBatch.from_arrays([pa.array(t.d), pa.array(t.k1), pa.array(t.raws, pa.binary())], names=["d", "k1", "raw"])

    raw = texts.mapInArrow(whole, "d long, k1 long, raw binary").join(lists, ["d", "k1"]).dropDuplicates(["d", "k1"]).select("d", "k1", "r", "raw", "found")
    dealt = raw.mapInArrow(lambda batches: cut_segments(batches, window, gram), PART).repartition("key").sortWithinPartitions("key")

    def compare(batches):
        for part, split in shards(batches, SHARD_SEGMENTS):
            yield from compare_shard(part, split, window).to_batches()

    compared = materialise(dealt.mapInArrow(compare, SPAN), "compared")
    let_go(spark)
    each = ["d", "k1", "start", "stop"]
    spans = [found.where("fp is null").select("d", "k1", a.alias("start"), (b + window).alias("stop")), compared.where("window is null").select(*each)]
    meet = Window.partitionBy("window").orderBy("d", "r", "start")
    spans.append(compared.where("window is not null").withColumn("at", F.row_number().over(meet)).where("at > 1").select(*each))
    out = spans[0].unionByName(spans[1]).unionByName(spans[2]).repartition("d", "k1").groupBy("d", "k1").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    out = materialise(out.join(firsts, ["d", "k1"]).select("k1", "k2", "spans"), "spans")
    release(found)
    release(compared)
    let_go(spark)
    return out


def cut_texts(texts: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """k1, k2, n_removed, n_spans, kept_sha256, kept (bytes) for the classes that have spans (k1, k2, spans)."""
    per_class = spans
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(per_class, "k1"))

    def fetch(batches):
        for t in distinct_texts(batches, window):
            hit = np.flatnonzero(in_bitmap(bits.value, t.k1.view(np.uint64)))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(t.k1[hit]), pa.array(t.k2[hit]), pa.array([t.raws[i] for i in hit.tolist()], pa.binary())], names=["k1", "k2", "raw"])

    def cut(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for k1, k2, raw, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                runs: list[list[int]] = []
                for s in spans:
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["stop"])
                    else:
                        runs.append([s["start"], s["stop"]])
                at, kept = 0, []
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join(kept) + raw[at:]
                for row, v in zip(rows, (k1, k2, sum(b - a for a, b in runs), len(runs), hashlib.sha256(rest).hexdigest(), rest)):
                    row.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (*[pa.int64()] * 4, pa.string(), pa.binary()))], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    raw = texts.mapInArrow(fetch, "k1 long, k2 long, raw binary").join(per_class, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return raw.select("k1", "k2", "raw", "spans").mapInArrow(cut, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, r, n_bytes, k1, k2, sha: r numbers the rows inside a doc_id's ties, sha is of the whole text."""

    def run(batches):
        for batch in batches:
            data, offsets = arrow_text(batch.column(1))
            raws = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            keys = [class_key(x) for x in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raws], pa.string())],
                names=["doc_id", "n_bytes", "k1", "k2", "sha"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, k1 long, k2 long, sha string")
    return rows.withColumn("r", F.monotonically_increasing_id())


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    Each byte goes that lies in a string of ``window`` bytes which also starts earlier: in a smaller doc_id
    (null first), or, between rows of one doc_id, in an earlier row, or earlier in the same text. Null text is empty; texts shorter than the
    window stay; other columns are left out; an empty table gives no rows.
    """
    rows = materialise(describe(docs), "texts")
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("d")
    texts = docs.select(F.col("text").cast("string").alias("text"), d, F.monotonically_increasing_id().alias("r"))
    order = F.struct(d, "r")
    firsts = rows.where(F.col("n_bytes") >= window).groupBy("k1", "k2").agg(F.min(order).alias("o")).select("k1", "k2", "o.d", "o.r")
    firsts = materialise(firsts, "firsts")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    spans = removed_spans(texts, firsts, total, window, gram)
    cut = materialise(cut_texts(texts, spans, window).drop("kept"), "cut")
    release(spans)
    first_rows = firsts.select("k1", "k2", F.col("r").alias("first_r")).join(cut, ["k1", "k2"], "left")
    out = rows.join(first_rows, ["k1", "k2"], "left")
    whole = F.col("first_r").isNotNull() & (F.col("first_r") != F.col("r"))
    none, empty = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
