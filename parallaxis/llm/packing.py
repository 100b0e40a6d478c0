"""Packing by lexical retrieval: each shard of documents has a BM25 inverted index; a seed document's
window is filled greedily with its best unused neighbours.

Texts are tokenised whole, once, into a scratch table of ids. Each document samples the terms (pairs of adjacent
ids) with its smallest hashes; sampled terms that other documents have sampled too bring documents together: a
shuffle puts documents that share such a term next to each other, so that a shard holds a seed's nearest neighbours
from all over the corpus. Terms that very many documents share are split over several tasks. Document count, mean length and
document frequencies (a count sketch of a fixed size) are those of all documents, so that weights do not depend on the shard.
Every task streams its documents, keeps one shard (a bounded number of documents and tokens) in memory, and
emits the pieces. Nothing is padded: windows are full, and what a task has left over is cut into sequences whose
lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_text, bitmap, give_back, in_bitmap, materialise, mix64, release, span_hashes, word_spans, word_table

WINDOW, END_ID = 4096, 2
SHARD_DOCS, SHARD_TOKENS = 1024, 1 << 21
#: Terms a document samples; tokens behind one task; documents that one term brings together; counters of the sketch.
SAMPLED, TASK_TOKENS, TOGETHER, SKETCH_BITS, CHUNKS = 8, 1 << 22, 1024, 20, 16
CACHE_WORDS = 200_000
K1, B = 1.2, 0.75
#: Words in which normalisation, case and classes are plain: printable ASCII and Latin letters that are already composed.
_PLAIN = regex.compile(r"[\x21-\x7E¡-įı-ž]*")
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

#: Words are cut at spaces and line feeds only; other white space stays in a word, which then isn't plain.
_CUTS = np.zeros(256, dtype=bool)
_CUTS[[0x20, 0x0A]] = True
_IS_WORD, _VALUES = word_table(_CUTS, lower=False)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = True
TEXT_BYTES = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Token ids of whole texts by a word-end BPE file of the ``tokenizers`` library, through a cache of two bounded generations.

    White space always separates words in this kind of vocabulary, so a text's ids are its words' ids in
    order. Words outside the plain class go to the library itself. Plain words go through a merge table made
    of the same file: the marker byte stands for the word's end, and a merged string's rank is its merge's
    rank. That gives the library's ids because each string in the table is what the library makes of that
    string alone; ``reachable`` checks it, and the tests run it over the whole vocabulary.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte = {c: b for b, c in letter.items()}

        def raw(token: str) -> bytes:
            if token.endswith(suffix):
                return bytes(byte[c] for c in token[: -len(suffix)]) + b"\0"
            return bytes(byte[c] for c in token)

        ranks: dict[bytes, int] = {}
        ids: list[int] = []

        def add(key: bytes, token_id: int) -> None:
            if key not in ranks:
                ranks[key] = len(ids)
                ids.append(token_id)

        for b in range(256):
            add(bytes([b]), vocabulary.get(letter[b], 0))
        for b in range(1, 256):
            add(bytes([b, 0]), vocabulary.get(letter[b] + suffix, 0))
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            add(raw(left) + raw(right), vocabulary[left + right])
        self.ranks, self.ids = ranks, np.array(ids, dtype="<u4")
        self.encode = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.final = np.zeros(len(ids), dtype=bool)
        self.final[[r for key, r in ranks.items() if key.endswith(b"\0")]] = True
        self.seen: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def word(self, word: str) -> bytes:
        if "<|" in word or not _PLAIN.fullmatch(word):
            return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.ids[self.encode("\0".join(_PARTS.findall(word.lower())) + "\0")].tobytes()

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of these words, of plain ones by one call."""
        out: list[bytes] = [b""] * len(words)
        plain = range(len(words))
        if not _PLAIN.fullmatch("".join(words)):
            plain = [i for i in plain if _PLAIN.fullmatch(words[i])]
            for i in set(range(len(words))).difference(plain):
                out[i] = self.word(words[i])
        marked, count = [], []
        for i in plain:
            w = words[i]
            if w.isalpha():
                marked.append(w)
                count.append(1)
            else:
                parts = _PARTS.findall(w.lower())
                marked += parts
                count.append(len(parts))
        if marked:
            got = np.array(self.encode("\0".join(marked).lower() + "\0"))
            ends = 4 * (np.flatnonzero(self.final[got]) + 1)
            raw, at = self.ids[got].tobytes(), 0
            for i, stop in zip(plain, ends[np.cumsum(count) - 1].tolist()):
                out[i] = raw[at:stop]
                at = stop
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Unsigned 32-bit ids of whole texts laid end to end (UTF-8 bytes, and where the texts begin).

        Words are found and hashed by the batch, and only distinct ones are looked up. A full stop or comma
        behind a letter is a word of its own, as it is for the library.
        """
        if data.tobytes().find(b"<|") >= 0:  # may hold a special token, in which case matters
            return [np.array(self.library.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids, dtype="<u4") for a, b in zip(offsets, offsets[1:])]
        data = _LOWER[data]
        begin, end = word_spans(data, offsets, _IS_WORD)
        last = data[end - 1] if len(end) else end
        split = ((last == 0x2E) | (last == 0x2C)) & (end - begin > 1)
        split[split] = _LETTER[data[end[split] - 2]]
        order = np.arange(len(begin)) + np.cumsum(split) - split
        n = len(begin) + int(split.sum())
        b, e = np.empty(n, np.int64), np.empty(n, np.int64)
        b[order], e[order] = begin, end - split
        b[order[split] + 1], e[order[split] + 1] = end[split] - 1, end[split]
        hashes, first, inverse = np.unique(span_hashes(data, b, e, _VALUES), return_index=True, return_inverse=True)
        if len(self.seen) > CACHE_WORDS:
            self.old, self.seen = self.seen, {}
        keys = hashes.tolist()
        ids = list(map(self.seen.get, keys))
        unseen = [i for i, v in enumerate(ids) if v is None]
        if unseen and self.old:
            for i in unseen:
                if (v := self.old.get(keys[i])) is not None:
                    ids[i] = self.seen[keys[i]] = v
            unseen = [i for i in unseen if ids[i] is None]
        if unseen:
            raw = data.tobytes()
            at = first[unseen]
            for i, v in zip(unseen, self.learn([raw[x:y].decode() for x, y in zip(b[at].tolist(), e[at].tolist())])):
                ids[i] = self.seen[keys[i]] = v
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, place = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size
        count = size[inverse]
        upto = np.r_[0, np.cumsum(count)]
        out = flat[np.arange(upto[-1]) + np.repeat(place[inverse] - upto[:-1], count)]
        cut = upto[np.searchsorted(b, offsets)]
        return [out[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def text(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.texts(raw, np.array([0, len(raw)]))[0]


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def hashed_pairs(ids: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of adjacent ids."""
    a = ids.astype(np.uint64)
    return mix64((a[:-1] << np.uint64(32)) | a[1:])


@dataclass(frozen=True)
class Corpus:
    """What the weights need to know of all documents: their number, their mean length, and a sketch of frequencies."""

    size: int
    mean: float
    sketch: np.ndarray


class Shard:
    """Documents waiting to be packed: ids end to end, and an inverted index over what is left of each."""

    def __init__(self, window: int, corpus: Corpus | None = None):
        self.window, self.corpus, self.docs, self.size = window, corpus, [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.size += len(ids)

    def index(self, left: list[int]) -> None:
        """Postings of pairs of adjacent ids with their BM25 weights, by term and by document.

        Documents with equal rests are one entry, which counts as often as they are. A term in one document
        only finds nothing; all others stay, by their weight.
        """
        n = len(self.docs)
        keys, lengths, seen = [], np.zeros(n), {}
        self.entry, entry_length = np.zeros(n, dtype=np.int64), []
        for j, (_, ids) in enumerate(self.docs):
            a = ids[left[j] :]
            lengths[j] = len(a)
            i = self.entry[j] = seen.setdefault(a.tobytes(), len(seen))
            if i < len(entry_length):
                continue
            entry_length.append(len(a))
            a = a.astype(np.uint64)
            if len(a) > 1:
                keys.append(((a[:-1] << np.uint64(16)) + a[1:] << np.uint64(12)) + np.uint64(i))
        key, tf = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
        term, doc = key >> np.uint64(12), (key & np.uint64(4095)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        del seen
        copies, lengths_of = np.bincount(self.entry, minlength=len(entry_length)), np.array(entry_length, dtype=float)
        posts = np.diff(np.r_[first, len(term)])
        df = np.add.reduceat(copies[doc], first) if len(first) else posts
        good = df > 1
        keep = np.repeat(good, posts)
        doc, tf, df, posts = doc[keep], tf[keep], df[good], posts[good]
        every, mean = n, max(1.0, lengths.mean()) if n else 1.0
        if self.corpus is not None:
            pairs = term[first][good]
            h = mix64(((pairs >> np.uint64(16)) << np.uint64(32)) | (pairs & np.uint64(0xFFFF)))
            every, mean = max(n, self.corpus.size), max(1.0, self.corpus.mean)
            df = np.minimum(np.maximum(df, self.corpus.sketch[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]), every)
        idf = np.log1p((every - df + 0.5) / (df + 0.5))
        weight = np.repeat(idf, posts) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths_of[doc] / mean))
        at = np.r_[0, np.cumsum(posts)]
        own = np.repeat(np.arange(len(posts)), posts)
        order = np.argsort(doc.astype(np.uint16), kind="stable")  # of 16 bits: a radix sort
        self.post_doc, self.post_weight, self.term_at = doc, weight, at
        self.doc_terms, self.doc_at = own[order], np.searchsorted(doc[order], np.arange(len(entry_length) + 1))

    def neighbours(self, i: int) -> np.ndarray:
        """BM25 scores of all documents for document i as the query."""
        e = self.entry[i]
        terms = self.doc_terms[self.doc_at[e] : self.doc_at[e + 1]]
        lo, count = self.term_at[terms], self.term_at[terms + 1] - self.term_at[terms]
        total = int(count.sum())
        if not total:
            return np.zeros(len(self.docs))
        at = np.arange(total) + np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count)
        return np.bincount(self.post_doc[at], self.post_weight[at], minlength=len(self.doc_at) - 1)[self.entry]

    def pack(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences, each a list of pieces (document, start, length)."""
        w, n = self.window, len(self.docs)
        size = np.array([len(ids) for _, ids in self.docs], dtype=np.int64)
        start = np.zeros(n, dtype=np.int64)
        for i in range(n):
            while size[i] - start[i] >= w:
                yield [(i, int(start[i]), w)]
                start[i] += w
        self.index(start.tolist())
        unused = start < size
        tail: list[tuple[int, int, int]] = []
        total = int((size - start).sum())
        for seed in np.argsort(start - size, kind="stable"):
            if total < w:
                break
            if not unused[seed]:
                continue
            unused[seed] = False
            pieces, room = [(int(seed), int(start[seed]), int(size[seed] - start[seed]))], w - int(size[seed] - start[seed])
            if room:
                scores = np.where(unused, self.neighbours(int(seed)), -1.0)
                want = min(n, 64)
                while room:
                    best = np.argpartition(-scores, want - 1)[:want] if want < n else np.arange(n)
                    best = best[np.lexsort((best, -scores[best]))]
                    for j in best.tolist():
                        if not room:
                            break
                        if not unused[j]:
                            continue
                        take = min(room, int(size[j] - start[j]))
                        pieces.append((j, int(start[j]), take))
                        start[j] += take
                        room -= take
                        if start[j] == size[j]:
                            unused[j] = False
                    if want >= n:
                        break
                    scores[best] = -1.0
                    want = min(n, want * 4)
            total -= w - room
            yield pieces
        tail = [(i, int(start[i]), int(size[i] - start[i])) for i in np.flatnonzero(unused).tolist()]
        left = sum(t[2] for t in tail)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                i, s, k = tail.pop()
                if k > room:
                    tail.append((i, s + room, k - room))
                    k = room
                pieces.append((i, s, k))
                room -= k
            yield pieces


def encoded(docs: DataFrame, tokenizer: str, end_id: int, lean: bool = False) -> DataFrame:
    """doc_id, n, ids (packed), terms: the SAMPLED smallest distinct hashes of pairs, ascending.

    Every task adds CHUNKS rows of its own, with ``chunk`` and, as ids, how many of its documents have a pair in each hash bucket.
    """
    size = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if lean:
            give_back()
        tok, end = tokens(tokenizer), np.array([end_id], dtype="<u4")
        total = np.zeros(size, dtype=np.int32)
        for batch in batches:
            every = batch.column(0)
            data, offsets = arrow_text(batch.column(1))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + TEXT_BYTES, side="right")) - 1)
                rows = [np.append(ids, end) for ids in tok.texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
                terms = []
                for ids in rows:
                    h = ids.astype(np.uint64)
                    if len(ids) > 1:
                        h = hashed_pairs(ids)
                        total[h >> np.uint64(64 - SKETCH_BITS)] += 1  # once per document, however often a pair stands in it
                    if len(h) > 4 * SAMPLED:
                        h = np.partition(h, 4 * SAMPLED)[: 4 * SAMPLED]  # enough for a few repeated pairs
                    terms.append(np.unique(h)[:SAMPLED].view(np.int64))
                at = np.r_[0, np.cumsum([len(t) for t in terms])]
                yield pa.RecordBatch.from_arrays(
                    [every.slice(lo, hi - lo), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() if end_id > 0xFFFF or r.max() > 0xFFFF else r.astype("<u2").tobytes() for r in rows], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(terms))), pa.nulls(hi - lo, pa.int32())],
                    names=["doc_id", "n", "ids", "terms", "chunk"],
                )
                lo = hi
        counts = [c.tobytes() for c in np.split(total, CHUNKS)]
        none = pa.nulls(CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(counts, pa.binary()), pa.nulls(CHUNKS, pa.list_(pa.int64())), pa.array(range(CHUNKS), pa.int32())], names=["doc_id", "n", "ids", "terms", "chunk"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, ids binary, terms array<bigint>, chunk int")


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def frequencies(counts: DataFrame) -> np.ndarray:
    """Document frequencies of pairs by hash bucket, over all documents, from the tasks' counts (chunk, ids): a fixed number of counters."""
    size = 1 << SKETCH_BITS
    step = size // CHUNKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = total.setdefault(chunk, np.zeros(step, dtype=np.int64))
                t += np.frombuffer(counts, dtype="<i4" if len(counts) == 4 * step else "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["chunk", "ids"])

    schema = "chunk int, ids binary"
    out = np.zeros(size, dtype=np.int64)
    for row in counts.mapInArrow(add, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema).collect():  # CHUNKS rows
        out[row.chunk * step : (row.chunk + 1) * step] += np.frombuffer(row.ids, dtype=np.int64)
    return np.minimum(out, (1 << 31) - 1).astype(np.uint32)


def placed(table: DataFrame, documents: int, parts: int) -> DataFrame:
    """doc_id, n, ids, key, part: documents by the first of their sampled terms that others sample too, split where very many do."""
    context = table.sparkSession.sparkContext
    split = max(TOGETHER, documents // 10_000)  # so that the terms to be split are at most 10,000 x SAMPLED, whatever the corpus
    shared = materialise(table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "pack-terms")
    bits = context.broadcast(bitmap(shared, "t"))
    hot = context.broadcast({r.t: -(-r.c // split) for r in shared.where(F.col("c") > split).collect()})
    release(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId()
        for batch in batches:
            terms = batch.column(3)
            flat, at = terms.flatten().to_numpy(), terms.offsets.to_numpy()
            at = at - at[0]
            known = in_bitmap(bits.value, flat.view(np.uint64))
            key, lane = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                hit = np.flatnonzero(known[x:y])
                key[i] = flat[x + (hit[0] if len(hit) else 0)]
                row += 1
                if (lanes := hot.value.get(int(key[i]))) is not None:
                    lane[i] = row % lanes + 1
            part = (mix64(key.view(np.uint64) + lane * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(key), pa.array(part)], names=["doc_id", "n", "ids", "key", "part"])

    return table.mapInArrow(run, "doc_id long, n long, ids binary, key long, part int")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, lean: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text; other columns are left out) into sequences of ``window`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` the piece's ids. Null or empty text is one end id. Very long texts are cut into windows, the rest
    is packed like any other. Rows with equal or null doc_id are packed as documents of their own; ties of scores
    go by the order in the shard. ``window`` must be a power of two. An empty table gives no rows. ``lean``: workers, which may
    hold memory of other stages, hand it back first, and the tokenizer's tables and words before packing.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    table = materialise(encoded(docs, tokenizer, end_id, lean), "pack-ids")
    counts, table = table.where("chunk is not null").select("chunk", "ids"), table.where("chunk is null").drop("chunk")
    documents, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    corpus = docs.sparkSession.sparkContext.broadcast(Corpus(documents, total / max(1, documents), frequencies(counts)))  # 4 MB, fixed
    tasks = max(1, -(-total // TASK_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if lean:
            tokens.cache_clear()  # this stage has ids
            give_back()
        base = TaskContext.get().partitionId() << 36
        count = 0

        def flush(shard: Shard) -> pa.RecordBatch:
            nonlocal count
            rows: list[list] = [[] for _ in range(8)]
            for pieces in shard.pack():
                offset = 0
                for i, s, k in pieces:
                    doc_id, ids = shard.docs[i]
                    part = ids[s : s + k]
                    for column, v in zip(rows, (doc_id, s, k, zlib.crc32(part), len(ids), base + count, offset, part if with_ids else None)):
                        column.append(v)
                    offset += k
                count += 1
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = [pa.array(c, pa.int64()) for c in rows[:7]]
            if with_ids:
                names, columns = [*names, "ids"], [*columns, pa.array(rows[7], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        shard = Shard(window, corpus.value)
        for batch in batches:
            for doc_id, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                shard.add(doc_id, unpacked(raw, n))
                if len(shard.docs) >= SHARD_DOCS or shard.size >= SHARD_TOKENS:
                    yield flush(shard)
                    shard = Shard(window, corpus.value)
        if shard.docs:
            yield flush(shard)

    dealt = placed(table, documents, 16 * tasks).repartition(tasks, "part").sortWithinPartitions("part", "key").select("doc_id", "n", "ids")
    return dealt.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
