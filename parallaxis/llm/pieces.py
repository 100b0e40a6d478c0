"""SentencePiece BPE ids of whole texts by a table of last pieces, and texts from ids.

Of every prefix of a text the merges make one sequence of pieces, and that sequence without its last piece belongs
to a shorter prefix. So a table with each prefix's last piece holds all encodings at once: an automaton over the
vocabulary names the pieces that end at a place, and the one that stands beside the shorter prefix's last piece
without ever merging into it is the place's entry. The ids are read from the table backwards. Work is linear in the
text, whatever its words are.

Two neighbours stay apart if no piece is ever made across their border. Each side grows there by its own merges, in
the order of scores, so the test walks both sides' merges together and looks for a pair that would come first.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ARROW_ROWS

SPACE = "▁"
#: Segments kept with their ids in a worker (twice as many at most), and the longest one that is kept.
SEEN, LONGEST = 250_000, 64
#: Pairs of neighbours kept with the test's answer.
NEAR = 1_000_000
NEVER = float("inf")


class Pieces:
    """Tables made from one model file: BPE with byte fallback, a leading space, and no other change of the text.

    Other models (unigram, other normalisers, unused or user-defined pieces) are refused.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        probe = "  ﬁx Å　"
        size = model.get_piece_size()
        odd = [i for i in range(size) if model.is_unused(i)]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if odd or not all(map(model.is_byte, self.bytes)) or "".join(model.encode(probe, out_type=str)) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        own = [i for i in range(size) if i not in special and not model.is_byte(i)]
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.sizes = list(map(len, self.text))
        self.rank = [-model.get_score(i) for i in range(size)]
        self.raw = [b"" if i in special else self.text[i].replace(SPACE, " ").encode() for i in range(size)]
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        self.known = {self.text[i]: i for i in own}
        #: By piece: those that stand at its right (left) border while it is made, from the single character to itself.
        self.tails: dict[int, tuple[int, ...]] = {}
        self.heads: dict[int, tuple[int, ...]] = {}
        self.near: dict[int, bool] = {}
        automaton = ahocorasick.Automaton()
        for i in sorted(own, key=lambda i: (len(self.text[i]) > 1, self.rank[i], len(self.text[i]))):
            if self._split(i):
                automaton.add_word(self.text[i], i)
        automaton.make_automaton()
        self.matches = automaton.iter
        # no piece goes beyond a segment, if spaces only begin pieces
        multi = [self.text[i] for i in self.tails if len(self.text[i]) > 1]
        joined = "".join(sorted(set("".join(multi)) - {SPACE}))
        inner = any(SPACE in p.lstrip(SPACE) for p in multi)
        self.segments = re.compile(r".+" if inner else f"{SPACE}*[{re.escape(joined)}]+|{SPACE}+|.", re.S).findall
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _split(self, i: int) -> bool:
        """Enter a piece by the last merge that makes it of its own characters; False if the merges make something else of them."""
        t = self.text[i]
        if len(t) == 1:
            self.tails[i] = self.heads[i] = (i,)
            return True
        for k in range(1, len(t)):
            a, b = self.known.get(t[:k]), self.known.get(t[k:])
            if a in self.tails and b in self.tails and self._apart(a, b, i):
                if max(self.rank[a] if k > 1 else -NEVER, self.rank[b] if k < len(t) - 1 else -NEVER) > self.rank[i]:
                    raise ValueError(f"piece {t!r} comes before its parts")
                self.tails[i], self.heads[i] = (*self.tails[b], i), (*self.heads[a], i)
                return True
        return False

    def _apart(self, a: int, b: int, made: int | None = None) -> bool:
        """Do pieces a and b, side by side, stay as they are (but for becoming ``made`` in the end)?

        Of equal scores the leftmost pair merges first: one within a, then one across the border, then one within b.
        """
        tails, heads, rank, i, j = self.tails[a], self.heads[b], self.rank, 1, 1
        while True:
            x, y = tails[i - 1], heads[j - 1]
            left = rank[tails[i]] if i < len(tails) else NEVER
            right = rank[heads[j]] if j < len(heads) else NEVER
            across = self.known.get(self.text[x] + self.text[y])
            if across is not None and rank[across] < left and rank[across] <= right:
                return x == a and y == b and across == made
            if left == right == NEVER:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def segment(self, s: str) -> list[int]:
        """Ids of a text without its neighbours: the table of last pieces, read backwards. A character without a piece is its bytes."""
        last: list[int | None] = [None] * (len(s) + 1)
        near, sizes, done = self.near, self.sizes, -1
        for at, piece in self.matches(s):
            if at == done:
                continue
            before = last[at + 1 - sizes[piece]]
            if before is not None:  # else the start, or a character without a piece
                apart = near.get(before << 32 | piece)
                if apart is None:
                    if len(near) > NEAR:
                        near.clear()
                    apart = near[before << 32 | piece] = self._apart(before, piece)
                if not apart:
                    continue
            last[at + 1] = piece
            done = at
        ids, at = [], len(s)
        while at:
            piece = last[at]
            if piece is None:
                ids += [self.bytes[b] for b in reversed(s[at - 1].encode())]
                at -= 1
            else:
                ids.append(piece)
                at -= sizes[piece]
        return ids[::-1]

    def learn(self, s: str) -> bytes:
        raw = self.old.get(s)
        if raw is None:
            raw = array("I", self.segment(s)).tobytes()
        if len(s) <= LONGEST:
            if len(self.seen) >= SEEN:
                self.old, self.seen = self.seen, {}
            self.seen[s] = raw
        return raw

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as unsigned 32-bit numbers, without begin and end; none of a null or empty text."""
        if not text:
            return b""
        seen = self.seen.get
        return b"".join([seen(s) or self.learn(s) for s in self.segments(SPACE + text.replace(" ", SPACE))])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; begin, end and unknown give nothing, one leading space goes, bytes that are no text become the replacement character."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _small(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of few bytes each, so that what is made of long texts doesn't add up."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if held and held + n > 1 << 23:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def encode_texts(docs: DataFrame, model: str, begin: bool = True, end: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids binary) of every row; other columns are left out.

    ``model`` is the path of a SentencePiece BPE file on every machine. ids are little-endian unsigned 32-bit numbers, with the begin
    and end ids if asked for. A null or empty text has no other ids. Rows that repeat an id, or have none, are rows of their own. Texts are
    encoded whole, in time linear in their length. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces(model)
        first = np.array([tables.begin] if begin else [], "<u4").tobytes()
        final = np.array([tables.end] if end else [], "<u4").tobytes()
        for whole in batches:
            for batch in _small(whole, 1):
                ids = [first + tables.encode(t) + final for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    rows = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"cast(`{text_column}` as string) as text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the text that its ids stand for in ``decoded``; null ids give an empty text.

    That is the encoded text, but for the character that marks spaces in pieces: it comes back as a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces(model)
        for whole in batches:
            for batch in _small(whole, 2):
                text = [tables.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
