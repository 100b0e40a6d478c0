"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap; boosted trees judge each by its format and its
context; thresholds, calibrated per kind on examples the trees have not seen, select what is added to the
base spans. Base spans follow fixed patterns and always stay. The trees are trained here, on examples drawn
from the formats themselves (a fixed number, the parameter EXAMPLES), so that no text is gathered.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import BoostedTrees

# Fixed values of the contract: kinds in their order and patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Kinds that only the method has come after the base kinds.
KINDS = (*BASE_KINDS, "secret", "ssn", "iban")
EXAMPLES, PRECISION = 6000, 0.97

#: Generators: wide patterns, no two of which exclude each other. The first two of a secret need no digit.
_PROPOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63} ?(?:\.|[\[(]dot[\])]| dot )| at [A-Za-z0-9-]{1,63} dot ) ?[A-Za-z]{2,12}\b")),
    ("secret", re.compile(r"\b(?:AKIA|ASIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{12,}+")),
    ("secret", re.compile(r"(?<=[=:\"' ])[A-Za-z0-9+/_-]{14,}+(?=[\"'\s]|$)")),
    ("ip", re.compile(r"\b(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}\b")),
    ("card", re.compile(r"\b[0-9]{4}(?:[ ./-]?[0-9]{2,7}){2,4}\b")),
    ("phone", re.compile(r"(?<![0-9+.])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}\b")),
    ("ssn", re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
)
_CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach|e-mail|@", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|from|ping", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|pay", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|dial|sms", re.I),
    "secret": re.compile(r"password|passwd|token|secret|api.?key|key|auth", re.I),
    "ssn": re.compile(r"ssn|social|security|tax", re.I),
    "iban": re.compile(r"iban|account|bank|transfer", re.I),
}
_AGAINST = re.compile(r"version|isbn|issn|page|date|order|invoice|commit|sha|hash|build|figure|table|serial|\$|€|#|no\.", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind. Linear in the text's length."""
    out: list[tuple[int, int, str, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, "email", m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m[0].split(".")):
                out.append((m.start(), 1, "ip", m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, "card", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                    out.append((m.start(), 3, "phone", m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Candidate spans of all generators; they may overlap. A generator is left out only where it cannot match."""
    able = {"email": " dot " in text or "at]" in text or "at)" in text, "secret": True, "ip": ":" in text}
    digit = _DIGIT.search(text) is not None
    return [(kind, m.start(), m.end()) for kind, pattern in _PROPOSE if able.get(kind, digit) for m in pattern.finditer(text)]


class Taken:
    """Disjoint intervals by start; says whether a span is free of them."""

    def __init__(self, spans: list[tuple[str, int, int]] = ()):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for _, start, stop in sorted(spans, key=lambda s: s[1]):
            if self.stops and start < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], stop)
            else:
                self.starts.append(start)
                self.stops.append(stop)

    def free(self, start: int, stop: int) -> bool:
        i = bisect_left(self.starts, stop)
        return not (i and self.stops[i - 1] > start)

    def add(self, start: int, stop: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.stops.insert(i, stop)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its context of 24 characters before and 8 behind."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    digits = re.sub("[^0-9]", "", s)
    n = max(1, len(s))
    upper, lower = sum(map(str.isupper, s)), sum(map(str.islower, s))
    hexa = sum(c in string.hexdigits for c in s)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    groups = re.findall("[0-9]+", s)
    return [
        *(float(kind == k) for k in KINDS), len(s), len(digits), upper / n, lower / n, hexa / n, changes, len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0), float(len(digits) > 11 and luhn(digits)), float(bool(re.search(r"[\[(](?:at|dot)[\])]", s))),
        float(" dot " in s), float(bool(_CONTEXT[kind].search(before))), float(bool(_AGAINST.search(before))), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(before[-1:] in "=:\"'"), len(set(digits)), float(s[:4] in ("AKIA", "ASIA", "ghp_")), sum(c in " .-/():" for c in s), float(s[:1] == "4" or s[:1] == "5" or s[:1] == "3"),
        float(bool(re.match(r"(?:19|20)[0-9]{2}\b", s))), s.count(":"),
    ]


def _examples(rng: random.Random) -> Iterator[tuple[str, str, str, str, int]]:
    """(before, span, after, kind, label): drawn from the formats, with look-alikes that are no personal data."""
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    plain = lambda: f"{word()} {word()} "
    cue = lambda *w: f"{word()} {rng.choice(w)}{rng.choice([' ', ': ', '='])}"

    def card() -> str:
        d = rng.choice("345") + digits(14)
        return next(d + c for c in string.digits if luhn(d + c))

    while True:
        after = rng.choice(["", " ", ". ", ", "]) + word()
        yield rng.choice([plain(), cue("mail", "contact")]), rng.choice([f"{word()}.{word()} [at] {word()}.com", f"{word()} (at) {word()} (dot) org", f"{word()}{digits(2)} at {word()} dot net"]), after, "email", 1
        yield plain(), f"{word()} at {word()} dot {word()}", after, "email", 0
        yield cue("password", "token", "secret", "api_key") + rng.choice(["", '"']), rng.choice([hexa(18), hexa(40), "".join(rng.choices(string.ascii_letters + string.digits, k=24))]), '" ', "secret", 1
        yield plain(), "AKIA" + "".join(rng.choices(string.ascii_uppercase + rng.choice([string.digits, ""]), k=16)), " " + after, "secret", 1
        yield cue("password", "token", "secret", "api_key"), word() + word() + word() + word(), " ", "secret", 1
        yield rng.choice([plain(), cue("commit", "sha", "build")]), rng.choice([hexa(40), digits(16), digits(20), word() + "-" + word() + digits(4) + word()]), " " + after, "secret", 0
        yield plain(), word() + word() + word() + word(), " ", "secret", 0
        yield cue("ip", "host"), ":".join(hexa(4) for _ in range(8)), " ", "ip", 1
        yield plain(), ":".join(digits(2) for _ in range(4)), " ", "ip", 0
        c = card()
        yield rng.choice([plain(), cue("card", "visa")]), rng.choice(["/", "."]).join(c[i : i + 4] for i in range(0, 16, 4)), " ", "card", 1
        yield cue("card", "visa", "credit"), card(), " ", "card", 1
        yield rng.choice([plain(), cue("order", "invoice", "isbn")]), rng.choice([digits(16), f"{digits(4)} {digits(4)} {digits(4)}", f"2{digits(3)}-{digits(2)}-{digits(2)}", digits(13)]), " ", "card", 0
        yield rng.choice([plain(), cue("call", "tel", "phone")]), rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}"]), after, "phone", 1
        yield rng.choice([plain(), cue("isbn", "page", "version")]), rng.choice([f"{digits(4)}-{digits(3)}-{digits(3)}", f"{digits(2)}.{digits(3)}.{digits(3)}", f"{digits(2)} {digits(3)} {digits(3)}"]), after, "phone", 0
        yield rng.choice([plain(), cue("ssn", "social")]), f"{digits(3)}-{digits(2)}-{digits(4)}", after, "ssn", 1
        yield cue("order", "invoice", "serial"), f"{digits(3)}-{digits(2)}-{digits(4)}", after, "ssn", 0
        yield rng.choice([plain(), cue("iban", "account")]), f"{rng.choice(['DE', 'FR', 'ES', 'GB', 'NL'])}{digits(2)} " + " ".join(digits(4) for _ in range(4)), " ", "iban", 1
        yield plain(), "".join(rng.choices(string.ascii_uppercase, k=2)) + digits(2) + "".join(rng.choices(string.ascii_uppercase, k=12)), " ", "iban", 0


@lru_cache(maxsize=1)
def model(examples: int = EXAMPLES, precision: float = PRECISION, seed: int = 5) -> tuple[BoostedTrees, dict[str, float]]:
    """(trees, threshold per kind). Half of the examples train the trees, the others set the thresholds."""
    draw = _examples(random.Random(seed))
    rows = []
    for _ in range(examples):
        before, span, after, kind, label = next(draw)
        text = before + span + after
        rows.append((features(text, kind, len(before), len(before) + len(span)), kind, label))
    x, y, kinds = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], dtype=float), np.array([r[1] for r in rows])
    fit = (np.arange(len(y)) // 18) % 2 == 0  # a round of the generator has 18 examples
    trees = BoostedTrees().fit(x[fit], y[fit])
    score, thresholds = trees.score(x), {}
    for kind in KINDS:
        rows_of = np.flatnonzero(~fit & (kinds == kind))
        s, t = score[rows_of], y[rows_of]
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        thresholds[kind] = max(0.5, float(s[order][good[-1]])) if len(good) else 1.1
    return trees, thresholds


def all_spans(texts: list[str], trees: BoostedTrees, thresholds: dict[str, float]) -> list[tuple[list, list]]:
    """For each text (base spans, all spans). Base spans stay; of overlapping additions the best one does."""
    base, rows, at = [], [], []
    for i, text in enumerate(texts):
        own = base_spans(text)
        base.append(own)
        taken = Taken(own)
        for kind, start, end in proposals(text):
            if taken.free(start, end):
                rows.append(features(text, kind, start, end))
                at.append((i, kind, start, end))
    added: list[list] = [[] for _ in texts]
    chosen = [Taken() for _ in texts]
    if rows:
        score = trees.score(np.array(rows))
        for j in sorted(range(len(at)), key=lambda j: (-score[j], at[j])):
            i, kind, start, end = at[j]
            if score[j] >= thresholds[kind] and chosen[i].free(start, end):
                chosen[i].add(start, end)
                added[i].append((kind, start, end))
    order = lambda s: (s[1], KINDS.index(s[0]))
    return [(b, sorted(b + a, key=order)) for b, a in zip(base, added)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, base_sha256, spans for every row of ``docs`` (doc_id, text).

    Null text counts as empty; very long texts are read whole, in time linear but for sorting; of overlapping
    additions the better score stays, of equal ones the earlier kind and place; repeated rows are judged each;
    other columns are left out, whatever their names; an empty table gives no rows.
    """
    trees, thresholds = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                found = all_spans([t or "" for t in batch.column(1).to_pylist()], trees, thresholds)
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in BASE_KINDS]
                digest = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *counts, digest, pa.array([listed(a) for _, a in found], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
                )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; n_chars, where there is one, follows.

    All rows and columns stay. Null stays null, empty texts stay empty; an empty table gives no rows.
    """
    trees, thresholds = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, max(1, whole.num_rows), 512):
                batch = whole.slice(lo, 512)
                k = batch.schema.get_field_index("text")
                texts = batch.column(k).to_pylist()
                clean = [None if t is None else redact(t, s[1]) for t, s in zip(texts, all_spans([t or "" for t in texts], trees, thresholds))]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(clean, batch.schema.field(k).type))
                if (n := batch.schema.get_field_index("n_chars")) >= 0:
                    field, old = batch.schema.field(n), batch.column(n)
                    new = pa.array([o if t == c else len(c) for o, t, c in zip(old.to_pylist(), texts, clean)], field.type)
                    batch = batch.set_column(n, field, new)
                yield batch

    return docs.mapInArrow(run, docs.schema)
