"""URL filters over a sorted digest array.

The rules are stored as a sorted array of 64-bit xxhash keys with the full strings beside it. Executors get
the files by ``SparkContext.addFile`` and memory-map them, so that a task holds only the pages it touches.
A URL's candidate keys (each parent domain with each rule path length) are probed by one vectorised binary
search per batch, and every hit is confirmed on the stored full string, so that collisions decide nothing.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values of the contract: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The method's own list, asked where no rule fits: hosts that are blocked with their subdomains.
LISTED = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org", "adult-x.example.com", "adult-x.example.net", "adult-x.example.org")

RULE, LIST = 0, 1


def write_digests(rules: Iterable[tuple[str, str, str]], listed: Iterable[str], folder: str) -> str:
    """Write the digest array as one .npy structured file plus the strings; returns the path without suffix."""
    import xxhash

    keys: dict[str, int] = {}
    for verdict, host, path in rules:
        keys[host + path] = (RULE << 1) | (verdict == "block")
    lists = {"\n" + host: (LIST << 1) | 1 for host in listed}  # no host holds a line feed in front
    entries = sorted((xxhash.xxh64_intdigest(k), k, flag) for k, flag in [*keys.items(), *lists.items()])
    text = [k.encode() for _, k, _ in entries]
    ends = np.cumsum([0, *map(len, text)])
    rest = np.zeros(len(entries), dtype=[("start", "<u8"), ("end", "<u8"), ("flag", "<u1")])
    if entries:
        rest["start"], rest["end"], rest["flag"] = ends[:-1], ends[1:], [e[2] for e in entries]
    base = os.path.join(folder, f"digests-{uuid.uuid4().hex}")
    np.save(f"{base}.keys.npy", np.array([e[0] for e in entries], dtype="<u8"))
    np.save(f"{base}.rest.npy", rest)
    with open(f"{base}.text", "wb") as f:
        f.write(b"".join(text) or b"\0")
    return base


PARTS = (".keys.npy", ".rest.npy", ".text")


class Digests:
    """The memory-mapped files: sorted keys, places and flags, full strings."""

    def __init__(self, keys: str, rest: str, text: str):
        self.digest = np.load(keys, mmap_mode="r")
        self.rest = np.load(rest, mmap_mode="r")
        self.text = np.memmap(text, dtype=np.uint8, mode="r")

    def find(self, keys: list[str]) -> np.ndarray:
        """The entry of each key, or -1."""
        import xxhash

        out = np.full(len(keys), -1, dtype=np.int64)
        if not keys or not len(self.digest):
            return out
        h = np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64, count=len(keys))
        lo, hi = np.searchsorted(self.digest, h, "left"), np.searchsorted(self.digest, h, "right")
        for i in np.flatnonzero(lo < hi).tolist():
            want = keys[i].encode()
            for j in range(lo[i], hi[i]):
                if self.text[int(self.rest[j]["start"]) : int(self.rest[j]["end"])].tobytes() == want:
                    out[i] = j
                    break
        return out


@lru_cache(maxsize=4)
def mapped(name: str) -> Digests:
    return Digests(*(SparkFiles.get(name + part) for part in PARTS))


_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the contract has them; null or no ``://``: both empty."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = len(rest)
    for c in "?#":
        k = rest.find(c, 0, cut)
        cut = k if k >= 0 else cut
    slash = rest.find("/", 0, cut)
    slash = slash if slash >= 0 else cut
    return rest[:slash].translate(_UPPER), rest[slash:cut]


def parents(host: str) -> list[str]:
    """The host and the domains above it, longest first."""
    out = [host] if host else []
    at = host.find(".")
    while at >= 0:
        if at + 1 < len(host):
            out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, listed: Iterable[str] = LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url); other columns are left out.

    The longest rule that fits decides. Without one, the rule is null and the verdict is block for a listed
    host or no host at all, else allow. Null, empty and very long URLs are ordinary cases; an empty table
    gives no rows. Rules with an empty path fit every path.
    """
    rules = list(rules)
    spark: SparkSession = pages.sparkSession
    base = write_digests(rules, listed, os.path.realpath(tempfile.mkdtemp(prefix="spark-digests-")))
    for part in PARTS:
        spark.sparkContext.addFile(base + part)
    name, lengths = os.path.basename(base), sorted({len(p) for _, _, p in rules}, reverse=True)
    deepest = max([h.count(".") for _, h, _ in rules] + [h.count(".") for h in listed] + [0]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = mapped(name)
        for batch in batches:
            hosts, paths, keys, owner = [], [], [], []
            for i, url in enumerate(batch.column(1).to_pylist()):
                host, path = split_url(url)
                hosts.append(host)
                paths.append(path)
                for parent in parents(host)[-deepest:]:
                    for n in lengths:
                        if n <= len(path):
                            keys.append(parent + path[:n])
                            owner.append(i)
                    keys.append("\n" + parent)
                    owner.append(i)
            found = digests.find(keys)
            best = [-1] * len(hosts)
            rule: list[str | None] = [None] * len(hosts)
            verdict = ["allow" if h else "block" for h in hosts]
            for k in np.flatnonzero(found >= 0).tolist():
                i, flag = owner[k], int(digests.rest[found[k]]["flag"])
                if flag >> 1 == LIST:
                    if best[i] < 0:
                        verdict[i] = "block"
                elif len(keys[k]) > best[i]:
                    best[i], rule[i], verdict[i] = len(keys[k]), keys[k], "block" if flag & 1 else "allow"
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.string()) for c in (hosts, paths, rule, verdict))], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^?#]*') AS upto FROM r),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(upto, length(raw) + 1) AS path FROM p),
m AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN host = '' OR regexp_matches(host, '^(.*\.)?(spam-farm|adult-x)\.example\.(com|net|org)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM m
"""
