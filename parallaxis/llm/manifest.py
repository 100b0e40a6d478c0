"""Merkle manifest of a dataset: a tree of digests per group, a tree over the groups, and proofs of single rows.

Every node is labelled by the interval of leaf ranks that it covers. A level's nodes are bucketed by their
parent's width, so that a node meets the one node above whose interval contains its own by an equal key; the parts of
the parent's interval beside it are its siblings. Proofs are attached from the root downwards: a node has its siblings
and the path of its parent, so each level is one join of as many rows as it has nodes. Ranks come from a sorted table
and counts of its partitions: no task holds a whole group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, release

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """``leaves``: a row per document with its label, proof and roots; ``nodes``: (tree, level, lo, hi, digest) of all inner nodes; the root."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def digest_of(*fields: Column) -> Column:
    """SHA-256 of the fields one after the other, each with its length in bytes before it; ``-`` for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def ranked(leaves: DataFrame, *order: str) -> DataFrame:
    """Adds lo, a row's place in its tree, and size, the tree's number of rows."""
    at = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    at = materialise(at.withColumn("part", F.shiftright("at", 33)), "manifest-order")
    runs = at.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")  # as many rows as the tree has partitions
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.select("tree", "part", (F.col("before") - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    out = at.join(runs, ["tree", "part"]).withColumn("lo", F.col("at") + F.col("shift")).drop("at", "part", "shift")
    out = materialise(out, "manifest-leaves")
    release(at)
    return out


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Levels above the leaves (tree, size, lo, hi, digest, kids): runs of ARITY nodes until every tree has one node.

    A tree that has one node already keeps it as it is on the levels that taller trees need.
    """
    level = leaves.select("tree", "size", "lo", (F.col("lo") + 1).alias("hi"), "digest")
    tallest, width, levels = level.agg(F.max("size")).first()[0] or 0, 1, []
    while width < tallest or not levels:
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        up = level.groupBy("tree", "size", F.expr(f"lo div {width * ARITY}").alias("bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), kids.alias("kids"))
        digest = F.when(F.col("size") > width, F.sha2(F.concat_ws("", "kids.digest"), 256)).otherwise(F.col("kids")[0]["digest"])
        level = materialise(up.withColumn("digest", digest).drop("bucket"), "manifest-level")
        levels.append(level)
        width *= ARITY
    return levels


def attached(leaves: DataFrame, levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """``leaves`` with the path of their proofs, and what ``top`` (tree, path, ...) says of their tree.

    A path is an array of (left, right), the digests beside a node, from the leaf's level to the root's.
    """
    told = [c for c in top.columns if c not in ("tree", "path")]
    above = levels[-1].join(top, "tree").select("tree", "lo", "hi", "kids", "path", *told)
    for k in range(len(levels) - 1, -1, -1):
        width = ARITY**k
        own = leaves if k == 0 else levels[k - 1]
        own = own.withColumn("hi", F.col("lo") + 1) if k == 0 else own
        child = own.withColumn("bucket", F.expr(f"lo div {width * ARITY}")).alias("c")
        parent = above.withColumn("bucket", F.expr(f"lo div {width * ARITY}")).alias("p")
        inside = (F.col("c.lo") >= F.col("p.lo")) & (F.col("c.hi") <= F.col("p.hi"))
        met = child.join(parent, (F.col("c.tree") == F.col("p.tree")) & (F.col("c.bucket") == F.col("p.bucket")) & inside)
        left = F.filter("p.kids", lambda s: s["hi"] <= F.col("c.lo"))["digest"]
        right = F.filter("p.kids", lambda s: s["lo"] >= F.col("c.hi"))["digest"]
        step = F.array(F.struct(F.concat_ws("", left).alias("left"), F.concat_ws("", right).alias("right")))
        path = F.when(F.col("c.size") > width, F.concat(step, F.col("p.path"))).otherwise(F.col("p.path"))
        above = met.select(*[F.col(f"c.{c}") for c in own.columns], path.alias("path"), *[F.col(f"p.{c}") for c in told])
    return above.drop("hi")


def build(docs: DataFrame, check: Column | None = None, group: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text") -> Manifest:
    """The manifest of all rows of ``docs``, whose first field is their id.

    Leaves are digests of ``fields``; per ``group`` they ascend by id (null first, equal ids by digest), groups by their bytes
    (null first). Leaves have doc_id, tree, lo, size, leaf, subroot, root, path, and ``checked``, the digest with ``check`` in the
    place of the text (the leaf itself without it). Rows that are repeated are leaves of their own; other columns are left out. An
    empty table has no leaves, no nodes and no root.
    """
    column = lambda c: F.col(f"`{c}`")
    leaf = digest_of(*map(column, fields))
    other = leaf if check is None else digest_of(*[check if f == text else column(f) for f in fields])
    tree = F.coalesce(F.concat(F.lit(":"), column(group).cast("string")), F.lit(""))
    rows = materialise(docs.select(column(fields[0]).alias("doc_id"), tree.alias("tree"), leaf.alias("digest"), other.alias("checked")), "manifest-digests")
    leaves = ranked(rows, "doc_id", "digest")
    release(rows)
    levels = grown(leaves)
    groups = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest")
    crowns = ranked(groups, "own")
    upper = grown(crowns)
    first = upper[-1].select("digest").first()
    root = first.digest if first else None
    none = upper[-1].select("tree", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"))
    top = materialise(attached(crowns, upper, none).select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "path"), "manifest-crowns")
    out = attached(leaves, levels, top).select("doc_id", "tree", "lo", "size", F.col("digest").alias("leaf"), "checked", "subroot", F.lit(root).alias("root"), "path")
    inner = [x.select("tree", F.lit(k + 1).alias("level"), "lo", "hi", "digest").where(F.col("size") > ARITY**k) for k, x in enumerate(levels)]
    inner += [x.select(F.lit(None).cast("string").alias("tree"), F.lit(k + 1).alias("level"), "lo", "hi", "digest").where(F.col("size") > ARITY**k) for k, x in enumerate(upper)]
    nodes = inner[0]
    for x in inner[1:]:
        nodes = nodes.unionByName(x)
    return Manifest(out, nodes, root)


def verify(made: Manifest) -> DataFrame:
    """Leaves with proof_sha256 (of the siblings along the path), folded_root (the root that ``checked`` gives with them) and verified."""
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    folded = F.aggregate("path", F.col("checked"), lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))
    out = made.leaves.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(lower: int = 14, upper: int = 8) -> str:
    """The same in SQL, for groups of at most 3^lower rows and at most 3^upper groups."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR) END"
    leaf = lambda text: f"sha256(concat({', '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k::INT) & 1)))"
    step = "xor(xor(a, b) >> 1, 3988292384*(xor(a, b) & 1))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, b: {step}), 4294967295)"
    out = [
        f"t AS MATERIALIZED (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents)",
        f"e AS MATERIALIZED (SELECT doc_id, coalesce(':' || source, '') AS tree, {leaf('text')} AS leaf, {leaf('other')} AS checked FROM t)",
        "r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM e)",
        "n0 AS MATERIALIZED (SELECT tree, size, pos, leaf AS d FROM r)",
    ]

    def levels(name: str, count: int) -> None:
        for k in range(count):
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, size, pos//3 AS pos, list(d ORDER BY pos) AS kids, CASE WHEN size > {3**k} THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE min(d) END AS d FROM {name}{k} GROUP BY tree, size, pos//3)")

    def folded(start: str, name: str, count: int, nodes: str, keep: str) -> None:
        out.append(f"{name}0 AS MATERIALIZED ({start})")
        for k in range(count):
            left, right = "array_to_string(n.kids[1:x.pos % 3], '')", "array_to_string(n.kids[x.pos % 3 + 2:], '')"
            out.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT {keep}, x.tree, x.pos//3 AS pos, CASE WHEN n.size > {3**k} THEN sha256(concat({left}, x.f, {right})) ELSE x.f END AS f, "
                f"CASE WHEN n.size > {3**k} THEN concat(x.p, {left}, {right}) ELSE x.p END AS p, n.d AS top FROM {name}{k} x JOIN {nodes}{k + 1} n ON n.tree = x.tree AND n.pos = x.pos//3)"
            )

    levels("n", lower)
    out.append(f"m0 AS MATERIALIZED (SELECT '' AS tree, tree AS own, count(*) OVER () AS size, row_number() OVER (ORDER BY tree) - 1 AS pos, d FROM n{lower})")
    levels("m", upper)
    folded("SELECT doc_id, leaf, tree, pos, checked AS f, '' AS p FROM r", "x", lower, "n", "x.doc_id, x.leaf")
    folded(f"SELECT x.doc_id, x.leaf, x.top AS subroot, '' AS tree, m.pos, x.f, x.p FROM x{lower} x JOIN m0 m ON m.own = x.tree", "y", upper, "m", "x.doc_id, x.leaf, x.subroot")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, top AS root, sha256(p) AS proof_sha256, f AS folded_root, f = top AS verified FROM y{upper}"


ORACLE = oracle()
