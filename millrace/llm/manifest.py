"""Merkle manifest of a table: a digest for every row, a tree for every group, one root.

Leaves of a group ascend by id; every ``FAN`` consecutive nodes become the digest of their
digests until one is left, and the groups' roots, ordered by group, are treated likewise.

A tree is stored in blocks: aligned subtrees of up to ``HEIGHT`` levels over ``FAN ** HEIGHT``
nodes. The roots of a layer of blocks are the lowest nodes of the next layer of blocks, so
a tree of any size takes a few layers, and a group holding a third of all rows is spread
over as many tasks as it has blocks. The nodes of a block lie in a van Emde Boas layout:
the tree is cut at half its height, the upper half comes first and the lower subtrees
follow one after another, each laid out the same way. ``addresses`` computes the place of a
node from its depth and position alone; building a block and reading the siblings on a path
both go through it.

Proofs run from the top down: a block hands each of its lowest nodes the siblings on the
path to its own root and those above, once for every block below it; the leaves of a block
then fold against one shared path.

Defined cases. A null is written ``-``. Rows with the same id in a group follow each other by
digest; equal rows have equal leaves and differ only in their siblings. Null ids come
first, a null group is a group of its own before all others. Empty texts are values of
length 0. A group of one row has its leaf as root. No rows: no result rows, no root. Extra
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, stored

#: Nodes in a run.
FAN = 8
#: Levels above the lowest in a block: 4,096 lowest nodes, 4,681 digests of 32 bytes.
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---- layout of a block


@functools.lru_cache(maxsize=64)
def size(levels: int) -> int:
    """Nodes of a full tree with so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def addresses(levels: int, depth: int, at: np.ndarray) -> np.ndarray:
    """Places of the nodes ``at`` of a depth (0 is the root) in the van Emde Boas layout of
    a full tree of ``levels`` levels."""
    base = np.zeros(len(at), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth, levels = depth - upper, levels - upper
        below = FAN**depth
        base += size(upper) + at // below * size(levels)
        at = at % below
    return base


def build(digests: np.ndarray, height: int) -> np.ndarray:
    """The block over ``digests`` (rows of 32 bytes): rows by address, absent ones zero."""
    levels = height + 1
    nodes = np.zeros((size(levels), 32), np.uint8)
    nodes[addresses(levels, height, np.arange(len(digests)))] = digests
    n = len(digests)
    for depth in range(height - 1, -1, -1):
        children = nodes[addresses(levels, depth + 1, np.arange(n))]
        n = -(-n // FAN)
        made = [hashlib.sha256(children[FAN * k : FAN * (k + 1)].tobytes().hex().encode()).digest() for k in range(n)]
        nodes[addresses(levels, depth, np.arange(n))] = np.frombuffer(b"".join(made), np.uint8).reshape(-1, 32)
    return nodes


def siblings(nodes: np.ndarray, height: int, n: int) -> list[list[tuple[str, str]]]:
    """For each of the ``n`` lowest nodes of a block, level by level upwards, the digests
    before and after it in its run, as hex text. Shared by the nodes below a run's member."""
    levels, steps = height + 1, []
    for depth in range(height, 0, -1):
        here = [x.tobytes().hex() for x in nodes[addresses(levels, depth, np.arange(n))]]
        runs = ["".join(here[k : k + FAN]) for k in range(0, n, FAN)]
        step = []
        for k in range(n):
            run, cut = runs[k // FAN], 64 * (k % FAN)
            step.append((run[:cut], run[cut + 64 :]))
        steps.append(step)
        n = -(-n // FAN)
    lowest = len(steps[0]) if steps else 1
    return [[step[k // FAN**d] for d, step in enumerate(steps)] for k in range(lowest)]


def climb(leaf: str, path: list[tuple[str, str]]) -> str:
    """The digest at the end of a path of siblings, from the digest at its start."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


# ---- leaves


def field(c: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; ``-`` if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns.values()]), 256)


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``rank``: the place of each row from 0 on in the order of ``keys``.

    Rows are dealt out by ranges of the keys and sorted in each; what is counted in one
    place is one row for each partition."""
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    held = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    starts, total = [], 0
    for r in held:
        starts.append((r["part"], total))
        total += r["n"]
    first = df.sparkSession.createDataFrame(starts, "part long, start long")
    rows = rows.withColumn("part", part).join(F.broadcast(first), "part")
    return rows.withColumn("rank", F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("place", "part", "start")


# ---- trees


@dataclass
class Tree:
    """Layers of blocks from the lowest up; ``tree`` and ``block`` name a block."""

    layers: list[DataFrame]
    roots: DataFrame


def _height(n: int) -> int:
    """Levels above the lowest in the block of a layer with ``n`` nodes in its tree."""
    h = 0
    while h < HEIGHT and FAN**h < n:
        h += 1
    return h


def plant(nodes: DataFrame, most: int, name: str) -> Tree:
    """Trees over ``tree, rank, n, digest``: rank counts from 0 in the ``n`` nodes of a
    tree, the largest of which has ``most``. ``roots``: ``tree, digest``."""
    per_block = FAN**HEIGHT

    def block(key, rows):
        rows = rows.sort_values("rank")
        digests = np.frombuffer(b"".join(rows["digest"]), np.uint8).reshape(-1, 32)
        height = _height(int(rows["n"].iloc[0]))
        made = build(digests, height)
        return pd.DataFrame(
            {
                "tree": [key[0]], "block": [key[1]], "total": [rows["n"].iloc[0]], "held": [len(rows)],
                "height": [height], "digest": [made[0].tobytes()], "nodes": [made.tobytes()],
            }
        )

    schema = "tree long, block long, total long, held int, height int, digest binary, nodes binary"
    layers: list[DataFrame] = []
    while True:
        dealt = nodes.select("tree", (F.col("rank") / per_block).cast("long").alias("block"), "rank", "n", "digest")
        layers.append(stored(dealt.groupBy("tree", "block").applyInPandas(block, schema), f"{name}-{len(layers)}"))
        if most <= per_block:
            break
        most = -(-most // per_block)
        up = F.ceil(F.col("total") / per_block).cast("long")
        nodes = layers[-1].select("tree", F.col("block").alias("rank"), up.alias("n"), "digest")
    # A tree that ends in a lower layer is one node in each layer above it, so its last block holds its root.
    return Tree(layers, layers[-1].select("tree", "digest"))


def _descend(layers: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree, block, l, r``: the siblings over each block below the lowest of ``layers``, or
    over each node where it is the lowest of its tree. ``above`` has those over the roots."""
    paths = above.select("tree", F.lit(0).cast("long").alias("block"), "l", "r")
    for layer in reversed(layers):
        met = layer.select("tree", "block", "held", "height", "nodes").join(paths, ["tree", "block"])

        def below(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for x in part.itertuples():
                    own = siblings(np.frombuffer(x.nodes, np.uint8).reshape(-1, 32), x.height, x.held)
                    yield pd.DataFrame(
                        {
                            "tree": x.tree,
                            "block": x.block * FAN**HEIGHT + np.arange(x.held),
                            "l": [[a for a, _ in p] + list(x.l) for p in own],
                            "r": [[b for _, b in p] + list(x.r) for p in own],
                        }
                    )

        paths = met.mapInPandas(below, "tree long, block long, l array<string>, r array<string>")
    return paths


@dataclass
class Manifest:
    """``leaves``: ``doc_id, tree, rank, n, digest`` and ``other``, a second digest to be
    tried against the row's proof; ``groups``: a tree for each group, named by ``tree``;
    ``names``: ``tree, name, rank, digest`` of the groups in order; ``top``: the tree over
    them; ``root``: its digest, None without rows."""

    leaves: DataFrame
    groups: Tree
    names: DataFrame
    top: Tree
    root: str | None


def manifest(docs: DataFrame, other: Column | None = None, fields=FIELDS, group: str = "lang", order: str = "doc_id") -> Manifest:
    """The trees of ``docs``. ``other`` stands for the field ``text`` in a second leaf digest."""
    own = {f: F.col(f) for f in fields}
    changed = own if other is None else {**own, "text": other}
    rows = docs.select(
        F.col(order).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),  # null first
        F.unhex(leaf_digest(own)).alias("digest"),
        F.unhex(leaf_digest(changed)).alias("other"),
    )
    rows = stored(rows, "manifest-leaves")
    # Equal rows are told apart by their place, so that they, too, are dealt out evenly.
    rows = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    rows = numbered(rows, ["grp", "doc_id", "digest", "tie"], "manifest-ranked").drop("tie")
    # The first rank of a group names its tree and keeps the groups in order.
    spans = stored(rows.groupBy("grp").agg(F.min("rank").alias("tree"), F.count("*").alias("n")), "manifest-groups")
    most = spans.agg(F.max("n")).first()[0] or 0
    leaves = rows.join(spans, "grp").select(
        "doc_id", "tree", (F.col("rank") - F.col("tree")).alias("rank"), "n", "digest", "other"
    )
    groups = plant(leaves, most, "manifest-blocks")
    name = F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias("name")
    names = numbered(groups.roots.join(spans.select("tree", name), "tree"), ["tree"], "manifest-names")
    count = names.count()
    over = names.select(F.lit(0).cast("long").alias("tree"), "rank", F.lit(count).cast("long").alias("n"), "digest")
    top = plant(over, count, "manifest-top")
    root = top.roots.first()
    return Manifest(leaves, groups, names, top, root and bytes(root["digest"]).hex())


# ---- proofs


def proofs(m: Manifest) -> DataFrame:
    """For each row ``doc_id, leaf, subroot, root``, ``proof_sha256`` (the digest of the
    siblings on its path, upwards, each level from left to right) and ``folded_root``,
    what ``other`` and those siblings come to."""
    none = F.array().cast("array<string>")
    start = m.top.roots.select("tree", none.alias("l"), none.alias("r"))
    over = _descend(m.top.layers, start).select(F.col("block").alias("rank"), "l", "r")
    above = stored(m.names.join(over, "rank").select("tree", "digest", "l", "r"), "manifest-paths")
    lowest = m.groups.layers[0].select("tree", "block", "height", "nodes")
    blocks = lowest.join(_descend(m.groups.layers[1:], above), ["tree", "block"])
    blocks = blocks.join(above.select("tree", F.hex("digest").alias("subroot")), "tree")
    per_block = FAN**HEIGHT
    dealt = m.leaves.withColumn("block", F.floor(F.col("rank") / per_block))

    def fold(rows, block):
        rows, b = rows.sort_values("rank"), block.iloc[0]
        nodes = np.frombuffer(b["nodes"], np.uint8).reshape(-1, 32)
        upper = list(zip(b["l"], b["r"]))
        tail = "".join(x + y for x, y in upper).encode()
        ends: dict[str, str] = {}  # most rows of a block reach the same digest at its root
        proof, folded = [], []
        for path, other in zip(siblings(nodes, b["height"], len(rows)), rows["other"]):
            proof.append(hashlib.sha256("".join(x + y for x, y in path).encode() + tail).hexdigest())
            at = climb(other.hex(), path)
            if at not in ends:
                ends[at] = climb(at, upper)
            folded.append(ends[at])
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"], "leaf": [x.hex() for x in rows["digest"]], "subroot": b["subroot"].lower(),
                "proof_sha256": proof, "folded_root": folded,
            }
        )

    kind = m.leaves.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"
    met = dealt.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(fold, schema)
    return met.withColumn("root", F.lit(m.root).cast("string"))


def lower_cased(every: int = 3, doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tampering: A-Z of the text lower-cased where ``every`` divides the crc32 of the id."""
    hit = F.crc32(F.col(doc_id).cast("string")) % every == 0
    return F.when(hit, ascii_lower(F.col(text))).otherwise(F.col(text))
