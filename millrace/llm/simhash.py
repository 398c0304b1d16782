"""Near-duplicate documents by SimHash, joined through a segment-popcount embedding.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the vector of their popcounts
lies at a Manhattan distance of at most the Hamming distance. Two vectors within distance
2 have a common grid point within distance 1 of both, so every fingerprint is filed under
its own point and the 32 neighbours of it, and fingerprints that share a point are
candidates; the Hamming distance decides.

A point that holds many fingerprints is not paired out. Its fingerprints are filed again
under the fingerprint itself and its 64 one-bit variants: two fingerprints within two bits
share such a variant, and those that share one are within two bits, so hanging all of
them on the smallest gives the same components with one link for each row.

Defined cases. Null or empty text: fingerprint zero, linked like any other. Equal rows and
equal texts share a fingerprint, which is joined once. Null doc_ids never name a group.
No rows: no result rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = 16
#: A grid point with more fingerprints than this is split by one-bit variants.
DENSE = 32


def simhash(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint: a bit is set if over half the shingle hashes set it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not words:
        return 0
    total, n = np.zeros(64, np.int64), max(len(words) - size + 1, 1)
    for at in range(0, n, 65536):  # long texts in slices
        part = [xxh64_intdigest(b" ".join(words[i : i + size]), seed) for i in range(at, min(at + 65536, n))]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """``doc_id, fp`` for every row, and the columns ``keys``."""

    @F.pandas_udf("long")
    def fp(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([simhash(t) for t in texts], dtype="int64")

    return docs.select("doc_id", *keys, fp("text").alias("fp"))


def _points(fp: Column) -> Column:
    """The grid point of a fingerprint and its 2 x 16 neighbours: popcounts, stored with
    one added so that none is negative, in 3 bits a segment."""
    width = 64 // SEGMENTS
    mask = F.lit((1 << width) - 1).cast("long")
    own = F.lit(0).cast("long")
    for s in range(SEGMENTS):
        count = F.bit_count(F.shiftrightunsigned(fp, width * s).bitwiseAND(mask)).cast("long")
        own = own + F.shiftleft(count + 1, 3 * s)
    steps = [0] + [sign << (3 * s) for s in range(SEGMENTS) for sign in (1, -1)]
    return F.transform(F.array(*[F.lit(x).cast("long") for x in steps]), lambda x: x + own)


def _variants(fp: Column) -> Column:
    flips = [0] + [1 << b for b in range(63)] + [-(1 << 63)]
    return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: x.bitwiseXOR(fp))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints that give the components of all pairs at
    ``max_bits`` or fewer differing bits. The grid is exact for up to two bits."""
    if max_bits > 2:
        raise ValueError("the grid finds pairs of at most two differing bits")
    filed = distinct.select("fp", F.explode(_points(F.col("fp"))).alias("point"))
    held = filed.groupBy("point").agg(F.count("*").alias("n")).where("n > 1")
    met = filed.join(held, "point")
    thin = met.where(F.col("n") <= dense).select("point", "fp")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits
    pairs = thin.alias("x").join(thin.alias("y"), F.col("x.point") == F.col("y.point"))
    pairs = pairs.where((F.col("x.fp") < F.col("y.fp")) & close).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if max_bits == 2:
        crowd = met.where(F.col("n") > dense).select("fp").distinct()
        again = crowd.select("fp", F.explode(_variants(F.col("fp"))).alias("v"))
        least = again.groupBy("v").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1")
        stars = again.join(least, "v").where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b"))
        pairs = pairs.unionAll(stars)
    return pairs


def _grouped(marked: DataFrame, max_bits: int) -> DataFrame:
    """``marked`` with ``root``, a fingerprint that names the group, and ``component_id``."""
    from millrace.llm.common import stored

    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    root = components(links(distinct.select("fp"), max_bits)).withColumnsRenamed({"node": "fp"})
    named = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = named.join(least, "root").select("fp", "root", "component_id")
    return marked.join(groups, "fp")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row."""
    from millrace.llm.common import stored

    marked = stored(fingerprints(docs), "fingerprints")
    return _grouped(marked, max_bits).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group: the one with the smallest doc_id; of rows that share it, the
    one whose text has the smallest hash, and of equal rows one. Null ids come last."""
    from millrace.llm.common import row_key, stored

    key = ["_k1", "_k2"]
    keyed = docs.withColumns(row_key())
    marked = stored(fingerprints(keyed.select("doc_id", "text", *key), *key), "fingerprints")
    rows = _grouped(marked, max_bits).select("doc_id", "root", *key)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *key)
    owners = rows.groupBy("root").agg(F.min(order).alias("o"))
    owners = stored(owners.select("root", F.col("o._k1").alias("o1"), F.col("o._k2").alias("o2")), "group-owners")
    other = (F.col("_k1") != F.col("o1")) | (F.col("_k2") != F.col("o2"))
    gone = rows.join(owners, "root").where(other).select(*key).distinct()
    kept = keyed.join(gone, key, "left_anti")
    again = owners.select(F.col("o1").alias("_k1"), F.col("o2").alias("_k2")).join(marked, key)
    if not again.groupBy(*key).count().where("count > 1").isEmpty():  # equal rows are told apart by nothing
        kept = kept.dropDuplicates(key)
    return kept.drop(*key)
