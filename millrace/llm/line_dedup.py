"""Corpus-wide removal of repeated lines with levelled sorted runs of line hashes.

Keys of lines live in *runs*: tables of ``(h1, h2, n, owner)``, sorted by hash, where ``n``
counts documents and ``owner`` is the largest doc_id seen. A batch of documents is
aggregated to one row per key, merge-anti-joined with the keys that the runs have already
settled, and written as a new run of level 0. ``fanout`` runs of a level are merged into
one run of the next level, so a store of N batches holds O(log N) runs.

Batches go from large doc_ids to small ones: once a key is settled (found in enough
documents) its owner is known, and no later batch can change it.

Defined cases. Null or empty text: one empty line, which is kept. Rows that share a
doc_id are one document in the counts; the lines of each are kept or dropped by the same
rule. A null doc_id counts as a document of its own and its lines always stay. No rows:
no result rows. Extra columns stay, but for those named like an added one, which it
replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, stored, text_of

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
BLANKS = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line long enough to count: ``doc_id, tid, pos, h1, h2``.

    The two 64-bit hashes stand for the key; ``tid`` tells rows of one doc_id apart."""
    text = text_of()
    lines = docs.select("doc_id", F.xxhash64(text).alias("tid"), F.posexplode(_lines(text)).alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = lines.select("doc_id", "tid", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return lines.select(
        "doc_id", "tid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")
    )


class LineRuns:
    """Levelled runs of line hashes in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, min_docs: int = MIN_DOCS):
        self.spark, self.fanout, self.min_docs = spark, fanout, min_docs
        self.levels: list[list[DataFrame]] = []

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def settled(self) -> DataFrame | None:
        """Keys that some run alone has found in enough documents."""
        runs = [r.where(F.col("n") >= self.min_docs).select(*HASH) for r in self._runs()]
        return reduce(DataFrame.unionAll, runs) if runs else None

    def add(self, lines: DataFrame) -> None:
        """Take a batch of :func:`line_hashes`, of smaller doc_ids than all batches before."""
        doc = F.coalesce(F.col("doc_id"), F.col("tid"))
        one_each = lines.select(*HASH, "doc_id", F.struct(F.col("doc_id").isNull(), doc).alias("doc"))
        keys = one_each.groupBy(*HASH).agg(F.count_distinct("doc").alias("n"), F.max("doc_id").alias("owner"))
        settled = self.settled()
        if settled is not None:
            keys = keys.join(settled.hint("merge"), HASH, "left_anti")
        self._write(keys, 0)

    def _write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        run = stored(run.sortWithinPartitions(*HASH), f"line-run-{level}")
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionAll, runs)
        return rows.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))

    def repeated(self) -> DataFrame:
        """Keys found in at least ``min_docs`` documents, with the document that keeps them."""
        return self._merged(self._runs()).where(F.col("n") >= self.min_docs).select(*HASH, "owner")


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    into: str = "kept",
) -> DataFrame:
    """``docs`` with ``n_lines, n_dropped`` and the remaining text in the column ``into``."""
    parts = [i / batches for i in range(1, batches)]
    edges = (parts and docs.agg(F.percentile_approx("doc_id", parts, 1000)).first()[0]) or []
    doc_id = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    batch = reduce(lambda a, b: a + b, [(doc_id <= e).cast("int") for e in edges], F.lit(0))
    lines = stored(line_hashes(docs, min_chars).withColumn("batch", batch), "line-hashes", by="batch")

    runs = LineRuns(docs.sparkSession, fanout, min_docs)
    for i in range(len(edges) + 1):
        runs.add(lines.where(F.col("batch") == i))

    # Written first: with a shuffle of its own on both sides the join can split a hot line.
    repeated = stored(runs.repeated(), "repeated-lines")
    dropped = lines.join(repeated.hint("merge"), HASH).where(F.col("doc_id") != F.col("owner"))
    dropped = dropped.groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("gone"))
    # The row travels as one value, so that no column of it can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64(text_of()).alias("tid"))
    on = (rows["doc_id"] == dropped["doc_id"]) & (rows["tid"] == dropped["tid"])
    text = F.coalesce(F.col("row").getField("text"), F.lit(""))
    rows = rows.join(dropped, on, "left").select("row", "gone", _lines(text).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    n_dropped = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    own = {into: left, "n_lines": F.size("lines").cast("long"), "n_dropped": n_dropped}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in own]
    rows = rows.select("row", F.struct(*[v.alias(k) for k, v in own.items()]).alias("own"))
    return rows.select(*kept, *[F.col("own").getField(k).alias(k) for k in own])
