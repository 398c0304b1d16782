"""Benchmark passages in documents, by a prefix-filtered set join.

A benchmark item is cut into windows of ten consecutive words (a shorter item is one
window). Whole containment needs every token of a window, so one token is prefix enough:
each window is filed under its rarest word by the corpus' own counts. A document word
that equals it proposes a place; the length and positional bounds say whether the window
fits there, and the words themselves are compared in the same join.

Defined cases. Null or empty texts have no words and no hits. Rows that share a doc_id
but not the text are judged each by its own text; equal rows come out as often as they
came in. A null item_id hits words but is not listed. Equal windows are compared once.
An empty benchmark leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import row_key, stored, text_of, words

WINDOW = 10
#: Window tables up to this many bytes, words and their counts included, are sent to every
#: executor; larger ones meet the words of the documents in a shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: ``window`` (its words), ``items`` (ids as strings, sorted)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    start = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    rows = items.select("item_id", "w", F.explode(start).alias("s"))
    rows = rows.select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("window"))
    return rows.groupBy("window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def word_counts(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """How often each word of ``vocabulary`` stands in all documents."""
    seen = docs.select(F.explode(words(F.col("text"))).alias("word"))
    seen = seen.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi")
    return seen.groupBy("word").agg(F.count("*").alias("n"))


def prefixed(windows: DataFrame, counts: DataFrame, small: bool) -> DataFrame:
    """Each window under its rarest word (ties: the smaller word, then its first place)."""
    places = windows.select("*", F.posexplode("window").alias("at", "word"))
    places = places.join(F.broadcast(counts) if small else counts, "word", "left")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")
    best = places.groupBy("window", "items").agg(F.min(rank).alias("r"))
    return best.where(F.col("r.n") > 0).select("window", "items", F.col("r.word").alias("token"), F.col("r.at").alias("at"))


def _found_small(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Window table on every executor: no document word is shuffled."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("tid"), words(F.col("text")).alias("w"))
    # The empty word after the last one never matches and carries the document through.
    rows = rows.select("*", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    start, length = F.col("pos") - F.col("at"), F.size("window")
    fits = (start >= 0) & (start + length <= F.size("w"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, length) == F.col("window")
    rows = rows.join(F.broadcast(index), (F.col("word") == F.col("token")) & fits & same, "left")
    rows = rows.where(F.col("token").isNotNull() | (F.col("pos") == F.size("w")))
    return rows.select(
        "doc_id", "tid", "items", F.size("w").alias("n"), start.alias("s"), length.alias("len"),
        F.col("token").isNull().cast("int").alias("own"),
    )


def _found_large(docs: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """Window table too large to send: the words meet it in a shuffle, each with the few
    words around it that a window can cover."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("tid"), words(F.col("text")).alias("w"))
    places = rows.select("doc_id", "tid", "w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    around = F.slice("w", low + 1, F.col("pos") - low + size)
    near = places.select("doc_id", "tid", "n", "pos", "word", around.alias("around"), low.alias("low"))
    start, length = F.col("pos") - F.col("at"), F.size("window")
    fits = (start >= 0) & (start + length <= F.col("n"))
    same = F.slice("around", F.greatest(start - F.col("low"), F.lit(0)) + 1, length) == F.col("window")
    hits = near.join(index, (F.col("word") == F.col("token")) & fits & same)
    hits = hits.select("doc_id", "tid", "items", "n", start.alias("s"), length.alias("len"), F.lit(0).alias("own"))
    none = F.lit(None)
    own = rows.select(
        "doc_id", "tid", none.cast("array<string>").alias("items"), F.size("w").alias("n"),
        none.cast("int").alias("s"), none.cast("int").alias("len"), F.lit(1).alias("own"),
    )
    return own.unionByName(hits)


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items`` (sorted ids) and ``contaminated``."""
    windows = stored(item_windows(benchmark, size), "bench-windows")
    # What one executor would hold: of a window its words and items, each with 40 bytes of
    # its own, and as much again for the word it is filed under and the counts of its words.
    held = [F.octet_length(F.concat_ws("", c)) + 40 * F.size(c) for c in ("window", "items")]
    sent = windows.agg(F.sum(2 * sum(held, F.lit(100)))).first()[0] or 0
    small = sent <= broadcast_bytes
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    index = stored(prefixed(windows, word_counts(docs, vocabulary, small), small), "bench-index")
    found = _found_small(docs, index) if small else _found_large(docs, index, size)
    spans = F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "len")))
    rows = found.groupBy("doc_id", "tid").agg(
        F.sum("own").alias("copies"), F.max("n").alias("n"), spans.alias("spans"), F.collect_set("items").alias("sets")
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["s"] + x["len"]).alias("end"),
            (a["hit"] + F.greatest(x["s"] + x["len"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("hit"),
        ),
        lambda a: a["hit"],
    )
    rows = rows.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window, each judged by its own text
    whatever its id."""
    key = ["_k1", "_k2"]
    keyed = docs.withColumns(row_key())
    rows = keyed.select(F.struct(*key).alias("doc_id"), "text")
    dirty = contamination(rows, benchmark, size).where("contaminated").select("doc_id.*").distinct()
    return keyed.join(dirty, key, "left_anti").drop(*key)
