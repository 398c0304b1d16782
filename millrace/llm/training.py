"""The labelled rows that classifiers learn from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored, text_of


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no classifier learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of labelled texts, ``doc_id, text, y``, and how many labelled rows
    there are of each class. ``per_class`` is the bound: the rows with the smallest hashes
    of their doc_id. A doc_id with several labels has the largest of them."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(n) for y, n in per_class.items()]
    chosen = F.broadcast(reduce(DataFrame.unionAll, chosen))  # as many rows as per_class allows
    rows = docs.select("doc_id", text_of().alias("text")).join(chosen, "doc_id")
    return stored(rows, f"labelled-{label}"), totals
