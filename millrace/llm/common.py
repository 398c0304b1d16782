"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import scratch_path

#: What separates words of letters and digits: every other ASCII character.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """``_k1, _k2``: a 128-bit key of a row's id and text. Only rows with the same id, or
    both without one, and the same text share it."""
    parts = [F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text)]
    return {f"_k{k}": F.xxhash64(F.lit(k), *parts) for k in (1, 2)}


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
