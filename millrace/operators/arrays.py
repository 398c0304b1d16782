"""Element-wise sums of ARRAY<DOUBLE> columns per group, block by block.

A vector is cut into blocks of ``BLOCK`` elements. Arrow batches are reduced to one partial
sum for each key and block, which is what is shuffled, and blocks of a key are added up in
different tasks; no row stands for a single element.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Elements of a block: 32 KB.
BLOCK = 4096


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows all have one length, as a 2-D array."""
    n = len(column)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if n == 0:
        return flat.reshape(0, 0)
    width = len(flat) // n
    lengths = np.asarray(column.value_lengths())
    if (lengths != width).any():
        raise ValueError("vectors in one group differ in length")
    return flat.reshape(n, width)


def _added(batches, arrow_schema, keys: list[str], block: int):
    """Blocks of equal key and number added up over all batches of a task."""
    sums: dict[tuple, np.ndarray] = {}
    sizes: dict[tuple, int] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        names = [batch.column(k).to_pylist() for k in keys]
        for at, blk, n, part in zip(zip(*names) if keys else [()] * batch.num_rows, *(batch.column(c).to_pylist() for c in ("block", "_n")), batch.column("data")):
            if sizes.setdefault(at, n) != n:
                raise ValueError("vectors in one group differ in length")
            part = np.asarray(part.values, dtype=np.float64)
            held = sums.get((at, blk))
            sums[at, blk] = part.copy() if held is None else np.add(held, part, out=held)
    for (at, blk), total in sums.items():
        values = [[v] for v in at] + [[blk], [sizes[at]], [total]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow_schema)], schema=arrow_schema)


def sum_blocks(
    df: DataFrame, keys: Sequence[str], column: str, weight: str | None = None, block: int = BLOCK
) -> DataFrame:
    """``sum(weight * column)`` per group as ``keys, block, data``: the sums of elements
    ``block * BLOCK`` and on. Vectors of a group have one length; no block holds a whole one."""
    keys = list(keys)
    src = df.select(
        *keys,
        F.col(column).cast("array<double>").alias("_a"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"),
    )
    schema = T.StructType(
        [src.schema[k] for k in keys]
        + [T.StructField("block", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("data", T.ArrayType(T.DoubleType()))]
    )
    arrow_schema = to_arrow_schema(schema)

    def reduce_batches(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            codes = table.select(keys).append_column("_i", pa.array(np.arange(batch.num_rows)))
            groups = codes.group_by(keys).aggregate([("_i", "list")])
            arrays, weights = batch.column("_a"), np.asarray(batch.column("_w"))
            names = [groups.column(k).to_pylist() for k in keys]
            for g, members in enumerate(groups.column("_i_list")):
                rows = pa.array(members.as_py())
                total = weights[np.asarray(rows)] @ matrix(arrays.take(rows))
                for at in range(0, len(total), block):
                    values = [[c[g]] for c in names] + [[at // block], [len(total)], [total[at : at + block]]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow_schema)], schema=arrow_schema)

    partial = src.mapInArrow(reduce_batches, schema)
    dealt = partial.repartition(*keys, "block")
    return dealt.mapInArrow(lambda batches: _added(batches, arrow_schema, keys, block), schema).drop("_n")


def sum_arrays(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    weight: str | None = None,
    name: str = "data",
) -> DataFrame:
    """``sum(weight * column)`` element by element per group, a whole vector to a row; where
    that is too long for one, :func:`sum_blocks` leaves it in blocks."""
    keys = list(keys)
    blocks = sum_blocks(df, keys, column, weight)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "data"))), lambda s: s["data"]))
    return blocks.groupBy(*keys).agg(whole.alias(name))
