"""Removal of byte strings of a given length that stand in more than one place.

Prefix doubling over a sample of positions. Of every ``span`` consecutive positions the one
with the least hash of its next bytes is an anchor (ties: the leftmost). The choice looks at
fewer bytes than ``length``, so equal strings of ``length`` bytes choose the same anchor, and
every start of such a string belongs to exactly one anchor, at the same distance in all its
copies. Anchors cut a text into chunks.

1. Doubling. A position's rank is the name of its chunk; Spark sorts the ranks, and positions
   with a unique one leave. The pair of the ranks at a position and at the offset of 1, 2, 4
   ... chunks is the rank at twice the offset; pairs are sorted again, until a position is
   unique or its run is past ``length`` bytes. A rank is a 128-bit name of what it stands
   for, so ranks need no renumbering.
2. The starts of an anchor share an inner run of chunks, which all their copies have: if its
   rank is unique, none of them is repeated. Its outer run holds all their strings: if a
   pair of ranks covering it is found twice, all of them are repeated.
3. The rest are starts near the ends of a repeated passage. Their strings are named
   themselves, in blocks of ``BLOCKS`` distances to the anchor (again an inner string decides
   that none, an outer string that all are repeated), down to one by one.

Sorting replaces every join on names: a name is repeated if a neighbour in the sorted order
has it. Rows of a name that meet in a batch are numbered before; only the first of a batch
must meet the others, so a name that a third of all rows share is spread over many tasks,
and no sample of the rows is taken. Pairs of ranks are formed text by text, without a join.
One of each class settled early stays in later rounds as a witness; no pairs of copies are
ever made.

Defined cases. Null or empty text, and texts shorter than ``length``, lose nothing. Matches
never cross texts; overlapping ones in one text count. Rows that share an id, or are equal,
are different texts. Bytes that are no valid UTF-8 are treated like others. No rows: no
result rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch_path

LENGTH = 400
#: Bytes whose hash decides whether a position is an anchor.
GRAM = 16
#: Distances to an anchor that are named together, from round to round.
BLOCKS = (16, 4, 1)
#: Bytes of text whose hashes are held at once.
SLICE = 1 << 17
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder, and where; the shuffles of the step are removed
    when it is written."""
    spark, conf = df.sparkSession, df.sparkSession.conf
    path = scratch_path(spark, f"substrings-{name}")
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEAN, before) if before is not None else conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables of the steps so far, which go when no later step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        rows, path = _stored(df, name)
        self.paths.append(path)
        return rows

    def clear(self, but: int = 0) -> None:
        """Remove all tables but the last ones."""
        gone = self.paths[: len(self.paths) - but]
        self.paths = self.paths[len(gone) :]
        for name in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


# ---- anchors and chunks of texts


def reach_of(length: int) -> int:
    """Consecutive positions of which one is an anchor: the first and the last such
    window of a string of ``length`` bytes have no position in common."""
    return (length - GRAM + 1) // 2


def anchors_at(buf: np.ndarray, span: int) -> np.ndarray:
    """For each p the leftmost position of least hash among p to p + span - 1."""
    n = len(buf) - span - GRAM + 2
    out = np.empty(max(n, 0), np.int64)
    for start in range(0, len(out), SLICE):
        part = buf[start : min(start + SLICE, n) + span + GRAM - 2]
        h = (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        base, step = 0xD6E8FEB86659FD93, 1
        while step < GRAM:
            h = h[:-step] * np.uint64(base) + h[step:]
            base, step = base * base % (1 << 64), 2 * step
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h &= np.uint64(0xFFFFFFFFFF000000)  # the rest holds the position, so that ties go left
        h |= np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if step < span:
            h = np.minimum(h[: len(h) - (span - step)], h[span - step :])
        out[start : start + len(h)] = (h & np.uint64(0xFFFFFF)).astype(np.int64) + start
    return out


def _pack(*parts: np.ndarray) -> np.ndarray:
    """Four numbers below 65,536 in a long."""
    a, b, c, d = (np.asarray(x, np.int64) for x in parts)
    return a << 48 | b << 32 | c << 16 | d


def chunks(bodies: list[bytes], length: int) -> dict[str, np.ndarray]:
    """The chunks of texts, numbered from 0 in each: ``text`` (its place in the list), ``i``,
    ``runs`` (chunks back to the one holding the first start of the chunk's anchor and on
    to the one holding the end of its last string, chunks of the inner run, chunks until
    ``length`` bytes are passed), ``place`` (first start, number of starts, distance to the
    anchor), and the name ``n1, n2``."""
    span = reach_of(length)
    width = span + GRAM - 1
    keep = [k for k, b in enumerate(bodies) if len(b) >= length]
    flat = b"".join(bodies[k] for k in keep)
    sizes = np.array([len(bodies[k]) for k in keep], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = anchors_at(np.frombuffer(flat, np.uint8), span)
    inside = np.zeros(len(at) + 1, np.int8)  # windows that lie in one text
    np.add.at(inside, starts[:-1], 1)
    np.add.at(inside, np.minimum(starts[:-1] + sizes - width + 1, len(at)), -1)
    p = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    a = at[p]
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    s, lo = a[new], p[new]  # an anchor and the first start that chose it
    text = np.searchsorted(starts, s, side="right") - 1
    first = np.searchsorted(text, np.arange(len(keep)))  # the first anchor of each text
    i = np.arange(len(s)) - first[text] + 1
    hi = np.concatenate([p[new[1:] - 1], p[-1:]]) if len(a) else p
    hi = np.minimum(hi, starts[text] + sizes[text] - length)
    gap = np.maximum(hi - lo + 1, 0)
    index_of = lambda pos: np.searchsorted(s, pos, side="right") - 1
    back = np.arange(len(s)) - np.maximum(index_of(lo), first[text] - 1)
    ahead = index_of(hi + length - 1) - np.arange(len(s))
    chosen = np.minimum(lo + length - width, len(at) - 1)  # the last window in the string of the first start
    inner = index_of(at[chosen]) - np.arange(len(s))
    past = np.searchsorted(s, s + length) - np.arange(len(s))  # a text's end counts as far away
    runs = _pack(back, np.where(gap > 0, ahead, 0), np.where(gap > 0, inner, 0), past)
    place = (lo - starts[text]) << 32 | gap << 16 | (s - lo)
    # With the chunk before the first anchor of each text.
    order = np.argsort(np.concatenate([np.arange(len(keep)), text]), kind="stable")
    join = lambda head, rest: np.concatenate([head, rest])[order]
    none = np.zeros(len(keep), np.int64)
    past_head = np.searchsorted(s, starts[:-1] + length) - first + 1
    owner, begin = join(np.arange(len(keep)), text), join(starts[:-1], s)
    end = np.append(begin[1:], len(flat))
    names = b"".join([blake2b(flat[x:y], digest_size=16).digest() for x, y in zip(begin.tolist(), end.tolist())])
    names = np.frombuffer(names, np.int64).reshape(-1, 2)
    return {
        "text": np.array(keep, np.int64)[owner] if keep else owner,
        "i": join(none, i).astype(np.int32),
        "runs": join(_pack(none, none, none, past_head), runs),
        "place": join(none, place),
        "n1": names[:, 0],
        "n2": names[:, 1],
    }


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose values of a binary column come to some ``SLICE``
    bytes, so that few texts are held as Python values at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE)) + 1
        yield batch.slice(at, upto - at)
        at = upto


def _chunk_table(docs: DataFrame, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 1):
                made = chunks(part.column(1).to_pylist(), length)
                made["row"] = part.column(0).to_numpy()[made.pop("text")]
                yield _numbered(pa.RecordBatch.from_pydict({c: made[c] for c in ("row", "i", "runs", "place", "n1", "n2")}))

    long = docs.where(F.octet_length("body") >= length).select("row", "body")
    return long.mapInArrow(cut, f"row long, i int, runs long, place long, n1 long, n2 long, {_NUMBERS}")


# ---- sorted names


_NUMBERS = "known boolean, copy int"


def _numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """With ``known`` (another row here has the name) and ``copy`` (rows of the name before
    it here)."""
    a, b = (batch.column(c).to_numpy() for c in ("n1", "n2"))
    order = np.argsort(a, kind="stable")
    new = np.ones(len(a), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    known, copy = np.empty(len(a), bool), np.empty(len(a), np.int32)
    known[order] = np.diff(starts, append=len(a))[group] > 1
    copy[order] = np.arange(len(a)) - starts[group]
    return batch.append_column("known", pa.array(known)).append_column("copy", pa.array(copy))


def _marked(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Numbered rows sorted by name and copy, with ``twice`` (a neighbour has the name, or it
    was known) and ``head`` (the first of its name). Other rows are dropped unless ``keep``."""

    def mark(rows: pa.Table, prev, last: bool):
        a, b, known, copy = (rows.column(c).to_numpy() for c in ("n1", "n2", "known", "copy"))
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        up = np.concatenate([[prev == (a[0], b[0])], same])
        twice = up | np.append(same, False) | known
        rows = rows.drop_columns(["known", "copy"])
        for name, flag in (("twice", twice), ("head", ~up & (copy == 0))):
            rows = rows.append_column(name, pa.array(flag))
        n = len(a) if last else len(a) - 1  # the last one may go on in the next batch
        rows = rows.slice(0, n)
        return (rows if keep else rows.filter(pa.array(twice[:n]))), ((a[n - 1], b[n - 1]) if n else prev)

    rest, prev = None, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not len(rows):
            continue
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        rest = rows.slice(len(rows) - 1)
        done, prev = mark(rows, prev, last=False)
        yield from done.to_batches()
    if rest is not None:
        yield from mark(rest, prev, last=True)[0].to_batches()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def recurring(df: DataFrame, name: str, scratch: Scratch, keep: bool = False) -> DataFrame:
    """The rows of ``df`` whose name ``n1, n2`` another row has, and ``head`` for one row of
    each name. With ``keep`` all rows, and ``twice`` for those. ``df`` may be numbered; its
    rows must come in the same order whenever they are read."""
    if "copy" not in df.columns:
        df = df.mapInArrow(lambda batches: map(_numbered, batches), f"{_ddl(df)}, {_NUMBERS}")
    rows = df.repartition("n1", "copy").sortWithinPartitions("n1", "n2", "copy")
    schema = f"{_ddl(df.drop('known', 'copy'))}, twice boolean, head boolean"
    rows = rows.mapInArrow(lambda batches: _marked(batches, keep), schema)
    rows = scratch.stored(rows, name)
    return rows if keep else rows.drop("twice")


# ---- doubling


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, ``row``, with all rows of a text at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        row = batch.column(0).to_numpy()
        cut = int(np.searchsorted(row, row[-1]))  # the last text may go on in the next batch
        if held and held[0].column(0)[0].as_py() != row[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _mixed(seed: int, parts: list[np.ndarray]) -> np.ndarray:
    h = np.uint64(seed)
    for p in parts:
        h = (h ^ p.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15 ^ seed)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _pairs(now: DataFrame, h: int) -> DataFrame:
    """The runs of ``2 * h`` chunks, numbered, of repeated runs of ``h``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            row, i, runs, n1, n2 = (rows.column(c).to_numpy() for c in ("row", "i", "runs", "n1", "n2"))
            key = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]])) << 32 | i
            here = np.flatnonzero((runs & 0xFFFF) > h)  # not yet past the length
            there = np.minimum(np.searchsorted(key, key[here] + h), len(key) - 1)
            ok = key[there] == key[here] + h
            here, there = here[ok], there[ok]
            names = [n1[here], n2[here], n1[there], n2[there]]
            cols = {"row": row[here], "i": i[here], "runs": runs[here], "n1": _mixed(0x51ED27, names), "n2": _mixed(0xC2B2AE, names)}
            yield _numbered(pa.RecordBatch.from_pydict(cols))

    rows = now.repartition("row").sortWithinPartitions("row", "i")
    return rows.mapInArrow(join, f"{_ddl(now)}, {_NUMBERS}")


def levels(first: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The repeated runs of 1, 2, 4 ... chunks: ``row, i, runs, n1, n2``."""
    out, h = [first.select("row", "i", "runs", "n1", "n2")], 1
    while True:
        pairs = recurring(_pairs(out[-1], h), f"runs-{2 * h}", scratch).drop("head")
        if pairs.isEmpty():
            return out
        out.append(pairs)
        h *= 2


def _judged(row, level, i, runs, place, n1, n2) -> dict[str, np.ndarray]:
    """Of rows sorted by row, level and i, the anchors whose inner run is repeated, with the
    two ranks that cover the outer run, where both are repeated."""
    text = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]).astype(np.int64)]))
    key = (text << 5 | level) << 31 | i

    def find(t, lv, at):
        want = (t << 5 | lv) << 31 | at
        k = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return k, (key[k] == want) & (at >= 0)

    own = np.flatnonzero((level == 0) & ((place >> 16 & 0xFFFF) > 0))
    back, ahead, inner = (runs[own] >> 48) & 0xFFFF, (runs[own] >> 32) & 0xFFFF, (runs[own] >> 16) & 0xFFFF
    t, at = text[own], i[own].astype(np.int64)
    log = lambda x: np.frexp(x.astype(np.float64))[1].astype(np.int64) - 1

    def cover(start, count):
        lv = log(count)
        a, ok = find(t, lv, start)
        b, too = find(t, lv, start + count - (1 << lv))
        return a, b, ok & too

    alive = cover(at, inner)[2]
    a, b, known = cover(at - back, back + ahead + 1)
    take = own[alive]
    a, b, known = a[alive], b[alive], known[alive]
    return {
        "row": row[take], "i": i[take], "place": place[take], "k1": n1[take], "k2": n2[take],
        "size": (back << 16 | ahead)[alive], "a1": n1[a], "a2": n2[a], "b1": n1[b], "b2": n2[b], "known": known,
    }


def _name(*parts) -> list[Column]:
    return [F.xxhash64(F.lit(k), *parts).alias(f"n{k}") for k in (1, 2)]


def judged(first: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """``row, i, place``, the chunk's name ``k1, k2`` and the outer run's name ``n1, n2``
    (null: not repeated) of the anchors whose inner run is repeated."""
    long = first.select("row", F.lit(0).alias("level"), "i", "runs", "place", "n1", "n2")
    for k, df in enumerate(runs[1:], start=1):
        long = long.unionAll(df.select("row", F.lit(k), "i", F.lit(0).cast("long"), F.lit(0).cast("long"), "n1", "n2"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            cols = [rows.column(c).to_numpy() for c in ("row", "level", "i", "runs", "place", "n1", "n2")]
            yield pa.RecordBatch.from_pydict(_judged(cols[0], cols[1].astype(np.int64), *cols[2:]))

    schema = (
        "row long, i int, place long, k1 long, k2 long, size long, a1 long, a2 long, b1 long, b2 long, known boolean"
    )
    rows = long.repartition("row").sortWithinPartitions("row", "level", "i").mapInArrow(walk, schema)
    within = F.col("place").bitwiseAND(0xFFFFFFFF)  # the same starts, as far from the anchor
    outer = [F.when(F.col("known"), c).alias(f"n{k}") for k, c in enumerate(_name("a1", "a2", "b1", "b2", "size", within), 1)]
    return rows.select("row", "i", "place", "k1", "k2", *outer)


# ---- strings near the ends of passages


def _lo(c: str = "place") -> Column:
    return F.shiftright(c, 32)


def _gap(c: str = "place") -> Column:
    return F.shiftright(c, 16).bitwiseAND(0xFFFF)


def _digest(*parts: bytes) -> bytes:
    h = blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    return h.digest()


def _long_pair(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def _block_names(items: DataFrame, length: int, block: int) -> DataFrame:
    """For each block of the distances ``x`` to ``y`` of an item: its least and largest
    distance, the inner name ``n1, n2`` of all of the block (wherever it may begin), numbered,
    and the outer name ``o1, o2`` of the strings at these distances."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _portions(whole, 6)):
            out: dict[str, list] = {c: [] for c in ("row", "i", "witness", "x", "y")}
            inner, outer = [], []
            for row, i, far, witness, first, last, body in zip(*(c.to_pylist() for c in batch.columns)):
                for b in range(first // block, last // block + 1):
                    x, y = max(block * b, first), min(block * b + block - 1, last)
                    for c, v in zip(out, (row, i, witness, x, y)):
                        out[c].append(v)
                    inner.append(_digest(b"%d:" % b, body[far - block * b : far - block * b - block + 1 + length]))
                    if block > 1:
                        outer.append(_digest(b"%d:%d:" % (x, y), body[far - y : far - x + length]))
            n, o = _long_pair(inner), _long_pair(outer or inner)
            cols = {**out, "n1": n[0], "n2": n[1], "o1": o[0], "o2": o[1]}
            types = {"i": pa.int32(), "x": pa.int32(), "y": pa.int32(), "witness": pa.bool_()}
            yield _numbered(pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.int64())) for c, v in cols.items()}))

    far = F.col("place").bitwiseAND(0xFFFF).cast("int").alias("far")
    rows = items.select("row", "i", far, "witness", "x", "y", "body")
    schema = "row long, i int, witness boolean, x int, y int, n1 long, n2 long, o1 long, o2 long"
    return rows.mapInArrow(cut, f"{schema}, {_NUMBERS}")


def _refined(items: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """``row, i, x, y``: the distances of the items, other than witnesses, whose strings are
    repeated. ``items``: ``row, i, place, witness, body``, all that may equal each other."""
    far = F.col("place").bitwiseAND(0xFFFF)
    open_ = items.select("row", "i", "witness", F.greatest(far - _gap() + 1, F.lit(0)).cast("int").alias("x"), far.cast("int").alias("y"))
    found = []
    for block in BLOCKS:
        asked = items.drop("witness").join(open_, ["row", "i"])
        names = scratch.stored(_block_names(asked, length, block), f"names-{block}")
        same = recurring(names, f"inner-{block}", scratch).drop("head")
        if block == 1:
            found.append(same.where("not witness").select("row", "i", "x", "y"))
            break
        same = same.withColumnsRenamed({"n1": "m1", "n2": "m2", "o1": "n1", "o2": "n2"})
        same = recurring(same, f"outer-{block}", scratch, keep=True)
        found.append(same.where("twice and not witness").select("row", "i", "x", "y"))
        cols = ["row", "i", "x", "y", "m1", "m2"]
        left = same.where("not twice and not witness").select(cols)
        seen = same.where("witness or twice").where("head or not twice").select(cols)
        seen = seen.join(left.select("m1", "m2").distinct(), ["m1", "m2"], "left_semi").select(cols)
        open_ = left.withColumn("witness", F.lit(False)).unionAll(seen.withColumn("witness", F.lit(True))).drop("m1", "m2")
    return reduce(DataFrame.unionAll, found)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``row, start, end``: bytes of ``row, body`` covered by repeated strings. Spans of a
    row may overlap."""
    if not 2 * GRAM <= length < 1 << 15:
        raise ValueError(f"length must lie between {2 * GRAM} and {(1 << 15) - 1}")
    scratch = Scratch(docs.sparkSession)
    first = recurring(_chunk_table(docs, length), "repeated-chunks", scratch)
    anchors = scratch.stored(judged(first, levels(first, scratch)), "anchors")
    scratch.clear(but=1)
    sure = recurring(anchors.where("n1 is not null"), "outer", scratch, keep=True)
    spans = sure.where("twice").select("row", _lo().alias("start"), (_lo() + _gap() - 1 + length).alias("end"))

    cols = ["row", "i", "place", "k1", "k2"]
    unsure = sure.where("not twice").select(cols).unionAll(anchors.where("n1 is null").select(cols))
    kinds = unsure.select("k1", "k2").distinct()
    witnesses = sure.where("twice and head").select(cols).join(kinds, ["k1", "k2"], "left_semi").select(cols)
    items = unsure.withColumn("witness", F.lit(False)).unionAll(witnesses.withColumn("witness", F.lit(True)))
    body = F.substring(F.col("body"), (_lo() + 1).cast("int"), (_gap() - 1 + length).cast("int"))
    items = docs.join(items, "row").select("row", "i", "place", "witness", body.alias("body"))
    items = scratch.stored(items, "items")

    found = _refined(items, length, scratch).join(items.select("row", "i", "place"), ["row", "i"])
    at = _lo() + F.col("place").bitwiseAND(0xFFFF)
    found = found.select("row", (at - F.col("y")).alias("start"), (at - F.col("x") + length).alias("end"))
    out = _stored(spans.unionAll(found), "spans")[0]
    scratch.clear()
    return out


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes) for every row of ``doc_id, text``."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", body.alias("body"))
    docs = _stored(docs, "texts")[0]
    spans = repeated_spans(docs.select("row", "body"), length)
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))  # of one text
    spans = spans.select("row", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    gaps = spans.mapInArrow(_between, "row long, n_removed long, n_spans long, starts array<int>, sizes array<int>")
    rows = docs.join(gaps, "row", "left")
    # Bytes as they are: a cast neither checks nor changes them.
    pieces = F.zip_with("starts", "sizes", lambda x, n: F.substring(F.col("body"), x + 1, n).cast("string"))
    kept = F.coalesce(F.array_join(pieces, "").cast("binary"), F.col("body"))
    none = F.lit(0).cast("long")
    return rows.select(
        "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), kept.alias("kept"),
    )


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted spans that may overlap: how many bytes and runs they cover, and the pieces
    before, between and after them."""
    for batch in batches:
        removed, count, begin, size = [], [], [], []
        for starts, ends in zip(batch.column(1), batch.column(2)):
            starts, last = starts.values.to_numpy(), np.maximum.accumulate(ends.values.to_numpy())
            new = np.flatnonzero(np.concatenate([[True], starts[1:] > last[:-1]]))
            first, upto = starts[new], last[np.append(new[1:], len(last)) - 1]
            removed.append(int((upto - first).sum()))
            count.append(len(new))
            begin.append(np.concatenate([[0], upto]))
            size.append(np.append(first, 2**31 - 1) - begin[-1])  # the last one goes to the end
        ints = pa.list_(pa.int32())
        cols = [batch.column(0), pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
                pa.array([x.astype(np.int32) for x in begin], ints), pa.array([x.astype(np.int32) for x in size], ints)]
        yield pa.RecordBatch.from_arrays(cols, ["row", "n_removed", "n_spans", "starts", "sizes"])
