"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors of a label are dealt to shards of bounded size, and a graph is built in each:
level 0 holds all rows, each higher level about a sixteenth of the one below, and rows are
put in by batches, linked to what a beam search finds and to their batch. Every vector
then queries every shard of its label; a task takes a pair of shards and searches both
ways, and a link that either way finds counts at both ends. A beam that still ends above
the threshold is widened, and past ``WIDEST`` the query scans its shard, so dense groups
lose nothing. The first beam of a label is the least that passes an audit pooled over its
shards. The audit counts two kinds of links: those that a sample of the vectors has by a
full scan, and planted ones, a copy of each sampled vector turned to just above the
threshold, whose link to the vector itself must be found; so there is always something to
count, however few links a label has. Only where the widest beam fails, too, is the label
scanned. Cosines are computed in double precision, norms after scaling by the largest
component, so that huge and tiny vectors keep their direction.

Equal vectors are one row with a weight. A task reports a count for each query and a
spanning forest of the links it saw, never the pairs.

Defined cases. A vector that is null, zero or holds null or non-finite components, or has a
null label or vec_id, links with nothing and is its own component. Rows that share a
vec_id are separate vectors in the counts: distinct vectors have numbers of their own. No rows: no result rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.components import components

COSINE = 0.93
SHARD_ROWS, QUERY_ROWS = 8192, 2048
#: Neighbours of a row on level 0 and above, first beam, widest beam.
LINKS, LINKS_UP, BEAM, WIDEST = 24, 12, 32, 256
LEVEL_RATIO, TOP_ROWS = 16, 48
BATCH = 256
#: Sampled vectors of a label, share of the links to find, how far planted copies lie above
#: the threshold.
AUDIT, RECALL, PLANTED = 256, 0.98, 1e-3
BEAMS = [BEAM << i for i in range((WIDEST // BEAM).bit_length())]


class Graph:
    """Levels of neighbour lists over unit vectors; rows of a higher level come first."""

    def __init__(self, vectors: np.ndarray, sizes: list[int] | None = None, levels: list[np.ndarray] | None = None):
        self.x = vectors
        n = len(vectors)
        if sizes is None:
            sizes = [n]
            while sizes[-1] > TOP_ROWS:
                sizes.append(max(sizes[-1] // LEVEL_RATIO, TOP_ROWS if sizes[-1] > TOP_ROWS * LEVEL_RATIO else 16))
        self.sizes = sizes
        self.levels = levels if levels is not None else self._build()

    def _build(self) -> list[np.ndarray]:
        made: list[np.ndarray] = []
        for level in range(len(self.sizes) - 1, -1, -1):
            width = LINKS if level == 0 else LINKS_UP
            links = np.full((self.sizes[level], width), -1, np.int32)
            if not made:
                self._brute(links)
            else:
                start = len(made[0])
                links[:start, : made[0].shape[1]] = made[0][:, :width]
                self.levels = [*[None] * level, links, *made]
                at = start
                while at < len(links):
                    end = min(at + min(BATCH, at), len(links))
                    self._insert(level, links, at, end)
                    at = end
            made.insert(0, links)
        return made

    def _brute(self, links: np.ndarray) -> None:
        x = self.x[: len(links)]
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        k = min(links.shape[1], len(links) - 1)
        if k > 0:
            links[:, :k] = np.argsort(-sims, axis=1, kind="stable")[:, :k]

    def _insert(self, level: int, links: np.ndarray, at: int, end: int) -> None:
        """Link rows ``at:end`` with what the beam finds among the rows before them and
        with the closest of their own batch; old rows keep the closest of both."""
        q = self.x[at:end]
        found, sims = self.search(q, BEAM, level, at)
        width = links.shape[1]
        own = q @ q.T
        np.fill_diagonal(own, -2)
        ids = np.hstack([found, np.tile(np.arange(at, end, dtype=np.int32), (end - at, 1))])
        sims = np.hstack([sims, own])
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids[sims <= -2] = -1
        links[at:end] = self._diverse(ids, sims, width)
        # Back links: every old or new row gathers the batch rows that chose it.
        src = np.repeat(np.arange(at, end, dtype=np.int32), width)
        dst = links[at:end].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        rows, first, many = np.unique(dst, return_index=True, return_counts=True)
        deep = int(many.max()) if len(many) else 0
        if not deep:
            return
        new = np.full((len(rows), deep), -1, np.int32)
        new[np.repeat(np.arange(len(rows)), many), np.arange(len(dst)) - np.repeat(first, many)] = src
        both = np.hstack([links[rows], new])
        s = np.einsum("rd,rkd->rk", self.x[rows], self.x[both])
        s[both < 0] = -2
        order = np.argsort(-s, axis=1, kind="stable")
        both, s = np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1)
        s[:, 1:][both[:, 1:] == both[:, :-1]] = -2
        both[s <= -2] = -1
        links[rows] = self._diverse(both[:, : 2 * width], s[:, : 2 * width], width)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of candidates in order: first those closer to the row than to a closer one of
        them, then the rest, up to ``width``."""
        between = np.einsum("rad,rbd->rab", self.x[ids], self.x[ids])
        earlier = np.tril(np.ones(between.shape[1:], bool), -1)
        shadowed = ((between > sims[:, :, None]) & earlier & (ids >= 0)[:, None, :]).sum(axis=2) > 2
        rank = np.argsort(shadowed | (ids < 0), axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(ids, rank, 1)
        if out.shape[1] < width:
            out = np.hstack([out, np.full((len(out), width - out.shape[1]), -1, out.dtype)])
        return out.astype(np.int32)

    def search(self, q: np.ndarray, beam: int, level: int = 0, known: int | None = None):
        """The ``beam`` closest rows found for every query, best first."""
        top = len(self.sizes) - 1
        n_top = min(self.sizes[top], known or self.sizes[top])
        entry = np.tile(np.arange(n_top, dtype=np.int32), (len(q), 1))
        sims = q @ self.x[:n_top].T
        for at in range(top - 1, level - 1, -1):
            width = beam if at == level else 8
            entry, sims = self._beam(q, entry, sims, width, at, known if at == level else None)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(entry, order, 1), np.take_along_axis(sims, order, 1)

    def _beam(self, q, ids, sims, beam: int, level: int, known: int | None, step: int = 4):
        links = self.levels[level]
        n = len(links) if known is None else known
        seen = np.zeros((len(q), n + 1), bool)
        rows = np.arange(len(q))[:, None]
        seen[rows, ids] = True
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        if ids.shape[1] < beam:
            short = beam - ids.shape[1]
            ids = np.hstack([ids, np.full((len(q), short), n, ids.dtype)])
            sims = np.hstack([sims, np.full((len(q), short), -3.0)])
        done = sims <= -2
        while True:
            active = np.flatnonzero(~done.all(axis=1))
            if not len(active):
                return np.where(ids == n, -1, ids), sims
            pick = np.argsort(done[active], axis=1, kind="stable")[:, :step]
            r = active[:, None]
            fresh = ~done[r, pick]
            done[r, pick] = True
            near = links[np.where(fresh, ids[r, pick], 0)]
            near = np.where(fresh[:, :, None], near, -1).reshape(len(active), -1)
            near = np.where((near < 0) | (near >= n), n, near)
            near = np.where(seen[r, near], n, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            seen[r, near] = True
            seen[:, n] = False
            s = np.einsum("qd,qkd->qk", q[active], self.x[np.minimum(near, len(self.x) - 1)])
            s[near == n] = -3.0
            all_ids, all_sims = np.hstack([ids[active], near]), np.hstack([sims[active], s])
            all_done = np.hstack([done[active], near == n])
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active], sims[active] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
            done[active] = np.take_along_axis(all_done, order, 1)

    def within(self, q: np.ndarray, threshold: float, beam: int) -> list[np.ndarray]:
        """Rows at ``threshold`` or more of every query, widening beams that end above it;
        by a scan where ``beam`` is 0."""
        out: list[np.ndarray | None] = [None] * len(q)
        todo, width = np.arange(len(q)), beam
        while len(todo) and 0 < width <= WIDEST and width < len(self.x):
            found, sims = self.search(q[todo], width)
            full = (sims >= threshold).sum(axis=1) >= width
            for i in np.flatnonzero(~full):
                out[todo[i]] = found[i][sims[i] >= threshold]
            todo, width = todo[full], 2 * width
        for at in range(0, len(todo), BATCH):
            some = todo[at : at + BATCH]
            for i, row in zip(some, q[some] @ self.x.T >= threshold):
                out[i] = np.flatnonzero(row)
        return out


def _unit(rows) -> np.ndarray:
    return _normed(np.array(rows.tolist(), np.float64))


def _normed(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planted(x: np.ndarray, threshold: float) -> np.ndarray:
    """Each row turned in a random direction until its cosine with the row lies just above
    the threshold; the same rows are turned the same way."""
    if x.shape[1] < 2:
        return x
    aside = np.random.default_rng(x.shape[0] * 4099 + x.shape[1]).normal(size=x.shape)
    aside = _normed(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    cos = min(threshold + PLANTED, 1.0)
    return cos * x + np.sqrt(1 - cos * cos) * aside


def _audit(graph: Graph, q: np.ndarray, threshold: float, own: np.ndarray | None = None) -> list[int]:
    """Links of the sample ``q`` by a full scan and planted ones, then those found with each
    of ``BEAMS``; ``own`` is a query's own row in the graph or -1, which is no link."""
    own = np.full(len(q), -1) if own is None else own
    true = [hits[hits != o] for hits, o in zip(graph.within(q, threshold, 0), own)]
    here = np.flatnonzero(own >= 0)
    near = _planted(q[here], threshold) if len(here) else q[:0]
    sums = [sum(map(len, true)) + len(here)]
    for beam in BEAMS:
        if len(sums) > 1 and sums[-1] == sums[0]:
            sums.append(sums[0])
            continue
        got = graph.within(q, threshold, beam)
        back = graph.within(near, threshold, beam) if len(here) else []
        sums.append(sum(len(np.intersect1d(a, b)) for a, b in zip(got, true)) + sum(o in b for o, b in zip(own[here], back)))
    return sums


def _least_beam(sums: list[int]) -> int:
    """The least beam of an audit that passes; 0, a scan, where none does."""
    return next((beam for beam, found in zip(BEAMS, sums[1:]) if found >= RECALL * sums[0]), 0)


def _audited_beam(graph: Graph, q: np.ndarray, threshold: float, own: np.ndarray | None = None) -> int:
    return _least_beam(_audit(graph, q, threshold, own))


def _build(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("h", kind="stable")
    graph = Graph(_unit(part["embedding"]))
    return pd.DataFrame(
        {
            "label": [part["label"].iloc[0]], "d": [part["d"].iloc[0]], "shard": [part["shard"].iloc[0]], "shards": [part["shards"].iloc[0]],
            "ids": [part["rep"].tolist()], "copies": [part["copies"].tolist()],
            "vectors": [np.array(part["embedding"].tolist(), np.float64).tobytes()],
            "sizes": [list(graph.sizes)], "links": [[a.tobytes() for a in graph.levels]],
        }
    )


def _opened(shard) -> tuple[np.ndarray, np.ndarray, Graph]:
    """Ids, weights and graph of a stored shard."""
    ids = np.array(shard["ids"], np.int64)
    x = np.frombuffer(shard["vectors"], np.float64).reshape(len(ids), -1)
    x = _normed(x)
    sizes = [int(s) for s in shard["sizes"]]
    levels = [np.frombuffer(b, np.int32).reshape(s, -1) for b, s in zip(shard["links"], sizes)]
    return ids, np.array(shard["copies"], np.int64), Graph(x, sizes, levels)


def _sampled(threshold: float):
    def run(key: tuple, queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shards):
            return pd.DataFrame({"label": [], "d": [], "sums": []})
        ids, _, graph = _opened(shards.iloc[0])
        place = {int(v): k for k, v in enumerate(ids)}
        own = np.array([place.get(int(v), -1) for v in queries["rep"]])
        return pd.DataFrame({"label": [key[0]], "d": [graph.x.shape[1]], "sums": [_audit(graph, _unit(queries["embedding"]), threshold, own)]})

    return run


def _pair(threshold: float, batch: int):
    def run(key: tuple, shards: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
        lo, hi = key[-2], key[-1]
        if len(shards) < (1 if lo == hi else 2):
            return none  # a shard without rows
        a = _opened(shards.iloc[0])
        b = a if lo == hi else _opened(shards.iloc[1])
        beam = int(shards["beam"].iloc[0])
        linked = np.zeros((len(a[0]), len(b[0])), bool)
        for way, (from_, to) in zip((linked, linked.T), ((a, b), (b, a))):
            q = from_[2].x
            for at in range(0, len(q), batch):
                for k, hits in enumerate(to[2].within(q[at : at + batch], threshold, beam), at):
                    way[k, hits] = True
            if beam == 0:
                break  # a scan finds both ways
        if lo == hi:
            np.fill_diagonal(linked, False)
            linked |= linked.T
        # Sets of the forest: nodes are rows of a, then of b.
        start = 0 if lo == hi else len(a[0])
        node = a[0] if lo == hi else np.concatenate([a[0], b[0]])
        root, counts = node.copy(), np.zeros(len(node), np.int64)
        for k in np.flatnonzero(linked.any(axis=1)):
            hits = np.flatnonzero(linked[k])
            counts[k] += b[1][hits].sum()
            if lo != hi:
                counts[start + hits] += a[1][k]
            sets = np.unique(np.append(root[start + hits], root[k]))
            if len(sets) > 1:
                root[np.isin(root, sets)] = sets[0]
        tied = (root != node) | (counts > 0)
        return pd.DataFrame({"id": node[tied], "n": counts[tied], "root": root[tied]})

    return run


def link_vectors(vectors: DataFrame, threshold: float = COSINE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id`` for every row of ``vec_id, embedding, label``."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(e, lambda v: v != 0)
    good = F.coalesce(good, F.lit(False))
    rows = vectors.select("vec_id", e.cast("array<double>").alias("embedding"), "label", good.alias("good"))

    sound = rows.where("good")
    kinds = sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # A number for each distinct vector; where it goes depends on the vector alone.
    kinds = kinds.withColumns({"rep": F.monotonically_increasing_id(), "h": F.xxhash64("embedding"), "d": F.size("embedding")})
    kinds = stored(kinds, "distinct-vectors")
    size = kinds.groupBy("label", "d").agg(F.count("*").alias("rows"))
    # Vectors of another length are as good as another label.
    size = stored(size.select("label", "d", "rows", F.ceil(F.col("rows") / shard_rows).cast("int").alias("shards")), "label-sizes")
    dealt = kinds.join(size, ["label", "d"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(1)), F.col("shards")).cast("int"))
    named = f"label {vectors.schema['label'].dataType.simpleString()}"
    schema = f"{named}, d int, shard int, shards int, ids array<long>, copies array<long>, vectors binary, sizes array<int>, links array<binary>"
    slim = dealt.select("label", "d", "shard", "shards", "rep", "copies", "h", "embedding")
    graphs = stored(slim.groupBy("label", "d", "shard").applyInPandas(_build, schema), "shard-graphs")

    each = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    thin = F.ceil(F.col("rows") / AUDIT)
    sample = dealt.where(F.pmod(F.xxhash64("h", F.lit(3)), thin) == 0)
    sample = sample.select("label", "d", each.alias("shard"), "rep", "embedding")
    key = ["label", "d", "shard"]
    audits = sample.groupBy(*key).cogroup(graphs.groupBy(*key)).applyInPandas(_sampled(threshold), f"{named}, d int, sums array<long>")
    pooled = audits.groupBy("label", "d").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(BEAMS) + 1)])
    beam = F.lit(0)
    for i in range(len(BEAMS), 0, -1):
        beam = F.when(F.col(f"s{i}") >= RECALL * F.col("s0"), BEAMS[i - 1]).otherwise(beam)
    beams = stored(pooled.select("label", "d", beam.alias("beam")), "label-beams")

    placed = graphs.join(beams, ["label", "d"], "left")
    placed = placed.withColumn("beam", F.coalesce("beam", F.lit(0))).withColumn("other", each)
    placed = placed.select(
        "label", "d", F.least("shard", "other").alias("lo"), F.greatest("shard", "other").alias("hi"), "beam",
        "ids", "copies", "vectors", "sizes", "links",
    )
    pairs = placed.groupBy("label", "d", "lo", "hi").applyInPandas(_pair(threshold, min(BATCH, query_rows)), "id long, n long, root long")
    found = stored(pairs, "vector-links")

    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    trees = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = kinds.join(counts, F.col("rep") == F.col("id"), "left").drop("id")
    named = named.join(trees, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root")
    named = stored(
        named.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"),
        "named-vectors",
    )
    linked = sound.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(rest)
