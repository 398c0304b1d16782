"""The manifest, the removal of repeated strings and the whitening against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from millrace.llm import manifest, substrings, whitening
from millrace.llm.queries import QUERIES

TABLE = "doc_id long, source string, lang string, n_chars long, text string"


def crowded(df):
    """Extra columns with the names that the operators use inside."""
    names = "row i place n1 n2 runs rank tree block digest other grp place part x index vector gap dim c spans".split()
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


# ---- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    while len(nodes) > 1:
        nodes = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0]


def way(nodes, k):
    """Siblings before and after, level by level."""
    out = []
    while len(nodes) > 1:
        run = k // 8 * 8
        out.append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 8])))
        nodes, k = [sha(*nodes[j : j + 8]) for j in range(0, len(nodes), 8)], k // 8
    return out


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, sha(*map(field, r)), r))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs = [up([x[2] for x in groups[g]]) for g in langs]
    out = []
    for k, g in enumerate(langs):
        leaves = [x[2] for x in groups[g]]
        for j, (_, _, leaf, r) in enumerate(groups[g]):
            path = way(leaves, j) + way(subs, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            at = sha(*map(field, (*r[:4], text)))
            for left, right in path:
                at = sha(left, at, right)
            root = up(subs)
            out.append((r[0], leaf, subs[k], root, sha(*[a + b for a, b in path]), at, at == root))
    return sorted(out, key=str)


def made(spark, rows):
    docs = crowded(spark.createDataFrame(rows, TABLE))
    m = manifest.manifest(docs, manifest.lower_cased())
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return sorted(((*[r[c] for c in cols], r["folded_root"] == r["root"]) for r in manifest.proofs(m).collect()), key=str)


def test_manifest_of_odd_rows(spark):
    rows = [(k, f"s{k % 3}", "en", k, f"Text {k} É") for k in range(75)]
    rows += [(None, None, None, None, None), (None, "s", "en", 3, ""), (5, "s1", "en", 5, "Other"), (7, None, "", 0, None)]
    rows += [(9, "s", "é", 1, "Same"), (9, "s", "é", 1, "Same"), (3, "s", "z", 2, "Long " * 30_000)]
    assert made(spark, rows) == brute_manifest(rows)
    for few in ([], rows[:1], [(None,) * 5], rows[:8], rows[:9]):
        assert made(spark, few) == brute_manifest(few)


def test_manifest_over_several_layers_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "HEIGHT", 1)
    rows = [(k, "s", "en" if k % 5 else f"l{k % 35}", k, f"T{k}") for k in range(700)]
    assert made(spark, rows) == brute_manifest(rows)


@pytest.mark.parametrize("levels", range(1, 6))
def test_every_node_of_a_block_has_its_own_place(levels):
    places = np.concatenate([manifest.addresses(levels, d, np.arange(8**d)) for d in range(levels)])
    assert sorted(places) == list(range(manifest.size(levels)))
    if levels == 5:  # the upper half first, then the lower subtrees, each in one piece
        assert set(places[:9]) == set(range(9))
        below = manifest.addresses(5, 4, np.arange(8**2))
        assert below.min() >= 9 and below.max() < 9 + manifest.size(3)


def test_an_altered_sibling_breaks_a_proof():
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([k])).digest() for k in range(70)), np.uint8).reshape(-1, 32)
    block = manifest.build(digests, 3)
    root = block[0].tobytes().hex()
    for k, path in enumerate(manifest.siblings(block, 3, 70)):
        leaf = digests[k].tobytes().hex()
        assert manifest.climb(leaf, path) == root
        left, right = path[1]
        assert manifest.climb(leaf, [path[0], (right, left), path[2]]) != root or left == right


# ---- repeated strings


def brute_repeats(bodies, length):
    held = Counter(b[p : p + length] for b in bodies for p in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if held[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def repeats(spark, texts, length, parts=3):
    docs = crowded(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    rows = substrings.drop_repeats(docs.repartition(parts), length).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows]


@pytest.mark.parametrize("seed, length", [(1, 50), (2, 32), (3, 100)])
def test_repeated_strings_of_patched_texts(spark, seed, length):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(1, 400))) for _ in range(6)]
    texts = [None, "", "x" * rnd.randint(0, 300), "ab" * rnd.randint(0, 200), "é" * rnd.randint(0, 100)]
    for _ in range(25):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            b = rnd.choice(base)
            x = rnd.randint(0, len(b))
            y = rnd.randint(x, len(b))
            noise = "".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 80)))
            parts.append(rnd.choice([b, b[x:y], b[:y], noise]))
        texts.append("".join(parts))
    texts += rnd.choices(texts, k=4)
    assert repeats(spark, texts, length) == brute_repeats([(t or "").encode() for t in texts], length)


def test_texts_without_repeats(spark):
    long = "".join(chr(97 + k * k % 23) + str(k) for k in range(2000))
    assert repeats(spark, [None, "", "short", "short"], 400) == [(0, 0, 0, b""), (0, 0, 0, b""), *[(5, 0, 0, b"short")] * 2]
    assert repeats(spark, [long], 400) == [(len(long), 0, 0, long.encode())]
    assert substrings.drop_repeats(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    with pytest.raises(ValueError):
        substrings.drop_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 31)


def test_many_copies_of_one_passage(spark):
    """One passage in every text, one run of a sign, and exact copies: hot names."""
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdefghij ") for _ in range(600))
    texts = [f"{k} {passage} {rnd.random()}" for k in range(150)] + ["-" * 3000] + [passage * 3] * 40
    assert repeats(spark, texts, 400, parts=7) == brute_repeats([t.encode() for t in texts], 400)


def test_names_are_judged_by_reading_their_rows_once(spark):
    """A third of all rows under one name, a third in pairs, a third alone, in many batches."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    name = F.expr("CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN -1 - id DIV 6 ELSE id END")
    rows = spark.range(0, 6000, 1, 4).select(F.col("id").alias("row"), name.alias("n1"), F.lit(1).cast("long").alias("n2"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = substrings.recurring(rows.mapInArrow(read, rows.schema), "names", substrings.Scratch(spark)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r.row for r in got) == [k for k in range(6000) if k % 3 < 2]
    assert Counter((r.n1, r.n2) for r in got if r["head"]) == Counter({(r.n1, r.n2) for r in got})
    assert seen.value == 6000


def test_query_on_the_given_table(spark):
    table = ds.dataset(f"{DATA}/sf0.01/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    bodies = [(t or "").encode() for t in table["text"]]
    want = {}
    for k, (n, gone, runs, kept) in zip(table["doc_id"], brute_repeats(bodies, 400)):
        want[k] = (n, gone, runs, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op12_suffix_dedup"](spark, f"{DATA}/sf0.01").collect()}
    assert got == want


# ---- whitening


def brute_whitening(vectors, top=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:top], v[:, ::-1][:, :top]
    return ((n * x - s) ** 2).sum(1), centred @ v / np.sqrt(e), e / np.trace(cov)


def test_whitening_query_on_the_given_table(spark):
    rows = QUERIES["op13_embedding_whitening"](spark, f"{DATA}/sf0.001").toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").toPandas().sort_values("vec_id")
    deviation, whitened, explained = brute_whitening([list(v) for v in table.embedding])
    n = len(table)
    assert len(rows) == 32 * n and (rows.n == n).all() and rows.identity_error.max() <= 1e-9
    assert (rows.deviation.to_numpy().reshape(n, 32) == deviation[:, None]).all()
    assert np.allclose(rows.explained.to_numpy().reshape(n, 32), explained, rtol=1e-9)
    got = rows.whitened.to_numpy().reshape(n, 32)
    signs = np.sign((got * whitened).sum(0))
    assert np.allclose(got * signs, whitened, atol=1e-6)


def test_whitening_over_several_blocks(spark, monkeypatch):
    """More rows than a block holds, more entries than a block has columns, rows dealt over splits."""
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "BLOCK_COLS", 4)
    monkeypatch.setattr(whitening, "BLOCKS_A_SPLIT", 2)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(60, 10)) * np.arange(1, 11)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows = sorted(whitening.whiten(crowded(df), components=6).collect(), key=lambda r: r.vec_id)
    deviation, whitened, explained = brute_whitening(vectors, 6)
    assert [r.deviation for r in rows] == deviation.tolist()
    got = np.array([r.whitened for r in rows])
    assert np.allclose(got * np.sign((got * whitened).sum(0)), whitened, atol=1e-9)
    assert np.allclose(rows[0].explained, explained) and rows[0].identity_error < 1e-9


def test_whitening_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    odd = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [1.0]), (7, [1e300, 0.0])]
    good = [(8, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [3.0, -1.0]), (9, [0.0, 5.5])]
    rows = whitening.whiten(spark.createDataFrame(odd + good, schema)).collect()
    assert sorted(str(r.vec_id) for r in rows) == ["8", "8", "9", "None"] and {r.n for r in rows} == {4}
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame(odd[:5], schema)).collect() == []
    alone = whitening.whiten(spark.createDataFrame(good[:2], schema)).collect()  # no variance at all
    assert [(r.deviation, r.whitened, r.explained) for r in alone] == [(0, [None, None], [0.0, 0.0])] * 2
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], schema)).collect()
    assert all(r.whitened[1] is None and r.whitened[0] is not None and r.identity_error < 1e-9 for r in flat)
