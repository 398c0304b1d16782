"""Operators on training text against brute force, round trips and their own libraries."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from oracle import DATA, compare
from pyspark.sql import functions as F

from millrace.llm import bpe_counts, decontaminate, licenses, line_dedup, pieces, simhash
from millrace.llm.common import stored
from millrace.llm.components import components
from millrace.llm.queries import QUERIES, SQL

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"
UPPER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def crowded(df):
    """Extra columns with the names that the operators use inside."""
    names = "row lines gone tid pos h1 h2 n owner batch w word items point fp host low label shard n_tokens copies".split()
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, "sf0.001", QUERIES[name], SQL[name]) is None


# ---- line dedup

LONG = "this line is long enough to count"


def brute_lines(rows, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    held: dict[str, set] = {}
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(i if i is not None else f"row {n}")
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [
            i is not None and len(held.get(key(x), ())) >= min_docs and i != max(d for d in held[key(x)] if not isinstance(d, str))
            for x in lines
        ]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


LINES = [
    (1, f"{LONG}\nshort\n  {LONG.upper()}  \nonly here and nowhere else"),
    (2, f"{LONG}\n\n"),
    (3, f"\x0b{LONG}\t\r\nshort"),
    (4, ""),
    (5, None),
    (6, "short\nÉcole à l'été, ligne assez longue\n" * 3),
    (7, "école à l'été, ligne assez longue\nÉcole à l'été, ligne assez longue"),
    (8, "École à l'été, ligne assez longue\nexactly twenty chars"),
    (9, "exactly twenty chars"),
    (9, "exactly twenty chars"),
    (10, "exactly twenty char"),
    (None, f"{LONG}\nexactly twenty chars"),
    (12, "\n".join(["x" * 30 + str(i) for i in range(3000)])),
]


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_match_brute_force(spark, batches):
    rows = line_dedup.dedup_lines(crowded(frame(spark, LINES)), batches=batches)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in rows.collect()]
    assert sorted(got, key=str) == brute_lines(LINES)
    assert "owner" in rows.columns


def test_lines_of_empty_table(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for i in range(5, 0, -1):
        runs.add(line_dedup.line_hashes(frame(spark, [(i, LONG)])))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    owner = runs.repeated().collect()
    assert len(owner) == 1 and owner[0].owner == 5


# ---- benchmark decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_hits(docs, items, size=10):
    out = []
    for i, t in docs:
        w, hit, ids = words_of(t), set(), set()
        for item, text in items:
            v = words_of(text)
            n = min(len(v), size)
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        if item is not None:
                            ids.add(str(item))
        out.append((i, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (10, "one two three four five six seven eight nine ten eleven twelve"),
    (9, "One two THREE four five six seven eight nine ten, plus more"),
    (3, "tiny item"), (4, ""), (5, None), (6, "a a a a a a a a a a a a"), (3, "tiny item"), (None, "nameless words"),
    (7, "été École naïve"),
]
BENCH_DOCS = [
    (1, "start one two three four five six seven eight nine ten eleven end"),
    (2, "one two three four five six seven eight nine"),
    (3, "TINY, item; tiny-item tiny"), (4, ""), (5, None), (6, "a " * 25), (7, "nameless words 'été École naïve' été école naïve"),
    (8, "clean text"), (8, "tiny item"), (9, "tiny item"), (9, "tiny item"), (None, "tiny item"),
    (11, "x " * 5000 + "tiny item " + "y " * 5000),
]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_contamination_matches_brute_force(spark, limit):
    docs = crowded(frame(spark, BENCH_DOCS))
    rows = decontaminate.contamination(docs, frame(spark, ITEMS, "item_id long, text string"), broadcast_bytes=limit)
    got = [(r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in rows.collect()]
    assert sorted(got, key=str) == brute_hits(BENCH_DOCS, ITEMS)


def test_contamination_of_empty_tables(spark):
    none, docs = frame(spark, [], "item_id long, text string"), frame(spark, BENCH_DOCS)
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.contamination(docs, none).count() == len(BENCH_DOCS)
    assert decontaminate.contamination(docs.limit(0), frame(spark, ITEMS, "item_id long, text string")).count() == 0


def test_decontaminate_keeps_clean_documents(spark):
    kept = decontaminate.decontaminate(frame(spark, BENCH_DOCS), frame(spark, ITEMS, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {2, 4, 5, None}  # a null doc_id names no document


# ---- SimHash


def plain_simhash(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    sets = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            sets[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * sets[b] > len(grams))


@pytest.mark.parametrize("text", [None, "", " \t", "one", "One two", "a b c", "É é É é x\x0by", "w " * 70_000, "a b c d " * 9])
def test_simhash_of_texts(text):
    assert simhash.simhash(text) % 2**64 == plain_simhash(text)


def brute_roots(values, linked):
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if linked(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


@pytest.mark.parametrize("dense", [1, 4, 32])
def test_fingerprint_links_match_brute_force(spark, dense):
    rng = np.random.default_rng(5)
    values = {0, -1, -(2**63), 2**63 - 1}
    for _ in range(12):
        base = int(rng.integers(-(2**63), 2**63 - 1))
        values.add(base)
        for _ in range(12):
            x = base % 2**64
            for bit in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(bit)
            values.add(x - 2**64 if x >= 2**63 else x)
    pairs = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), dense=dense)
    close = lambda a, b: ((a % 2**64) ^ (b % 2**64)).bit_count() <= 2
    assert all(close(r.a, r.b) for r in pairs.collect())
    got = {r.node: r.root for r in components(pairs).collect()}
    want = brute_roots(sorted(values), close)
    assert {v: got.get(v, v) for v in values} == want


def test_near_duplicates(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (3, text), (9, text.upper()), (7, "other words entirely here"), (8, None), (2, ""), (None, text), (4, "other")]
    got = simhash.near_duplicates(crowded(frame(spark, rows))).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (9, 3), (None, 3), (7, 7), (8, 2), (2, 2), (4, 4)}
    kept = simhash.drop_near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id for r in kept} == {3, 7, 2, 4, None}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.unionAll(spark.createDataFrame([(1000, 1001), (1001, 1000), (2000, 2000)], "a long, b long"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


# ---- token counts and SentencePiece

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "   hello  world ", "▁▁a", "a▁b", "\n", "\t\t x", "日本語のテキスト", "😀 abc😀",
    "a" * 3000, "th" * 2000, "ab" * 999 + "c", "\x00x", "é" * 50, "<s> </s> <unk> <0x41>", "I'm don't she'll", "aaab" * 300,
    "<|endoftext|>x", "a <|startoftext|> b<|endoftext|>", "<|endoftext|", "ΑΣ ΣΑΣ", "İstanbul", "x\x1cy", "x\u0085y", "½ ² ⅷ 12 34",
    "ththththe thethethe", "=-" * 400, "word " * 30_000,
]


def test_token_counts_match_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    own = tokenizers.Tokenizer.from_file(path)
    docs = crowded(frame(spark, list(enumerate(TEXTS))))
    got = {r.doc_id: r.n_tokens for r in bpe_counts.token_counts(docs, path).collect()}
    assert got == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert bpe_counts.token_counts(frame(spark, []), path).count() == 0


def test_pieces_match_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = crowded(frame(spark, list(enumerate(TEXTS))))
    rows = pieces.round_trip(docs, path).collect()
    for r in rows:
        ids = own.encode(TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, repr(TEXTS[r.doc_id])[:80]
        assert (r.n_tokens, r.decoded) == (len(ids), own.decode(ids))
    assert len(rows) == len(TEXTS)
    back = pieces.decode(pieces.encode(docs, path), path, into="text")
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.decoded for r in rows}
    assert pieces.round_trip(frame(spark, []), path).count() == 0


def test_random_words_match_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, mine = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdeth in▁ \n.,-=<>0189éß日"))
    texts = ["".join(rng.choice(letters[: rng.integers(2, len(letters))], rng.integers(1, 200))) for _ in range(800)]
    for text, ids in zip(texts, mine.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(text, add_bos=True, add_eos=True), repr(text)


# ---- licenses


def brute_phrases(text):
    w, out = words_of(text), []
    for label, phrase in licenses.PHRASES:
        p = words_of(phrase)
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(i for i, _ in out), sorted({x for _, x in out})


LICENSED = [
    (1, "Licensed under the Apache License, Version 2.0."), (2, "Under the MIT license; under the mit-license. CC BY NC"), (3, None),
    (4, ""), (5, "apache license version 3"), (6, "cc by by nc cc by nc"), (7, "under the mit license"), (7, "under the mit license"),
    (7, "nothing"), (None, "cc by nc"), (8, "x " * 20_000 + "cc by nc " * 3),
]


def test_license_phrases_match_brute_force(spark):
    got = licenses.scan(crowded(frame(spark, LICENSED))).collect()
    assert sorted([(r.doc_id, r.n_words, r.starts, r.base_labels) for r in got], key=str) == sorted(
        [(i, *brute_phrases(t)) for i, t in LICENSED], key=str
    )
    assert all((r.score == 1) == bool(r.base_labels) for r in got)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_templates_with_changes(spark):
    label, text = licenses.TEMPLATES[0]
    w = text.split()
    rows = [(1, text), (2, " ".join([*w[:20], "some", "new", *w[20:]])), (3, " ".join(w[: len(w) // 2])), (4, "Redistribution alone")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == [["mit"], ["mit"], [], []]
    assert got[1].spans[0].first == 0 and got[1].spans[0].last == got[1].n_words - 1
    assert got[1].score == 1 and 0.8 <= got[2].score < 1 and 0.3 < got[3].score < 0.6 and got[4].score < 0.1


def test_stored_tables_keep_columns(spark):
    kept = stored(frame(spark, [(1, "a"), (2, None)]).withColumn("batch", F.lit(1)), "kept", by="batch")
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 1), (2, None, 1)]


def test_digests_of_queries(spark):
    rows = QUERIES["op10_sentencepiece"](spark, f"{DATA}/sf0.001").collect()
    sentencepiece = pytest.importorskip("sentencepiece")
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    for r in rows:
        ids = own.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        want = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *want)
    assert len(rows) == len(texts)
