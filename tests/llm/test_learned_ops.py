"""Classifiers on held-out rows; vectors, pages and the pipeline against brute force."""

from __future__ import annotations

import os
import subprocess
import sys

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from millrace.llm import pages, quality, toxicity, vector_dups
from millrace.llm.queries import QUERIES

SF = f"{DATA}/sf0.01"
DOCS = "doc_id long, text string"


# ---- classifiers


def scored(spark, name, label):
    rows = QUERIES[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    return rows.join(labels, "doc_id", "left").toPandas()


def test_quality_on_held_out_rows(spark):
    got = scored(spark, "op2_quality", "quality")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got[got.held_out & got.quality.notna()]
    assert len(held) > 50 and (held.predicted == held.quality).mean() >= 0.95


def test_toxicity_on_held_out_rows(spark):
    got = scored(spark, "op8_toxicity", "toxic")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got[got.held_out & got.toxic.notna()]
    assert (held.predicted == held.toxic).mean() >= 0.93
    assert held[held.toxic == 0].predicted.mean() <= 0.02


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_without_rows(spark, module, label):
    schema = f"doc_id long, {label} int"
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 50_000), (3, "same"), (3, "same")], DOCS).withColumn("score", F.lit("x"))
    for labels in ([], [(1, 1)], [(None, 1), (2, None), (7, 3)], [(1, 1), (2, 0), (3, 1), (3, 0)]):
        model = module.learn(docs, spark.createDataFrame(labels, schema))
        rows = module.score(docs, model).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert module.score(docs.limit(0), module.learn(docs.limit(0), spark.createDataFrame([(1, 1)], schema))).count() == 0


def test_folding_of_disguised_words():
    assert toxicity.fold("1d10t") == " idiot "
    assert toxicity.fold("$tupid, іdіоt! 2024 l0ser") == " stupid idiot 2024 loser "
    assert toxicity.fold(None) == toxicity.fold(" \n") == " "


def test_lexicon_words_stems_and_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " idio": 2.0})
    found = lexicon.automaton()
    hits = lambda t: lexicon.features(found, toxicity.fold(t))[0]
    assert hits("such trash") == 3 and hits("the idiots") == 2 and hits("trashy radios") == 0
    assert hits("take the trash can out") == 0 and hits("trash can of trash") == 3
    assert lexicon.features(found, toxicity.fold("trash"))[2] > lexicon.features(found, toxicity.fold("trash " + "a " * 500))[2]


def test_learned_words_are_found_again(spark):
    """Insults that no list holds, some disguised, and copies that share rare words."""
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}o" for i in range(400)]
    rows = []
    for i in range(600):
        text = [str(w) for w in rng.choice(words, 60)]
        if i % 6 == 0:
            text[int(rng.integers(60))] = ["zorkling", "zorkle", "blimfar"][i // 6 % 3]
        if i % 30 == 0:
            text += "copy only words stand here".split()
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    fresh = [(1, "wabo zorkly wado"), (2, "wabo wado waco"), (3, "wabo bl1mfar wado"), (4, "copy only words stand here")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(fresh, DOCS), lexicon).collect()}
    assert got[1] > 0.5 and got[3] > 0.5 and got[2] < 0.5


def test_quality_vectors_do_not_depend_on_slices():
    vectors = quality.TextVectors({"plain": quality.index_vector("plain")})
    text = "Plain plain !!! A A A 12 " * 40
    assert np.allclose(vectors.of(text, 7), vectors.of(text, 10**6), atol=1e-5)
    assert not vectors.of(None).any()


# ---- vectors


def brute_links(rows, threshold=0.93):
    def sound(v, label):
        return v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, root = [0] * len(rows), [r[0] for r in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if sound(v, label) else None for _, v, label in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][2] == rows[j][2] and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
            if same and unit[i] @ unit[j] >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                pairs.append((i, j))
    for _ in rows:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return sorted((r[0], a, b) for r, a, b in zip(rows, n, root))


def test_vector_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for centre in range(12):
        base = rng.normal(size=16)
        for _ in range(14):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.5])).tolist(), centre % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(5)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [1.0] * 15 + [None], 1), (503, rows[1][1], None)]
    rows += [(504, [float("nan")] * 16, 0), (505, [float("inf")] * 16, 0), (506, [], 0), (507, [1.0, 0.0], 0), (508, [2.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for shard_rows, query_rows in ((8192, 2048), (20, 16)):
        got = vector_dups.link_vectors(vectors.withColumn("shard", F.lit("x")), shard_rows=shard_rows, query_rows=query_rows)
        assert sorted(map(tuple, got.collect())) == brute_links([(i, None if v is None else [None if x is None else np.float32(x).item() for x in v], c) for i, v, c in rows])
    assert vector_dups.link_vectors(vectors.limit(0)).count() == 0


def test_graph_recall_and_dense_groups():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(300, 32))
    x = np.vstack([np.repeat(centres, 5, axis=0) + rng.normal(size=(1500, 32)) * 0.15, centres[:1] + rng.normal(size=(600, 32)) * 0.02])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    graph = vector_dups.Graph(x)
    beam = vector_dups._audited_beam(graph, x[:48], 0.93)
    true = x @ x.T >= 0.93
    found = graph.within(x, 0.93, beam)
    assert all(true[i, hits].all() for i, hits in enumerate(found))
    assert sum(map(len, found)) >= 0.98 * true.sum()


def test_vector_links_of_many_shards(spark):
    """Few links a shard: the label has too few for an audit or passes a pooled one."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 16))
    rows = [(i, (centres[i // 2] + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(400)]
    got = vector_dups.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard_rows=40)
    assert sorted(map(tuple, got.collect())) == brute_links(rows)


def test_failed_audits_end_in_a_scan(monkeypatch):
    x = np.random.default_rng(6).normal(size=(300, 16))
    x = vector_dups._unit(np.vstack([x, x + 0.01]))
    graph = vector_dups.Graph(x)
    lost = lambda self, q, beam, *_: (np.zeros((len(q), beam), int), np.full((len(q), beam), -2.0))
    monkeypatch.setattr(vector_dups.Graph, "search", lost)
    beam = vector_dups._audited_beam(graph, x[:60], 0.93)
    assert sum(map(len, graph.within(x, 0.93, beam))) == (x @ x.T >= 0.93).sum()
    # Links of a row to itself are none; a planted copy of each row is one more.
    assert vector_dups._audit(graph, x[:60], 0.93, np.arange(60))[0] == (x[:60] @ x.T >= 0.93).sum() - 60 + 60
    assert vector_dups._least_beam([10, 10, 10, 10, 10]) == 32 and vector_dups._least_beam([100, 90, 98, 99, 100]) == 64
    assert vector_dups._least_beam([100, 90, 90, 91, 92]) == 0


def test_few_links_still_use_the_graph():
    """Ten thousand vectors, a hundred close pairs: the planted links decide, not a scan."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(8000, 64))
    x[100:200] = x[:100] + rng.normal(size=(100, 64)) * 0.2
    x = vector_dups._normed(x)
    order = rng.permutation(len(x))
    x = x[order]
    graph = vector_dups.Graph(x)
    sample = rng.choice(len(x), 256, replace=False)
    beam = vector_dups._audited_beam(graph, x[sample], 0.93, sample)
    assert beam > 0
    close = np.flatnonzero(order < 200)
    found = graph.within(x[close], 0.93, beam)
    true = x[close] @ x.T >= 0.93
    assert true.sum() > 300 and sum(map(len, found)) >= 0.98 * true.sum()


def test_planted_links_lie_at_the_threshold():
    x = vector_dups._normed(np.random.default_rng(2).normal(size=(50, 8)))
    cos = (vector_dups._planted(x, 0.93) * x).sum(axis=1)
    assert ((cos >= 0.93) & (cos < 0.932)).all()


def test_vectors_of_odd_sizes_and_shared_ids(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=4096)
    rows = [(10, base.tolist(), 0), (11, (base + rng.normal(size=4096) * 0.05).tolist(), 0), (12, rng.normal(size=4096).tolist(), 0)]
    rows += [(20, [1e200, 2e200], 1), (21, [1.0, 2.0], 1), (22, [1e-200, 5e-200], 3), (23, [5e-200, 1e-200], 3)]
    # One id for three vectors: counts 1, 1 and 2.
    rows += [(1, [1.0, 0.0, 0.0], 2), (2, [1.0, 0.01, 0.0], 2), (1, [0.0, 1.0, 0.0], 2), (3, [0.0, 1.0, 0.01], 2)]
    rows += [(1, [0.0, 0.0, 1.0], 2), (4, [0.0, 0.01, 1.0], 2), (5, [0.01, 0.0, 1.0], 2)]
    got = vector_dups.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want = [(10, 1, 10), (11, 1, 10), (12, 0, 12), (20, 1, 20), (21, 1, 20), (22, 0, 22), (23, 0, 23)]
    want += [(1, 1, 1), (2, 1, 1), (1, 1, 1), (3, 1, 1), (1, 2, 1), (4, 2, 1), (5, 2, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_way_link_counts_at_both_ends():
    """Searches from one side only: both ends still count what is found."""
    import pandas as pd

    x = np.eye(8)
    half = [pd.DataFrame({"label": 0, "d": 8, "shard": s, "shards": 2, "rep": range(s * 8, s * 8 + 8), "copies": 1, "h": range(8), "embedding": list(x)}) for s in (0, 1)]
    shards = pd.concat([vector_dups._build(p) for p in half], ignore_index=True)
    shards["beam"] = 32
    within = vector_dups.Graph.within
    calls = []

    def one_way(self, q, threshold, beam):
        calls.append(1)
        return within(self, q, threshold, beam) if len(calls) == 1 else [np.array([], int)] * len(q)

    vector_dups.Graph.within, keep = one_way, within
    try:
        got = vector_dups._pair(0.93, 256)((0, 8, 0, 1), shards)
    finally:
        vector_dups.Graph.within = keep
    assert len(calls) == 2 and dict(zip(got.id, got.n)) == {i: 1 for i in range(16)}


# ---- pages


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    (page("<article><h1>A &amp; B</h1><p>one\n  two<p>three <b>bold<br>next</article><footer>f</footer>"), "A & B\none two\nthree bold\nnext"),
    (page("<nav><ul><li>m</ul></nav><main><p>x</p><aside>side</aside><form>f</form></main>"), "x"),
    (page('<div class="ad">buy</div><div class="post"><p>kept</div><div id="comments"><p>c</div>'), "kept"),
    (page('<header>h</header><article><header><h1>t</h1></header><p>p<div class="cookie-notice">n</div></article>'), "t\np"),
    (page('<script>var a="<p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><p>yes &lt;b&gt; &#233;</p>'), "yes <b> é"),
    (page("<article><p>a<script>unclosed"), "a"),
    (page("<article><p>a < b and c > d</p></article>"), "a < b and c > d"),
    (page("<article>" + "<p>w</p>" * 3000 + "</article>"), "\n".join("w" for _ in range(3000))),
    (page('<body class="has-sidebar no-comments"><article class="comment"><p>r</p></article><p>t</p>'), "t"),
    (page('<div class="page_SideBar">s</div><p>a<svg class="i"/>b</p><div class="alert">x</div>'), "ab"),
    (page("<table><tr><td>a<td>b<tr><td>c</table>"), "a\nb\nc"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_page_text(html, text):
    assert pages.main_text(html, set()) == text


def test_style_tree_removes_what_a_host_repeats(spark):
    rows = [
        (i, f"http://same.example/{i}", page(f"<div class='top'><p>Welcome to us</p></div><div class='body'><p>text {i} a</p><p>text {i} b</p></div>"))
        for i in range(20)
    ]
    rows += [(100, "http://small.example/1", page("<div class='top'><p>Welcome to us</p></div>")), (101, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"low": F.lit(1), "row": F.lit(2), "text": F.lit("x")})
    got = pages.extract(frame)
    assert set(got.columns) == set(frame.columns)
    texts = {r.page_id: r.text for r in got.collect()}
    assert texts == {**{i: f"text {i} a\ntext {i} b" for i in range(20)}, 100: "Welcome to us", 101: ""}
    assert pages.extract(frame.limit(0)).count() == 0
    tree = {r.path: r.importance for r in pages.style_tree(frame).where("host = 'same.example'").collect()}
    assert tree["html>body>div.top"] < 0.1 < 0.8 < tree["html>body>div.body"]


def test_style_tree_weighs_articles_and_names(spark):
    """In-article boilerplate goes, bodies beside teaser articles and in named branches stay."""
    long = "words of the body that no other page has, in a sentence of some length"
    teaser = "<article><h2>Also read this</h2></article><article><h2>And this</h2></article>"
    shapes = {
        "boiler": "<article><p>{i} a " + long + "</p><div class='box'><p>Follow our channel</p></div><p>{i} b</p></article>",
        "teaser": teaser + "<div class='c'><p>{i} a " + long + "</p><p>{i} b</p></div>",
        "named": "<p>Top line</p><div class='share-story'><p>{i} a " + long + "</p><p>{i} b</p></div>",
        "ads": "<div class='ad'>{i} buy</div><div class='c'><p>{i} a " + long + "</p><p>{i} b</p></div>",
        "beside": "<article><p>{i} a " + long + "</p><p>{i} b</p></article><div class='c'>{i} other</div>",
        "copies": "<article><p>0 a " + long + "</p><p>0 b</p></article>",
    }
    rows = [(k, i, f"http://{k}.example/{i}", page(html.replace("{i}", str(i)))) for k, html in shapes.items() for i in range(12)]
    rows += [("lone-teaser", 0, "http://lone.example/t", page(teaser + f"<div><p>0 a {long}</p><p>0 b</p></div>"))]
    rows += [("cells", 0, "http://cells.example/1", page("<article>" + "<p>w</p>" * 20 + "</article>"))]
    frame = spark.createDataFrame(rows, "kind string, i int, url string, html string")
    for r in pages.extract(frame).collect():
        body = f"{0 if r.kind == 'copies' else r.i} a {long}\n{0 if r.kind == 'copies' else r.i} b"
        want = {"lone-teaser": f"Also read this\nAnd this\n{body}", "cells": "\n".join("w" * 20)}.get(r.kind, body)
        assert r.text == want, r.kind


def test_pages_query_on_given_pages(spark):
    import html
    import re

    texts = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op9_html_extraction"](spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", texts[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", article)]
        want = "\n".join(x for x in parts if x)
        assert (r.text, r.n_chars) == (want, len(want))


# ---- pipeline and entry points


def test_pipeline_matches_plain_python(spark, tmp_path):
    import corpus_pipeline
    from test_text_ops import brute_hits, brute_lines, brute_roots, plain_simhash

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.not_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    rows = {i: t for i, _, _, t in brute_lines(list(rows.items()))}
    prints = {i: plain_simhash(t) for i, t in rows.items()}
    roots = brute_roots(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    first: dict[int, int] = {}
    for i in sorted(rows):
        first.setdefault(roots[prints[i]], i)
    rows = {i: rows[i] for i in first.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {i: rows[i] for i, _, _, _, dirty in brute_hits(list(rows.items()), items) if not dirty}
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id: r.text for r in got.collect()} == rows
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


ITEMS = [("b1", "one two three four five six seven eight nine ten")]


def test_stages_judge_each_row_by_its_own_text(spark):
    """Null ids, one id for two texts, equal rows: neither a clean row goes nor a dirty one stays."""
    from millrace.llm import decontaminate, simhash

    dirty, clean = "zero " + ITEMS[0][1], "nothing of the kind stands here at all"
    rows = [(None, dirty), (None, clean), (1, dirty), (1, clean), (2, clean), (2, clean), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_fp", F.lit("x"))
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.drop("_fp").collect())) == sorted(map(str, spark.createDataFrame([r for r in rows if r[1] != dirty], DOCS).collect()))

    own, other = "a text of its own with many words in it", "quite another story that shares no shingle"
    rows = [(None, own), (None, own), (2, own), (2, other), (5, other), (6, None), (None, ""), (7, "alone " * 9), (7, "alone " * 9)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("2", own), ("2", other), ("6", None), ("7", "alone " * 9)]
    nameless = simhash.drop_near_duplicates(spark.createDataFrame([(None, own), (None, own), (None, other)], DOCS)).collect()
    assert sorted(r.text for r in nameless) == sorted([own, other])


def test_entry_without_the_subpackage(tmp_path):
    """A copy without these folders still imports and keeps the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import shutil

    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kmeans_step' in q and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    whole = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; assert 'pipeline' in e.queries()"], cwd=root, capture_output=True)
    assert whole.returncode == 0
