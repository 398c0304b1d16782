"""Toxicity from a weighted lexicon, matched by an Aho-Corasick automaton.

Text is folded first: lower case, look-alike letters of other alphabets and digits or
signs that stand for letters inside words become plain letters, and everything between
words one space. The lexicon holds whole words and beginnings of words; it and its weights
are learned from labelled rows, and a few common English insults are given. A word counts
with its heaviest match, unless it stands in an exception phrase. The sum, the sum over
the length and the heaviest match go through a logistic curve.

Learning is bounded: at most ``FIT_TOXIC`` and ``FIT_CLEAN`` labelled rows. Candidates are
counted on Spark by minimum hash of the document, so near copies count once; the driver
sees at most ``CANDIDATES`` of them and their places in the sample.

Defined cases. Null or empty text: no match, the score of a text without one. Labels other
than 0 and 1 are ignored; without any label of one class, the given words decide. Equal
rows score alike. No rows: no result rows; clashing extra columns are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.training import training_rows

FIT_TOXIC, FIT_CLEAN = 3000, 6000
CANDIDATES = 4000
#: Beginnings of words that may be lexicon entries, by their length.
STEMS = range(3, 9)
#: Entries sought for every toxic training row, and rows an entry must be found in.
DEPTH, LEAST = 3, 3

# Common insults, and harmless phrases that hold one.
GIVEN = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "imbecile"]
EXCEPTIONS = ["trash can", "trash bag", "trash bin", "the stupid question is the one not asked", "pond scum"]

# Letters that look like others, and signs used for letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁαβεικνορτυχ", "abekmhopctyxijsdabeikvoptux"))
DIGITS = dict(zip("01345789@$", "oleastbgas"))
DIGITS["1"] = "i"


def _space_table() -> dict[int, str]:
    marks = [c for c in range(128) if not chr(c).isalnum()] + [0xA0, 0xA1, 0xAB, 0xBB, 0xBF, *range(0x2000, 0x2070)]
    table = {c: " " for c in marks}
    table.update({c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)})
    table.update({ord(a): b for a, b in LOOKALIKES.items()})
    return table


_TABLE, _DIGITS = _space_table(), str.maketrans(DIGITS)
_SIGN = re.compile(r"[@$](?=[^\W\d_])")
_MIXED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*\d)\S+")
_DIGIT = re.compile(r"[0-9]")


def fold(text: str | None) -> str:
    """`` word word ``: folded words with one space around each."""
    s = (text or "").lower()
    if "$" in s or "@" in s:
        s = _SIGN.sub(lambda m: DIGITS[m[0]], s)
    s = " ".join(s.translate(_TABLE).split())
    if _DIGIT.search(s):
        s = _MIXED.sub(lambda m: m[0].translate(_DIGITS), s)
    return f" {s} " if s else " "


def terms(folded: str) -> set[str]:
    """Lexicon candidates of a text: `` word `` and `` begi``."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3 and not w.isdigit():
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in STEMS if k < len(w))
    return out


@dataclass
class Lexicon:
    """Weights by pattern, and the logistic curve over the three sums."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    curve: tuple[float, ...] = (-4.0, 1.5, 0.5, 0.2)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, w in self.weights.items():
            found.add_word(pattern, (pattern, w))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (f" {phrase} ", -1.0))
        found.make_automaton()
        return found

    def features(self, automaton, folded: str) -> tuple[float, float, float]:
        by_word: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (pattern, w) in automaton.iter(folded):
            start = end - len(pattern) + 1
            if w < 0:
                safe.append((start, end))
            elif by_word.get(start, 0.0) < w:
                by_word[start] = w
        at = 0
        for start in sorted(by_word) if safe else ():
            while at < len(safe) and safe[at][1] <= start:
                at += 1
            if any(a <= start < b for a, b in safe[at : at + len(self.exceptions)]):
                del by_word[start]
        if not by_word:
            return 0.0, 0.0, 0.0
        total = sum(by_word.values())
        return max(by_word.values()), math.log1p(total), math.log1p(100 * total / folded.count(" "))

    def score(self, features) -> float:
        z = self.curve[0] + sum(c * f for c, f in zip(self.curve[1:], features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _candidates(rows: DataFrame) -> DataFrame:
    """``doc_id, y, sig, terms`` of the training rows."""

    @F.pandas_udf("array<string>")
    def split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([sorted(terms(fold(t))) for t in texts])

    rows = rows.select("doc_id", "y", split("text").alias("terms"))
    # The least hash of the words: near copies mostly share it.
    hashes = F.transform(F.filter("terms", lambda t: F.endswith(t, F.lit(" "))), lambda t: F.xxhash64(t))
    return rows.withColumn("sig", F.coalesce(F.array_min(hashes), F.lit(0)))


def learn(docs: DataFrame, labels: DataFrame, n_toxic: int = FIT_TOXIC, n_clean: int = FIT_CLEAN) -> Lexicon:
    """Choose patterns by greedy cover of the toxic rows, then fit the curve."""
    from millrace.llm.common import stored

    rows, totals = training_rows(docs, labels, "toxic", {1: n_toxic, 0: n_clean})
    sums = rows.groupBy("y").agg(F.count("*").alias("n")).collect()
    n = {r["y"]: r["n"] for r in sums}
    weights = {f" {w}": 3.0 for w in GIVEN}
    if not n.get(0) or not n.get(1):
        return Lexicon(weights)
    pool = stored(_candidates(rows), "toxic-terms")
    flat = pool.select("doc_id", "y", "sig", F.explode("terms").alias("term"))
    toxic = F.col("y") == 1
    stats = flat.groupBy("term", "y").agg(F.count_distinct("sig").alias("n"), F.count("*").alias("rows"))
    stats = stats.groupBy("term").agg(
        F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(~toxic, F.col("n")).otherwise(0)).alias("neg")
    )
    weight = F.log((F.col("pos") + 0.5) / (n[1] + 1)) - F.log((F.col("neg") + 0.5) / (n[0] + 1))
    stats = stats.where((F.col("pos") >= LEAST) & (F.col("pos") > 10 * F.col("neg") * n[1] / n[0])).withColumn("w", weight)
    stats = stats.orderBy(F.desc(F.col("pos") * F.col("w")), "term").limit(CANDIDATES).persist()
    info = {r["term"]: (r["pos"], r["w"]) for r in stats.select("term", "pos", "w").collect()}
    places = flat.where(toxic).join(F.broadcast(stats.select("term")), "term").select("term", "doc_id", "sig")
    chosen = _cover(info, places.toPandas(), n[1] / (n[0] + n[1]))
    stats.unpersist()
    weights.update({t: round(float(info[t][1]), 6) for t in chosen})
    lexicon = Lexicon(weights)
    lexicon.curve = _fit_curve(rows, lexicon, totals, n)
    return lexicon


def _cover(info: dict, places: pd.DataFrame, share: float) -> list[str]:
    """Patterns by gain: weight times the toxic rows (near copies once) that hold fewer
    than ``DEPTH`` chosen patterns so far. Of patterns that begin alike, one is chosen."""
    docs_of = {t: g.drop_duplicates("sig") for t, g in places.groupby("term")}
    ids = {t: g["sig"].to_numpy() for t, g in docs_of.items()}
    held: dict[int, int] = {}
    chosen: list[str] = []
    sure = math.log(max(len(info), 2) * 100) / math.log(1 / share)
    open_terms = {t for t in info if t in ids}
    while open_terms:
        best, gain = None, ()
        for t in open_terms:
            fresh = sum(1 for s in ids[t] if held.get(s, 0) == 0)
            more = sum(1 for s in ids[t] if 0 < held.get(s, 0) < DEPTH)
            if fresh < LEAST and len(ids[t]) < sure:
                continue
            g = info[t][1] * (fresh + 0.3 * more)
            # Between equals the longer pattern is the more particular one.
            key = (round(g, 6), len(t), t)
            if fresh + more >= LEAST and (best is None or key > gain):
                best, gain = t, key
        if best is None:
            break
        chosen.append(best)
        for s in ids[best]:
            held[s] = held.get(s, 0) + 1
        bare = best.rstrip()
        open_terms = {t for t in open_terms if not t.startswith(bare) and not bare.startswith(t.rstrip())}
    return chosen


def _scored(lexicon: Lexicon):
    @F.pandas_udf("best double, total double, dense double")
    def features(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for texts in parts:
            yield pd.DataFrame([lexicon.features(automaton, fold(t)) for t in texts], columns=["best", "total", "dense"])

    return features


def _fit_curve(rows: DataFrame, lexicon: Lexicon, totals: dict, n: dict) -> tuple[float, ...]:
    """Logistic regression by Newton steps, rows weighted back to the classes' shares."""
    table = rows.select("doc_id", "y", _scored(lexicon)("text").alias("f")).select("doc_id", "y", "f.*").toPandas()
    table = table.sort_values(["doc_id", "y"])
    x = np.column_stack([np.ones(len(table)), table[["best", "total", "dense"]].to_numpy(float)])
    y = table["y"].to_numpy(float)
    w = np.where(y == 1, totals[1] / n[1], totals[0] / n[0])
    w /= w.mean()
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 0.3, 0.3, 0.3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 9) for v in b)


def score(docs: DataFrame, lexicon: Lexicon, column: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic."""

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in parts:
            yield pd.Series([lexicon.score(lexicon.features(automaton, fold(t))) for t in texts], dtype="float64")

    return docs.withColumn(into, probability(column))
