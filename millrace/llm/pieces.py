"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of all distinct words of a batch lie in one flat array. A round looks up the
rank of every adjacent pair, takes the least rank in each word, merges its occurrences
from the left, and compacts the array; words without a mergeable pair leave it. An
occurrence whose merge makes a pair of lower rank with a neighbour is the last of its
word in that round, so the order is that of merging one pair at a time.

Ids are kept as little-endian unsigned 32-bit integers in one binary value per document.

Defined cases. Null text: as empty, which has only the begin and end ids. Equal rows are
encoded alike; ties of rank go to the left. Extra columns stay, but for those named like
an added one, which it replaces. No rows: no result rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Words remembered by a Python worker, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
CHUNK = 128


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        raw = {i for i in range(n) if sp.is_byte(i)}
        self.unknown, self.bos, self.eos = sp.unk_id(), sp.bos_id(), sp.eos_id()
        self.byte_id = np.zeros(256, np.int64)
        for i in raw:
            self.byte_id[int(text[i][3:-1], 16)] = i
        self.fallback = bool(raw)
        #: Symbols: pieces by their id, then single characters that are no piece.
        self.symbol = {text[i]: i for i in range(n) if i not in special and i not in raw}
        self.n_pieces = n
        for piece in [p for p in self.symbol if len(p) > 1]:
            for c in piece:
                self.symbol.setdefault(c, len(self.symbol) + n)
        self.char = -1 - np.arange(0x110000, dtype=np.int64)
        for piece, i in self.symbol.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.lone = {i: p for p, i in self.symbol.items() if i >= n}
        self._pairs(sp)
        self._decoding(text, special, raw)
        inner = {c for p in self.symbol if len(p) > 1 for c in p}
        spaced = any(SPACE in p.lstrip(SPACE) for p in self.symbol)
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        self.words = (
            re.compile(".+", re.S)
            if spaced
            else re.compile(f"[{alone}]|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        )
        self.cache: dict[str, bytes] = {}

    def _pairs(self, sp) -> None:
        keys, ranks, made = [], [], []
        pieces = {p: i for p, i in self.symbol.items() if i < self.n_pieces}
        scores = {i: sp.get_score(i) for i in pieces.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.base = len(self.symbol) + self.n_pieces + 1
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                a, b = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    ranks.append(order[scores[i]])
                    made.append(i)
        at = np.argsort(keys)
        # A sentinel at the end, so that every search hits a row.
        self.keys = np.append(np.array(keys, np.int64)[at], NONE)
        self.ranks = np.append(np.array(ranks, np.int64)[at], NONE)
        self.made = np.append(np.array(made, np.int64)[at], -1)

    def _decoding(self, text: list[str], special: set[int], raw: set[int]) -> None:
        self.bytes = [b"" if i in special else t.replace(SPACE, " ").encode() for i, t in enumerate(text)]
        for i in raw:
            self.bytes[i] = bytes([int(text[i][3:-1], 16)])
        self.bytes[self.unknown] = " ⁇ ".encode()
        self.raw, self.leading = raw, {i for i, t in enumerate(text) if t.startswith(SPACE) and i not in special}

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return at

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words once no pair is left, and where each word ends among them;
        a character outside the vocabulary is ``-1 - code point``."""
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        sym, word = self.char[codes], np.repeat(np.arange(len(words)), lengths)
        none = len(self.keys) - 1
        at = np.append(self._find(sym[:-1], sym[1:]), none) if len(sym) else np.empty(0, np.int64)
        at[:-1][word[:-1] != word[1:]] = none
        done_word, done_sym = [], []
        while len(sym):
            rank = self.ranks[at]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            live = np.repeat(least != NONE, size)
            if not live.all():
                done_word.append(word[~live])
                done_sym.append(sym[~live])
                size, least = size[least != NONE], least[least != NONE]
                sym, word, rank, at = sym[live], word[live], rank[live], at[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            sym, word, at = self._round(sym, word, at, hit)
        word = np.concatenate(done_word) if done_word else word
        sym = np.concatenate(done_sym) if done_sym else sym
        return sym[np.argsort(word, kind="stable")], np.cumsum(np.bincount(word, minlength=len(words)))

    def _round(self, sym, word, at, hit):
        """Merge at the positions ``hit``: every second one of an overlapping run, and up
        to the first in a word that makes a pair of lower rank. Only pairs beside a merge
        are looked up anew."""
        if len(hit) > 1:
            new_run = np.append(True, (np.diff(hit) != 1) | (word[hit[1:]] != word[hit[:-1]]))
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
        made = self.made[at[hit]]
        same = np.append(False, word[hit[1:]] == word[hit[:-1]])
        if same.any():
            rank = self.ranks[at[hit]]
            joined = same & np.append(False, np.diff(hit) == 2)
            before = np.maximum(hit - 1, 0)
            left = np.where(joined, np.append(-1, made[:-1]), sym[before])
            left[(hit == 0) | (word[before] != word[hit])] = -1
            after = np.minimum(hit + 2, len(sym) - 1)
            right = np.where((hit + 2 < len(sym)) & (word[after] == word[hit]), sym[after], -1)
            lower = (self.ranks[self._find(left, made)] < rank) | (self.ranks[self._find(made, right)] < rank)
            # Positions after a lowering one in the same word wait for a later round.
            so_far = np.cumsum(lower) - lower
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(hit))))
            go = so_far == so_far[start]
            hit, made = hit[go], made[go]
        sym[hit] = made
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        moved = hit - np.arange(len(hit))  # one symbol went for every merge to the left
        sym, word, at = sym[keep], word[keep], at[keep]
        near = np.unique(np.concatenate([moved, np.maximum(moved - 1, 0)]))
        after = np.minimum(near + 1, len(sym) - 1)
        found = self._find(sym[near], sym[after])
        found[(near + 1 >= len(sym)) | (word[near] != word[after])] = len(self.keys) - 1
        at[near] = found
        return sym, word, at

    def _coded(self, words: list[str]) -> list[bytes]:
        """Ids of every word."""
        sym, ends = self.merge(words)
        plain = (sym >= 0) & (sym < self.n_pieces)
        raw = sym.astype("<u4").tobytes()
        stops = (4 * ends).tolist()
        out = [raw[a:b] for a, b in zip([0, *stops], stops)]
        if not plain.all():
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(~plain), side="right")).tolist():
                out[i] = self._with_fallback(sym[ends[i - 1] if i else 0 : ends[i]])
        return out

    def _with_fallback(self, sym: np.ndarray) -> bytes:
        out: list[int] = []
        for s in sym.tolist():
            if 0 <= s < self.n_pieces:
                out.append(s)
            elif self.fallback:
                char = self.lone[s] if s >= self.n_pieces else chr(-1 - s)
                out.extend(self.byte_id[b] for b in char.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text, with the begin and end ids."""
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list(set().union(*split).difference(self.cache))
        self.cache.update(zip(fresh, self._coded(fresh)))
        bos, eos = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        get = self.cache.__getitem__
        out = [b"".join([bos, *map(get, ws), eos]) for ws in split]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        else:
            for w in fresh:
                if len(w) > CACHE_CHARS:
                    del self.cache[w]
        return out

    def decode(self, ids: bytes) -> str:
        """Text of the ids: one space of the first piece goes, byte pieces are UTF-8."""
        listed = np.frombuffer(ids, "<u4").tolist()
        out = b"".join(map(self.bytes.__getitem__, listed))
        first = next((i for i in listed if self.bytes[i]), None)
        if first in self.leading and first not in self.raw:
            out = out[1:]
        return out.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def _added(docs: DataFrame, own: list[tuple[str, T.DataType]]) -> tuple[list[str], T.StructType]:
    names = [c for c in docs.columns if c not in dict(own)]
    fields = [docs.schema[c] for c in names] + [T.StructField(n, t) for n, t in own]
    return names, T.StructType(fields)


def encode(docs: DataFrame, model: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary) and ``n_tokens``, from the model file at ``model``."""
    return _mapped(docs, model, column, decoded=False)


def round_trip(docs: DataFrame, model: str, column: str = "text") -> DataFrame:
    """:func:`encode`, and ``decoded``: the text that the ids give back."""
    return _mapped(docs, model, column, decoded=True)


def _mapped(docs: DataFrame, path: str, column: str, decoded: bool) -> DataFrame:
    own = [("ids", T.BinaryType()), ("n_tokens", T.LongType())] + [("decoded", T.StringType())] * decoded
    names, schema = _added(docs, own)
    at = docs.columns.index(column)
    kept = [docs.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                ids = model.encode(part.column(at).to_pylist())
                columns = [part.column(i) for i in kept]
                columns += [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    columns.append(pa.array([model.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of their binary ids in the column ``into``."""
    names, schema = _added(rows, [(into, T.StringType())])
    at, kept = rows.columns.index(column), [rows.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for batch in batches:
            texts = [None if x is None else m.decode(x) for x in batch.column(at).to_pylist()]
            columns = [batch.column(i) for i in kept] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
