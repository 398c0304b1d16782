"""Token counts of a byte-level word BPE (``tokenizers`` file), without emitting ids.

A word's symbols form a linked list; a heap holds its adjacent pairs by rank and place.
The lowest pair is popped and merged until the heap is empty, and the count is the
initial symbols less the merges. Text is normalised and split as the file says: NFC,
white space to one space, lower case, then words by pattern; special strings in a text
are one token each.

Defined cases. Null or empty text: no tokens. Equal rows count alike. No rows: no result
rows; columns other than the text stay as they are, but for one named ``n_tokens``.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS, CACHE_CHARS = 300_000, 48
CHUNK_CHARS = 1 << 20


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    itself if it is printable Latin-1, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class WordBpe(dict):
    """Token count by word; counts a word when it is first asked for."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        names = {t: i for i, t in enumerate(model["vocab"])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {(names[a], names[b]): (rank, names[a + b]) for rank, (a, b) in enumerate(merges)}
        chars = _byte_chars()
        self.inner = [names[c] for c in chars]
        self.last = [names[c + self.end] for c in chars]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.find = regex.compile(pattern).findall
        self.space = regex.compile(r"\p{White_Space}+")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, word: str) -> int:
        n = self.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def count(self, raw: bytes) -> int:
        n = len(raw)
        if n < 2:
            return n
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        pairs, heap, merges = self.pairs, [], 0
        for i in range(n - 1):
            if found := pairs.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbol[i] != a or symbol[j] != b:
                continue  # one of the two has gone into another merge
            symbol[i], symbol[j], merges = made, -1, merges + 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := pairs.get((made, symbol[k])):
                    heapq.heappush(heap, (found[0], i, found[1], made, symbol[k]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbol[h], made))):
                heapq.heappush(heap, (found[0], h, found[1], symbol[h], made))
        return n - merges

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        # The pattern drops white space, so runs of it need no folding of their own.
        return sum(map(self.__getitem__, self.find(text.lower())))

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@functools.lru_cache(maxsize=2)
def _model(path: str) -> WordBpe:
    return WordBpe(path)


def token_counts(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, by the tokenizer file at ``path``."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _model(path)
        for texts in parts:
            yield pd.Series([bpe.tokens(t) for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", count(column))
