"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's trie has two roots, for pieces that start a word and for pieces that go on. Each node has
a failure link, to the node where matching goes on once the longest pieces in it are popped, and the number
of pieces popped on the way, both precomputed in one breadth-first pass. A word is read once; its greedy
longest-match pieces are counted and never built. A word that can't be matched whole is one unknown token.

Words are those of ``common.WORD``. Distinct words of a batch are counted once.

Defined cases: NULL, empty and blank texts have no tokens; words may have any length; repeated rows and
further columns stay; an empty table stays empty.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vocab as V
from .common import chunks

CACHE_WORDS = 500_000


class LongestMatch:
    """Automaton over pieces that start words (``first``) and pieces that go on (``rest``)."""

    def __init__(self, first: Iterable[str], rest: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends: list[bool] = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for p in pieces:
                v = root
                for c in p:
                    n = self.next[v].get(c)
                    if n is None:
                        n = self.next[v][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    v = n
                if p:
                    ends[v] = True
        size = len(self.next)
        self.fail, self.popped = [-1] * size, [0] * size
        todo = deque((root, c, v) for root in (0, 1) for c, v in self.next[root].items())
        while todo:
            parent, c, v = todo.popleft()
            if ends[v]:
                self.fail[v], self.popped[v] = 1, 1
            else:
                z, n = self.fail[parent], self.popped[parent]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], n
            todo.extend((v, d, u) for d, u in self.next[v].items())

    def count(self, word: str) -> int:
        """Number of greedy pieces of a word; 0 if it can't be matched."""
        nxt, fail, popped = self.next, self.fail, self.popped
        v, n = 0, 0
        for c in word:
            u = nxt[v].get(c)
            while u is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return 0
                u = nxt[v].get(c)
            v = u
        while v != 1:
            n += popped[v]
            v = fail[v]
            if v < 0:
                return 0
        return n


def automaton(voc: V.Vocabulary) -> LongestMatch:
    """Pieces with one leading mark start words, pieces without go on; marks alone are no pieces of words."""
    normal = [p for p, k in zip(voc.pieces, voc.kinds, strict=True) if k == V.NORMAL]
    return LongestMatch([p[1:] for p in normal if p[0] == "▁" and "▁" not in p[1:] and len(p) > 1], [p for p in normal if "▁" not in p])


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_tokens and n_unknown (words outside the vocabulary, a token each)."""
    names = ("n_words", "n_tokens", "n_unknown")
    rest = docs.drop(*names)
    schema = T.StructType([*rest.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    voc = V.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(voc)
        known: dict[str, int] = {}
        for b in batches:
            for part in chunks(b, text):
                words = pc.ascii_split_whitespace(pc.fill_null(part.column(text).cast(pa.string()), ""))
                offsets = words.offsets.to_numpy().astype(np.int64)
                flat = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
                offsets = offsets - offsets[0]
                if len(known) > CACHE_WORDS:
                    known.clear()
                count = np.zeros(len(flat.dictionary), np.int64)
                for i, w in enumerate(flat.dictionary.to_pylist()):
                    n = known.get(w)
                    if n is None:
                        n = known[w] = machine.count(w) if w else -1
                    count[i] = n
                codes = flat.indices.to_numpy(zero_copy_only=False)
                got = count[codes] if len(codes) else np.zeros(0, np.int64)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (got >= 0, np.where(got == 0, 1, np.maximum(got, 0)), got == 0)]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array((s[offsets[1:]] - s[offsets[:-1]]).astype(np.int64)) for s in sums]], names=schema.names)

    return rest.mapInArrow(run, schema)


def op10(docs: DataFrame, path: str | None = None) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"), path).drop("text")
