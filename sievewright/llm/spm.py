"""SentencePiece encoding and decoding by a Viterbi pass shared between common prefixes.

The distinct marked words of a batch are sorted, which is a depth-first walk of their trie: each word
keeps the forward states of the prefix that it has in common with the word before and computes only the
rest. For unigram models a state is the best score of the prefix with its last piece. For BPE models, whose
result is not the best sum of scores, a state is the last piece of the prefix's own BPE result: a piece may
follow if the two alone would merge to just these two, and exactly one piece may. Both give what the
SentencePiece library gives for the model; the tests compare with it.

Blanks become U+2581 and one is put before the text. Marked words start where a run of blanks starts, and
line ends stand alone, as no piece spans these places (checked when the model is loaded; otherwise texts are
taken whole). Characters outside the vocabulary become their bytes' pieces, or the unknown piece.

Defined cases: NULL texts give NULL ids and NULL decoded text; empty texts give no ids; a literal U+2581
decodes to a blank, as in the library; repeated rows and further columns stay; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab as V
from .common import chunks

MARK = "▁"
#: Distinct words that a worker remembers before it starts anew.
CACHE_WORDS = 600_000


class Encoder:
    def __init__(self, voc: V.Vocabulary, usable: dict[str, int] | None = None):
        """``usable``: ``whole_pieces()`` of an encoder for the same vocabulary, which takes a second to find."""
        self.voc = voc
        in_text = (V.NORMAL, V.USER, V.UNUSED)
        self.ids = {p: i for i, (p, k) in enumerate(zip(voc.pieces, voc.kinds, strict=True)) if k in in_text}
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(voc.pieces, voc.kinds, strict=True)) if k == V.BYTE}
        self.unknown = next((i for i, k in enumerate(voc.kinds) if k == V.UNKNOWN), 0)
        self.cuts = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)
        self.lowest = min((s for s, k in zip(voc.scores, voc.kinds, strict=True) if k in in_text), default=0.0) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.usable = self.whole_pieces() if usable is None else usable
        self.reach: dict[str, int] = {}
        for p in self.usable:
            if len(p) > 2:
                self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 0))

    # --- BPE ---------------------------------------------------------------------------------
    def merge(self, s: str) -> list[str]:
        """Plain BPE of a short string: the best-scored neighbours merge first, of equals the leftmost."""
        parts = list(s)
        ids, scores = self.ids, self.voc.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or scores[j] > best):
                    best, at = scores[j], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole_pieces(self) -> dict[str, int]:
        """Pieces that merging their own characters gives; for BPE no other piece can be in a result."""
        if self.voc.model_type != V.BPE:
            return self.ids
        return {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}

    def may_follow(self, a: str, b: str) -> bool:
        if len(self.pairs) > CACHE_WORDS:
            self.pairs.clear()
        got = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return got

    # --- forward pass over sorted words ------------------------------------------------------
    def encode_sorted(self, words: list[str]) -> Iterator[list[str]]:
        """The pieces of each word; ``words`` sorted. last[i] is the last piece of the first i characters.

        Of the places where the last piece may start, those further back than any piece with the same three
        last characters is long are left out.
        """
        bpe = self.voc.model_type == V.BPE
        ids, pairs, reach, lowest, scores = self.usable, self.pairs, self.reach, self.lowest, self.voc.scores
        last: list[str] = [""]
        best: list[float] = [0.0]
        before = ""
        for w in words:
            shared = 0
            for x, y in zip(before, w, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(w) + 1):
                start = i - reach.get(w[i - 3 : i], 2) if i > 2 else 0
                if start < 0:
                    start = 0
                if bpe:
                    for j in range(start, i):
                        p = w[j:i]
                        if p in ids or j == i - 1:
                            if j == 0:
                                break
                            ok = pairs.get((last[j], p))
                            if ok or ok is None and self.may_follow(last[j], p):
                                break
                    else:
                        raise ValueError(f"no last piece at {i} of {w[:50]!r}")
                    last.append(p)
                else:
                    top, piece = None, ""
                    for j in range(start, i):
                        p = w[j:i]
                        k = ids.get(p)
                        if k is None and i - j > 1:
                            continue
                        score = best[j] + (lowest if k is None else scores[k])
                        if top is None or score > top:
                            top, piece = score, p
                    last.append(piece)
                    best.append(top)
            before = w
            out, i = [], len(w)
            while i:
                out.append(last[i])
                i -= len(last[i])
            yield out[::-1]

    def to_ids(self, pieces: list[str]) -> list[int]:
        ids = self.ids
        try:
            return [ids[p] for p in pieces]
        except KeyError:
            pass
        out: list[int] = []
        for p in pieces:
            i = ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode())
            elif not out or out[-1] != self.unknown:  # a run of unknown characters is one piece
                out.append(self.unknown)
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the given distinct words."""
        fresh = sorted(w for w in words if w not in self.known)
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = sorted(words)
        for w, pieces in zip(fresh, self.encode_sorted(fresh), strict=True):
            self.known[w] = self.to_ids(pieces)
        out = [self.known[w] for w in words]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        return out

    # --- batches -----------------------------------------------------------------------------
    def words_of(self, texts: pa.Array) -> pa.ListArray:
        """Marked words of each text; NULL and empty texts have none."""
        empty = pc.fill_null(pc.equal(texts, ""), True)
        marked = pc.binary_join_element_wise(pa.scalar(MARK if self.voc.dummy_prefix else ""), pc.fill_null(texts, ""), "")
        if not self.cuts:
            marked = pc.replace_substring(marked, " ", MARK)
            return pa.array([[] if e else [m] for m, e in zip(marked.to_pylist(), empty.to_pylist(), strict=True)], pa.list_(pa.string()))
        marked = pc.replace_substring(marked, " ", f" {MARK}")
        while pc.any(pc.match_substring(marked, f"{MARK} {MARK}")).as_py():
            marked = pc.replace_substring(marked, f"{MARK} {MARK}", MARK * 2)
        marked = pc.if_else(empty, "", pc.replace_substring(marked, "\n", " \n "))
        return pc.split_pattern(marked, " ")

    def encode_batch(self, texts: pa.Array) -> pa.ListArray:
        words = self.words_of(texts)
        offsets = words.offsets.to_numpy().astype(np.int64)
        flat = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        coded = self.encode_words(flat.dictionary.to_pylist())
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        pool = np.fromiter((i for c in coded for i in c), np.int32, int(lengths.sum()))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])
        return pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), pa.array(pool[at]), mask=pc.is_null(texts))

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: pieces joined, byte pieces as bytes, marks as blanks, less the first one."""
        if not hasattr(self, "raw"):
            raw = [bytes([int(p[1:-1], 16)]) if k == V.BYTE else b"" if k == V.CONTROL else " ⁇ ".encode() if k == V.UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.voc.pieces, self.voc.kinds, strict=True)]
            self.raw = pa.array(raw, pa.binary())
        pieces = pa.ListArray.from_arrays(ids.offsets, self.raw.take(ids.values), mask=pc.is_null(ids))
        joined = pc.binary_join(pieces, b"")
        try:
            text = joined.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([None if b is None else b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
        if self.voc.dummy_prefix:
            text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
        return text


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int); a column of that name is replaced."""
    return _mapped(docs, "ids", "array<int>", text, path, lambda e, col: e.encode_batch(col.cast(pa.string())))


def decode_documents(coded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``coded`` with ``decoded`` (string); a column of that name is replaced."""
    return _mapped(coded, "decoded", "string", ids, path, lambda e, col: e.decode_batch(pa.array(col.to_pylist(), pa.list_(pa.int32()))))


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, both from one pass over the texts."""
    coded = lambda e, col: (i := e.encode_batch(col.cast(pa.string())), e.decode_batch(i))
    return _mapped(docs, "ids,decoded", "array<int>,string", text, path, coded)


def _mapped(df: DataFrame, names: str, types: str, column: str, path: str | None, f) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    new = list(zip(names.split(","), types.split(","), strict=True))
    rest = df.drop(*[n for n, _ in new if n != column])
    schema = T.StructType([*rest.schema.fields, *[T.StructField(n, _parse_datatype_string(t)) for n, t in new]])
    voc = V.load(path)
    usable = Encoder(voc).usable

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(voc, usable)
        for b in batches:
            parts = chunks(b, column) if types != "string" else [b]
            for part in parts:
                got = f(encoder, part.column(column))
                got = got if isinstance(got, tuple) else (got,)
                yield pa.RecordBatch.from_arrays([*part.columns, *got], names=schema.names)

    return rest.mapInArrow(run, schema)


def op5(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): whether the decoded ids give the text back."""
    done = round_trip(docs.select("doc_id", "text"), path)
    same = F.coalesce(F.translate("text", MARK, " ") == F.col("decoded"), F.col("text").isNull())
    return done.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))
