"""Exact top-k search by no-random-access aggregation.

Each vector's components stand in lists, one for each dimension, sorted by value. For a query, a component
times the query's is a score, and each list is read from the end where these are highest, all to the same depth.
A vector's lower bound is what it has shown plus the least that each list it has not shown up in still holds, and
its upper bound is what it has shown plus the scores last read in those lists. Reading goes on in steps until no
vector outside the best k by lower bound has an upper bound that reaches the k-th lower bound; nothing else ends it
but the ends of the lists. The k winners then get their final scores, ties going to smaller ids. As long as the sum of
the scores last read reaches the k-th lower bound, even a vector that showed up nowhere could still qualify, and
upper bounds of single vectors need no look.

The queries, a stated share of the rows, meet all vectors in blocks: vectors and queries are dealt by hash
into blocks of bounded size, and each pair of blocks is one task's work. Every query must meet every vector, so a
vector travels once for each block of queries, in two bytes a component where the values allow it. The best k of each
block are merged by query with their ranks.

Defined cases: vectors that are NULL or hold NULL or non-finite components take no part; of vectors of unlike
lengths the missing components count as zero; a row is compared with every row of another id, so a repeated
vector under another id is a candidate, and rows of a repeated id are candidates each (rows of a repeated query id
share its k results); scores beyond a long's range end at its limits; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
#: Rows of a block of vectors and of a block of queries.
VECTORS, QUERIES = 8192, 8192
#: Shares of the lists that the steps of reading end at.
STEPS = (1 / 64, 1 / 16, 1 / 4, 3 / 4, 15 / 16, 1)
#: Queries that are read together.
AT_ONCE = 128
_LIMIT = 2**63


def quantise(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component, x as double, as array of double (whole numbers)."""
    x = F.col(vector).cast("array<double>")
    # a component beyond a double once scaled counts as non-finite
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e * SCALE) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(~bad)
    # floor as double: a long would not hold the floor of every finite double
    return rows.select(F.col(id_col).alias("vec_id"), F.transform(x, lambda e: F.rint(e * SCALE) - F.when(F.rint(e * SCALE) > e * SCALE, 1.0).otherwise(0.0)).alias("v"))


class Block:
    """Vectors with their sorted lists. ``reads`` counts the entries that queries read from lists, ``entries`` those there were."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        by_value = np.argsort(self.x, axis=0, kind="stable")
        #: a row is a list, from its low end on
        self.values = np.take_along_axis(self.x, by_value, axis=0).T
        #: places of each vector's components in the lists, from the low ends and from the high ends
        self.from_low = np.empty(by_value.shape, np.int32)
        np.put_along_axis(self.from_low, by_value, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)
        self.from_high = len(ids) - 1 - self.from_low
        self.reads = self.entries = 0

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[list[int], list[int]]]:
        """(vec_ids, scores) of the best k of this block for each query, rows of its own id left out.

        Each list is read from above for queries with a positive component and from below for those with a negative one.
        The entries of a step are laid out by vector, so that one product adds them to the bounds of all queries.
        """
        n, d = self.x.shape
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(queries)
        biggest = float(np.abs(self.x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, d)
        exact = biggest < 2**53
        slack = 0.0 if exact else biggest * 2.0**-40
        self.entries += n * int(np.count_nonzero(queries))
        at = np.arange(len(queries))
        own = self.ids[:, None] == query_ids[None, :]
        up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T  # lists by queries
        least, most = self.values[:, :1], self.values[:, -1:]
        worst_up, worst_down = least * up, most * down
        lower = np.tile((worst_up + worst_down).sum(axis=0), (n, 1))
        depth = 0
        for part in STEPS:
            upto = max(min(n, depth + 1), int(n * part))
            if not len(at):
                break
            new_up, new_down = ((f >= depth) & (f < upto) for f in (self.from_high, self.from_low))
            rows = np.flatnonzero((new_up | new_down).any(axis=1))
            read = np.concatenate([self.x[rows] * new_up[rows], self.x[rows] * new_down[rows], new_up[rows], new_down[rows]], axis=1)
            lower[rows] += read @ np.concatenate([up, down, -worst_up, -worst_down])
            self.reads += (upto - depth) * int(np.count_nonzero(queries[at]))
            depth = upto
            last_up, last_down = self.values[:, n - depth, None] * up, self.values[:, depth - 1, None] * down
            seen = np.where(own, -np.inf, lower)
            place = np.maximum(0, n - np.minimum(k, n - own.sum(axis=0)))
            ranked = np.partition(seen, np.unique(np.minimum(place, n - 1)), axis=0)
            kth = ranked[np.minimum(place, n - 1), np.arange(len(at))]
            # as long as a vector that has shown up nowhere could qualify, no other bounds need a look
            ready = np.flatnonzero(((last_up + last_down).sum(axis=0) < kth - slack) | (depth == n))
            if not len(ready):
                continue
            # what lists in which a vector has not shown up may still give, beyond the worst
            hidden = np.concatenate([self.from_high >= depth, self.from_low >= depth], axis=1).astype(float)
            upper = lower[:, ready] + hidden @ np.concatenate([last_up - worst_up, last_down - worst_down])[:, ready]
            alive = (upper >= kth[ready] - slack) & ~own[:, ready]
            done = np.zeros(len(at), bool)
            for c, i in enumerate(ready.tolist()):
                if depth == n or np.count_nonzero(alive[:, c]) <= k:
                    done[i] = True
                    out[at[i]] = self._resolve(np.flatnonzero(alive[:, c]), queries[at[i]], k, exact)
            if done.any():
                rest = ~done
                at, own, lower = at[rest], own[:, rest], np.ascontiguousarray(lower[:, rest])
                up, down, worst_up, worst_down = up[:, rest], down[:, rest], worst_up[:, rest], worst_down[:, rest]
        return out

    def _resolve(self, left: np.ndarray, query: np.ndarray, k: int, exact: bool) -> tuple[list[int], list[int]]:
        """Final scores of those that may be among the best; more than k are left only by ties and by rounding."""
        if exact:
            s = self.x[left] @ query
            best = np.lexsort((self.ids[left], -s))[:k]
            return self.ids[left[best]].tolist(), s[best].astype(np.int64).tolist()
        whole = [sum(int(a) * int(b) for a, b in zip(self.x[i], query, strict=True)) for i in left]
        best = sorted(range(len(left)), key=lambda i: (-whole[i], self.ids[left[i]]))[:k]
        return self.ids[left[best]].tolist(), [max(-_LIMIT, min(_LIMIT - 1, whole[i])) for i in best]


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of one table column to rows of ``width``, shorter ones filled with zeros."""
    arr = col.combine_chunks()
    lengths = np.diff(arr.offsets.to_numpy())
    out = np.zeros((len(arr), width))
    values = arr.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(arr), width)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _shape(df: DataFrame) -> tuple[int, float]:
    """Number of rows and largest component, without its sign."""
    n, most = df.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda e: F.abs(e))))).first()
    return n, most or 0.0


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = VECTORS, query_block: int = QUERIES) -> DataFrame:
    """(vec_id, v) against queries of the same form: query_id, rank, vec_id, score."""
    (n, most), (m, most_asked) = _shape(vectors), _shape(queries)
    v_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    kind = "smallint" if max(most, most_asked) < 2**15 else "int" if max(most, most_asked) < 2**31 else "double"
    packed = F.col("v").cast(f"array<{kind}>").alias("v")
    # rows, not ids, are dealt out, as one id may be on many rows
    home = lambda c, blocks: F.pmod(F.xxhash64(F.lit(5), c, F.col("v")), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = vectors.select("vec_id", packed, home("vec_id", v_blocks).alias("vb"), every(q_blocks).alias("qb"))
    right = queries.select(F.col("vec_id").alias("query_id"), packed, home("vec_id", q_blocks).alias("qb"), every(v_blocks).alias("vb"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        got: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            width = max(int(pc.max(pc.list_value_length(t["v"])).as_py() or 0) for t in (a, b))
            asked, who = _matrix(b["v"], width), b["query_id"].to_numpy()
            ids, x = a["vec_id"].to_numpy(), _matrix(a["v"], width)
            # equal rows fall into one block, which is worked through in parts of bounded size
            for start in range(0, len(ids), 2 * block):
                part = Block(ids[start : start + 2 * block], x[start : start + 2 * block])
                for i in range(0, len(who), AT_ONCE):
                    for q, (found, scores) in zip(who[i : i + AT_ONCE].tolist(), part.search(asked[i : i + AT_ONCE], who[i : i + AT_ONCE], k), strict=True):
                        got[0].extend([q] * len(found)), got[1].extend(found), got[2].extend(scores)
        return pa.table([pa.array(x, pa.int64()) for x in got], names=["query_id", "vec_id", "score"])

    parts = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(search, "query_id long, vec_id long, score long")
    # at most k rows for each query and block of vectors; their ranks are limited before they are dealt by query
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1(embeddings: DataFrame) -> DataFrame:
    vectors = quantise(embeddings)
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
