"""Quality rules: robust multivariate outliers per language and source.

Each document gets counts from its whole text; a base rule on them fails very short and very repetitive
texts. The others become a vector of transformed statistics. For each (language, source), and for all rows
together, the minimum covariance determinant estimate of centre and scatter comes from concentration steps: the
share H of rows with the smallest Mahalanobis distances gives the next centre and scatter. Three starts (medians
with quarter-ranges, mean with covariance, medians with noise) take two steps each; the one with the smallest
determinant goes on until its determinant no longer falls. Then one reweighting step takes all rows within the
quantile REWEIGHT. A group's estimate is drawn towards that of all rows by SHRINK / (n + SHRINK), which small groups
feel and large ones don't. A document is rejected when its distance is beyond the chi-square cut-off.

A step is one aggregation: distances fall into fine logarithmic bins, counts and moments are summed by
(group, start, bin) with partial sums, and the bins up to the share H give the moments. No group meets in a task,
all rows take part, and the estimates stay a table of one row a group and start.

Many statistics are zero in almost all clean texts, so that scatter alone would reject any text with one symbol.
No direction of the scatter is taken as narrower than the noise of counting in a text of the group's typical length
n: a sum of n word lengths of mean m varies by sqrt(m / n) around m, and the root of a Poisson count's share by
1 / (2 sqrt(n)), times four for repeated words, which come in two windows of eight at least. Nothing here is set by
hand but SHRINK, H and the two quantiles; log words have a numerical least value only.

Defined cases: NULL and blank texts have zero counts and fail the base rule; NULL languages and sources are
groups of their own; NULL ids stay; repeated rows count as often as they occur; an empty table stays empty;
further columns are ignored by the query and kept by the filter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, pieces, set_aside

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Share of a group's rows that a concentration step keeps, and the most steps.
H, STEPS = 0.75, 10
#: Probability that a normal vector stays within the reweighting step, and within the cut-off.
REWEIGHT, KEEP = 0.975, 0.99999
#: Rows that the estimate of all rows counts for in a group's.
SHRINK = 200
#: log words, mean word length, root of symbols per word, of repeated lines and of repeated words per word.
DIMS = 5
#: Key of all rows; a group's key is never empty.
ALL = ""
#: Estimates, of some 300 bytes each, that may be broadcast.
BROADCAST_GROUPS = 20_000
#: Files that the estimates, a row a group, are written to at each step.
ESTIMATE_PARTITIONS = 8
BINS_PER_OCTAVE = 8
#: Windows that are looked up at once.
BLOCK = 1 << 17
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of a text, 8 bytes each in place of an object."""
    found = [np.fromiter(map(hash, words := piece.split()), np.int64, len(words)) for piece in pieces(raw)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def base_counts(text: str | None, hashes: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; ``hashes`` are its ``word_hashes``."""
    if not text:
        return 0, 0, 0, 0, 0
    if hashes is None:
        hashes = word_hashes(text.encode())
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(BLANKS):
                seen.add(line)
    return len(hashes), chars, symbols, dup, repeat_words(hashes)


def repeat_words(hashes: np.ndarray) -> int:
    """Words in 8-word windows that occur at least twice in the text, by the words' hashes."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    h = hashes.view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled += h[k : k + n] * _POWERS[k]
    ranked = np.sort(rolled)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    del ranked
    if not len(again):
        return 0
    again = again[np.concatenate([[True], again[1:] != again[:-1]])]
    inside = np.zeros(len(hashes), bool)
    for i in range(0, n, BLOCK):
        part = rolled[i : i + BLOCK]
        twice = again[np.minimum(np.searchsorted(again, part), len(again) - 1)] == part
        for k in range(WINDOW):
            inside[i + k : i + k + len(part)] |= twice
    return int(inside.sum())


def with_counts(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (without the text unless kept) and the five counts."""
    rest = docs.drop(*COUNTS)
    fields = [f for f in rest.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(text)
            counts = np.array([base_counts(col[i].as_py()) for i in range(b.num_rows)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], *[pa.array(counts[:, k]) for k in range(len(COUNTS))]], names=schema.names)

    return rest.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def statistics() -> list[Column]:
    """The transformed vector; rows with words only."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.sqrt(F.col(c) / n)
    return [F.log(n), F.col("word_chars") / n, share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]


def chi_square_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * k))) ** 3


def chi_square_cdf(x: float, k: int) -> float:
    return NormalDist().cdf(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def consistency(share: float) -> float:
    """The scatter of the inner share of a normal vector is this much too small."""
    return share / chi_square_cdf(chi_square_quantile(share, DIMS), DIMS + 2)


_TRI = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
_DOUBLES = T.ArrayType(T.DoubleType())
_ESTIMATE = T.StructType([T.StructField("key", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.LongType()), *[T.StructField(c, _DOUBLES) for c in ("centre", "scatter", "inverse")], T.StructField("logdet", T.DoubleType())])


def noise(centre: np.ndarray) -> np.ndarray:
    """Least standard deviations around a centre: the noise of counting in a text of its length."""
    n = math.exp(min(max(centre[0], 0.0), 50.0))
    share = 0.5 / math.sqrt(n)
    return np.array([1e-3, math.sqrt(max(centre[1], 1.0) / n), share, share, share * math.sqrt(2 * WINDOW)])


def inverse_of(centre: np.ndarray, scatter: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log determinant of a scatter that is nowhere narrower than the noise."""
    unit = noise(centre)
    width, axes = np.linalg.eigh(scatter / np.outer(unit, unit))
    width = np.maximum(width, 1.0)
    return (axes / width) @ axes.T / np.outer(unit, unit), float(np.log(width).sum() + 2 * np.log(unit).sum())


def _rows(found: list[tuple[str, int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(key, start, n, centre, scatter) to estimates."""
    keys, starts, ns, centres, scatters = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [], [], [])
    solved = [inverse_of(c, s) for c, s in zip(centres, scatters, strict=True)]
    tri = lambda m: [float(m[i, j]) for i, j in _TRI]
    doubles = pa.list_(pa.float64())
    arrays = [pa.array(keys, pa.string()), pa.array(starts, pa.int32()), pa.array(ns, pa.int64()), pa.array([c.tolist() for c in centres], doubles), pa.array([tri(s) for s in scatters], doubles), pa.array([tri(p) for p, _ in solved], doubles), pa.array([d for _, d in solved], pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, names=_ESTIMATE.names)


def _square(tri: list[float]) -> np.ndarray:
    out = np.zeros((DIMS, DIMS))
    for v, (i, j) in zip(tri, _TRI, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _moments(row: dict, m: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
    centre = np.array([row[f"s{i}"] for i in range(DIMS)]) / m
    scatter = _square([row[f"s{i}_{j}"] / m - centre[i] * centre[j] for i, j in _TRI])
    return centre, scatter * factor


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """Moments (key, start, n, c, s0.., s0_0..) to estimates; a small matrix a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(r["key"], r["start"], r["n"], *_moments(r, r["c"], factor)) for r in b.to_pylist()])

    return moments.coalesce(ESTIMATE_PARTITIONS).mapInArrow(run, _ESTIMATE)


def _starts(middle: DataFrame) -> DataFrame:
    """Quartiles q0.. and moments of a key's rows to its three starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for r in b.to_pylist():
                low, median, high = np.array([r[f"q{i}"] for i in range(DIMS)]).T
                # a quarter-range of a normal variable is 1.349 standard deviations
                found += [(r["key"], 0, r["n"], median, np.diag(((high - low) / 1.349) ** 2)), (r["key"], 1, r["n"], *_moments(r, r["n"], 1.0)), (r["key"], 2, r["n"], median, np.diag(noise(median) ** 2))]
            yield _rows(found)

    return middle.coalesce(ESTIMATE_PARTITIONS).mapInArrow(run, _ESTIMATE)


def sized(groups: DataFrame) -> DataFrame:
    """Estimates to join with: broadcast while their number is checked to be small, else left to the planner."""
    return F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups


def _distance(x: list[Column], centre: Column, inverse: Column) -> Column:
    d = [x[i] - centre[i] for i in range(DIMS)]
    return sum((inverse[k] * d[i] * d[j] * (1 if i == j else 2) for k, (i, j) in enumerate(_TRI)), F.lit(0.0))


def minimum_covariance_determinant(rows: DataFrame) -> DataFrame:
    """Rows (key, x array of DIMS doubles) to estimates, a row for each key, reweighted."""
    x = [F.col("x")[i] for i in range(DIMS)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in _TRI]
    middle = rows.groupBy("key").agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, c in enumerate(x)], F.count("*").alias("n"), *sums)

    def near(params: DataFrame) -> DataFrame:
        return rows.join(sized(params.select("key", "start", "n", "centre", "inverse")), "key").withColumn("d", _distance(x, F.col("centre"), F.col("inverse")))

    def step(params: DataFrame) -> DataFrame:
        binned = near(params).withColumn("bin", F.floor(F.log2(F.col("d") + 1e-6) * BINS_PER_OCTAVE))
        binned = binned.groupBy("key", "start", "bin").agg(F.count("*").alias("c"), F.first("n").alias("n"), *sums)
        # the bins of a key are bounded in number by the range of doubles
        before = F.coalesce(F.sum("c").over(Window.partitionBy("key", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inner = binned.withColumn("before", before).where(F.col("before") < H * F.col("n"))
        names = [c for c in binned.columns if c not in ("key", "start", "bin", "n")]
        return cut_lineage(_estimates(inner.groupBy("key", "start").agg(F.first("n").alias("n"), *[F.sum(c).alias(c) for c in names]), consistency(H)))

    whole = F.struct(*_ESTIMATE.names)
    now = step(step(cut_lineage(_starts(middle))))
    now = now.groupBy("key").agg(F.min_by(whole, F.struct("logdet", "start")).alias("e")).select("e.*")
    settled = None
    for _ in range(STEPS - 2):
        after = step(now).select("key", whole.alias("a")).join(now.select("key", whole.alias("b")), "key")
        falls = F.col("a.logdet") < F.col("b.logdet") - 1e-4
        after = cut_lineage(after.select(falls.alias("falls"), F.when(falls, F.col("a")).otherwise(F.col("b")).alias("e")).select("falls", "e.*").coalesce(ESTIMATE_PARTITIONS))
        done, now = after.where("not falls").drop("falls"), after.where("falls").drop("falls")
        settled = done if settled is None else settled.unionByName(done)
        if now.isEmpty():
            break
    settled = cut_lineage(settled.unionByName(now).coalesce(ESTIMATE_PARTITIONS))
    inner = near(settled).where(F.col("d") <= chi_square_quantile(REWEIGHT, DIMS))
    return cut_lineage(_estimates(inner.groupBy("key", "start").agg(F.first("n").alias("n"), F.count("*").alias("c"), *sums), consistency(REWEIGHT)))


def shrunk(groups: DataFrame, everything: Row) -> DataFrame:
    """Groups' estimates drawn towards that of all rows, small groups more."""
    centre, scatter = np.array(everything["centre"]), _square(everything["scatter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for r in b.to_pylist():
                own = r["n"] / (r["n"] + SHRINK)
                found.append((r["key"], r["start"], r["n"], own * np.array(r["centre"]) + (1 - own) * centre, own * _square(r["scatter"]) + (1 - own) * scatter))
            yield _rows(found)

    return groups.mapInArrow(run, _ESTIMATE)


def _keyed(counted: DataFrame, lang: str, source: str) -> DataFrame:
    """``counted`` with base_failed, the vector x (NULL where the base rule fails) and the group's key."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return counted.withColumn("base_failed", base_failed()).withColumn("x", F.when(~F.col("base_failed"), F.array(*statistics()))).withColumn("key", F.concat_ws("\x1f", name(lang), name(source)))


def fit(counted: DataFrame, lang: str = "lang", source: str = "source") -> tuple[DataFrame, Row] | None:
    """Counts with language and source to the groups' estimates and that of all rows; None without rows."""
    rows = cut_lineage(_keyed(counted, lang, source).where("not base_failed").select("key", "x"))
    found = minimum_covariance_determinant(rows.select(F.explode(F.array("key", F.lit(ALL))).alias("key"), "x"))
    everything = found.where(F.col("key") == ALL).first()
    if everything is None:
        return None
    return shrunk(found.where(F.col("key") != ALL), everything).select("key", "centre", "inverse"), everything


def judge(counted: DataFrame, model: tuple[DataFrame, Row] | None, lang: str = "lang", source: str = "source") -> DataFrame:
    """``counted`` with base_failed, distance and kept; its other columns must not bear the names x, key, centre and inverse."""
    found = _keyed(counted, lang, source)
    if model is None:
        distance = F.lit(None).cast("double")
    else:
        groups, everything = model
        found = found.join(sized(groups), "key", "left")
        centre, inverse = F.coalesce("centre", F.lit(everything["centre"])), F.coalesce("inverse", F.lit(everything["inverse"]))
        distance = F.when(~F.col("base_failed"), _distance([F.col("x")[i] for i in range(DIMS)], centre, inverse))
    found = found.withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.col("distance") <= chi_square_quantile(KEEP, DIMS))
    return found.withColumn("kept", F.coalesce(kept, F.lit(False))).drop("x", "key", "centre", "inverse")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. The texts are read twice and never moved."""
    rows, names, back = set_aside(docs)
    text, lang, source = (names[c] for c in ("text", "lang", "source"))
    model = fit(with_counts(rows.select(text, lang, source), text), lang, source)
    return back(judge(with_counts(rows, text, keep_text=True), model, lang, source).where("kept"))


def op2(docs: DataFrame) -> DataFrame:
    counted = cut_lineage(with_counts(docs.select("doc_id", "text", "lang", "source")))
    return judge(counted, fit(counted)).select("doc_id", *COUNTS, "base_failed", "kept", "distance")
