"""What several operators share: word rule, folds, checkpoints and bounded batches.

A word is a run of characters other than blank and U+0009 to U+000D. ``bytes.split()`` without
arguments cuts at exactly these six characters, so Python code splits the UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage  # noqa: F401  (the operators take it from here)

WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one Python step works on at once.
CHUNK_BYTES = 4 << 20
#: Bytes of one text that are cut into words at once.
PIECE_BYTES = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Rows of a few numbers that one task of a fit takes, and numbers of a sum that are added in one place.
FIT_ROWS, PIECE = 20_000, 1 << 14


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts do not add up in a Python worker. Queries are run lazily, so that the
    setting must last; it only ever gets smaller."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= 2000:
        spark.conf.set(ARROW_ROWS, "2000")


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` under column names that no working column bears, the new names by the old ones, and the way back,
    which gives the columns of ``docs`` in their order."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, lambda out: out.select(*[F.col(new).alias(old) for old, new in names.items()])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 0, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in ``column`` add up to about CHUNK_BYTES; one long text stands alone."""
    col = batch.column(column)
    start, size = 0, 0
    lengths = pc.binary_length(col).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += (n or 0) + 1
    if start < batch.num_rows:
        yield batch.slice(start)


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text cut at blanks into pieces of some PIECE_BYTES, so that the words of a long one are never all objects at
    once. A word stays whole, whatever its length."""
    start = 0
    while len(raw) - start > PIECE_BYTES and (blank := _BLANK.search(raw, start + PIECE_BYTES)):
        yield raw[start : blank.start()]
        start = blank.start()
    yield raw[start:] if start else raw


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of every document labelled 0 or 1 outside the held-out fold. A document labelled more than once
    counts once, with its smallest label."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    return rows.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))


def digits(values: np.ndarray) -> np.ndarray:
    """Nine digits of each value, so that the order of sums does not show."""
    return np.array([float(f"{v:.9g}") for v in values])


def summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum, over all rows, of the numbers that ``of`` gives for a batch; None without rows. The driver gets the
    sum alone: pieces of it are added by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = None
        for b in batches:
            if b.num_rows:
                more = of(b).ravel()
                flat = more if flat is None else flat + more
        for i in range(0, 0 if flat is None else len(flat), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([flat[i : i + PIECE].tobytes()], pa.binary())], names=["at", "piece"])

    def add(group: pa.Table) -> pa.Table:
        # in order of their bytes, as that in which they come is open
        total = sum(np.frombuffer(x) for x in sorted(group.column("piece").to_pylist()))
        return pa.table([group.column("at").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["at", "piece"])

    found = rows.mapInArrow(run, "at long, piece binary").groupBy("at").applyInArrow(add, "at long, piece binary").collect()
    return np.concatenate([np.frombuffer(r.piece) for r in sorted(found, key=lambda r: r.at)]) if found else None


def running(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows (s, y) to each distinct s with its rows, n, and its sum of y, and with n_to and y_to, the sums over
    all that are not above it. Ranges of s are summed apart, so that no task sees all."""
    each = rows.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("y"))
    each = each.repartitionByRange(n // FIT_ROWS + 2, "s").sortWithinPartitions("s").withColumn("part", F.spark_partition_id())
    each = cut_lineage(each)
    before, low = {}, (0, 0)
    for r in sorted(each.groupBy("part").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()):
        before[r.part], low = low, (low[0] + r.n, low[1] + r.y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for b in batches:
            if b.num_rows:
                seen = seen or before[b.column("part")[0].as_py()]
                to = [start + np.cumsum(b.column(c).to_numpy()) for start, c in zip(seen, ("n", "y"), strict=True)]
                seen = (int(to[0][-1]), int(to[1][-1]))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, to)], names=["s", "n", "y", "n_to", "y_to"])

    return each.mapInArrow(run, "s double, n long, y long, n_to long, y_to long")
