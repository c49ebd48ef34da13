"""Sharding by a two-pass external shuffle.

Pass one scatters the records by seeded hashes: rendezvous hashing on the id names the shard, so that
one more shard takes rows only into itself, and a second hash names a bucket of the shard. The number of
buckets follows the bytes of all records, so that a bucket fits in memory. Pass two puts the rows of each
bucket in a canonical order, shuffles them by Fisher and Yates with a generator seeded by (seed, shard,
bucket), and numbers them from the bucket's offset; offsets are prefix sums of the bucket counts, and meet their
bucket in the same exchange.

Rows that are equal in id and text fall into one bucket. Where that makes a bucket much too large, its repeated rows
are counted first (with partial sums), and the copies of each are dealt over the shard's buckets by their number.

Defined cases: NULL ids count as one key; NULL texts have no bytes; repeated rows each get a slot; rows of one id
and text are ordered by their further columns, those of plain types; an empty table gives an empty result; further
columns are carried along, whatever their names, but ``shard``, ``slot``, ``grown_shard`` and ``bucket`` of the
input are replaced. Rows with a map among their columns can't be counted and stay in their bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, set_aside

SEED = 20240
BUCKET_BYTES = 16 << 20
#: Bytes of buckets that a task of pass two gets.
PARTITION_BYTES = 64 << 20
#: Bytes that a record has besides its text.
ROW_BYTES = 16


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash with the key is largest."""
    scored = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("h"), s.alias("s")))
    return F.array_max(scored)["s"].cast("int")


def fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A permutation of 0 to n - 1: each place from the last swaps with a random place up to itself."""
    order = np.arange(n)
    if n > 1:
        places = np.random.default_rng([s & 0xFFFFFFFF for s in seed]).integers(0, np.arange(n, 1, -1))
        for i, j in zip(range(n - 1, 0, -1), places.tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
    return order


#: A bucket with this many times the bytes it should have is looked at for repeated rows.
HEAVY = 4


def _spread(scattered: DataFrame, heavy: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``scattered`` with the copies of repeated rows in ``heavy`` buckets dealt over all buckets of their shard."""
    own = [c for c in scattered.columns if c != "bucket"]
    inside = scattered.join(heavy, ["shard", "bucket"], "left_semi")
    rest = scattered.join(heavy, ["shard", "bucket"], "left_anti")
    # equal rows are interchangeable, so that their number says all
    counted = inside.groupBy(*own, "bucket").agg(F.count("*").alias("copies"))
    copies = counted.select(*own, "bucket", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return rest.unionByName(copies.select(*own, F.pmod(F.col("bucket") + F.when(F.col("copy") > 1, F.pmod(F.xxhash64(F.lit(seed + 2), "copy"), F.lit(buckets))).otherwise(0), F.lit(buckets)).cast("int").alias("bucket")))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``shard``, ``grown_shard`` (with one more shard), ``bucket`` and ``slot``.

    The rows of a bucket leave together and in slot order; ``write_shards`` writes them so.
    """
    added = ("shard", "grown_shard", "bucket", "slot")
    rows, names, _ = set_aside(docs.drop(*added))
    key, text = names[key], names[text]
    total = rows.agg(F.sum(record_size(F.col(text)))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    cell = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)), F.lit(buckets)).cast("int")
    scattered = rows.withColumns({"shard": rendezvous(F.col(key), shards, seed), "grown_shard": rendezvous(F.col(key), shards + 1, seed), "bucket": cell})
    sizes = lambda df: df.groupBy("shard", "bucket").agg(F.count("*").alias("n_rows"), F.sum(record_size(F.col(text))).alias("n_bytes"))
    counts = cut_lineage(sizes(scattered))
    heavy = counts.where(F.col("n_bytes") > HEAVY * bucket_bytes).select("shard", "bucket")
    if buckets > 1 and not any(isinstance(f.dataType, T.MapType) for f in rows.schema.fields) and not heavy.isEmpty():
        scattered = _spread(scattered, heavy, buckets, seed)
        counts = cut_lineage(sizes(scattered))
    schema = T.StructType([*scattered.schema.fields, T.StructField("slot", T.LongType())])
    plain = [f.name for f in rows.schema.fields if f.name not in (key, text) and isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) and not isinstance(f.dataType, T.DecimalType)]

    def shuffle(group: pa.Table, offset: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, [*group.schema.types, pa.int64()], strict=True)})
        shard, bucket = group.column("shard")[0].as_py(), group.column("bucket")[0].as_py()
        canonical = pc.sort_indices(group, sort_keys=[(c, "ascending") for c in (key, text, *plain)])
        perm = fisher_yates(group.num_rows, seed, shard, bucket)
        group = group.take(pc.take(canonical, pa.array(perm)))
        start = offset.column("bucket_start")[0].as_py()
        return group.append_column("slot", pa.array(np.arange(start, start + group.num_rows, dtype=np.int64)))

    # one row a bucket: a shard's window holds its buckets' counts only
    before = F.coalesce(F.sum("n_rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("bucket_start"))
    # partitions follow the bytes, whatever the session's number for shuffles is
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    dealt = lambda df: df.repartition(parts, "shard", "bucket").groupBy("shard", "bucket")
    shuffled = dealt(scattered).cogroup(dealt(offsets)).applyInArrow(shuffle, schema)
    return shuffled.select(*[F.col(new).alias(old) for old, new in names.items()], *added)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; each bucket becomes a run of rows in slot order."""
    sharded.repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op7(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard_documents(docs.select("doc_id", "text")).select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
