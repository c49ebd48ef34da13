"""Reading published lists: files of several formats to rows of cells.

``spark.read.format('binaryFile')`` brings the bytes, so any store that Spark reads will do; formats are told
apart by content. A file that can't be read gives one row with its error, and the others are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import containers

_TEXT_SUFFIX = r"(?i)\.(html?|md|markdown|txt)$"
SCHEMA = "path string, row_index int, cells array<string>, error string"


def detect_format(content: Column, path: Column) -> Column:
    """docx, doc or html by the first bytes; else the suffix, or unknown. Content beats the name."""
    head = F.substring(content, 1, 8)
    starts = lambda magic: F.hex(head).startswith(magic)
    # the first of these bytes that is no blank
    mark = F.regexp_extract(F.hex(head), "^(?:09|0A|0B|0C|0D|20)*([0-9A-F]{2})", 1)
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(starts("504B0304"), F.lit("docx")).when(starts("D0CF11E0"), F.lit("doc")).when(mark.isin("3C", "2A", "23"), F.lit("html")).otherwise(F.coalesce(F.nullif(suffix, F.lit("")), F.lit("unknown")))


def file_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def kind_of(content: Column, path: Column) -> Column:
    """The format that a file is read as: a text suffix wins over the content, as for lists that are kept as text."""
    return F.when(path.rlike(_TEXT_SUFFIX), F.lit("html")).otherwise(detect_format(content, path))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes of a text in one of the encodings that lists come in."""
    return content.map(containers.decode_text, na_action="ignore")


def rows_of(files: DataFrame) -> DataFrame:
    """Files (path, content) to (path, row_index, cells, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    rows, error = containers.table_rows(content, kind), None
                except containers.Unreadable as e:
                    rows, error = [], str(e)
                found = [(path, i, r, None) for i, r in enumerate(rows)] or [(path, None, None, error)]
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "row_index", "cells", "error"), r, strict=True)) for r in found], schema=pa.schema([("path", pa.string()), ("row_index", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())]))

    return files.select("path", "content", kind_of(F.col("content"), F.col("path")).alias("kind")).mapInArrow(run, SCHEMA)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_index, cells, error) of all files under ``path``."""
    return rows_of(spark.read.format("binaryFile").load(path))


def first_errors(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The first errors by path, as many as a reader is shown."""
    return rows.where("error is not null").select("path", "error").orderBy("path").limit(limit)
