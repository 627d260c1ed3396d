"""Small helpers shared by the training-data operators.

Every operator reads its input through :func:`take_columns`, so an input may
carry any extra columns, also ones whose names differ only in case or equal
an operator's own output names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import give_back, short_batches  # noqa: F401 (give_back: for the operators)

#: Text bytes handled at once by the numpy code of a task.  A longer text is
#: handled alone and whole.
BATCH_BYTES = 1 << 19


def position(df: DataFrame, name: str) -> int:
    """Where the column is: by exact name, else the first equal but for case."""
    have = df.columns
    return have.index(name) if name in have else [c.lower() for c in have].index(name.lower())


def with_plain_names(df: DataFrame, *names: str):
    """(``df`` whose other columns are called _x0, _x1, ..., a function that
    gives a frame with these columns the old names and order)."""
    short_batches(df.sparkSession)
    have, at = df.columns, {position(df, n): n for n in names}
    plain = df.toDF(*[at.get(i, f"_x{i}") for i in range(len(have))])
    return plain, lambda out: out.select(*plain.columns).toDF(*have)


def take_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name (else by the first name
    equal but for case).  Extra columns never clash.  Texts then go to Python
    in short batches (:func:`short_batches`)."""
    short_batches(df.sparkSession)
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{position(df, n)}").alias(n) for n in names])


def read_table(spark, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return take_columns(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *columns)


def groups_for(docs: DataFrame, most: int) -> int:
    """Into how many groups work on the texts is dealt: one for ``most`` of
    their bytes, at least as many as the session shuffles into."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[first:last], offsets - first


def pieces(batches: Iterator[pa.RecordBatch], text: str,
           most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``most`` text bytes, so the
    numpy arrays of a task stay small whatever the batch size; rows stay
    whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to
        del batch
    give_back()
