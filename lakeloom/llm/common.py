"""What several operators share: batch sizes, table reading, text columns as raw bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeloom.session import scratch_path

# Rows sent to Python at once. Texts may be long, so a batch is kept short.
BATCH_ROWS = "512"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Let Python workers get short batches, unless the session sets its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_ROWS)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column one after another, and the n + 1 offsets. Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each text of a string column as UTF-8. Null is empty."""
    data, offsets = utf8(column)
    raw = data.tobytes()
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield raw[start:end]


# Letters a-z, digits and all bytes of other alphabets stay, A-Z are lowered, the rest parts words.
_WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
    for b in range(256)
)


def draw_bound(rows: int, held: int) -> int:
    """The largest 64-bit hash that is drawn where about ``rows`` of ``held`` are wanted, and never none."""
    return min(2**63 - 1, (rows << 64) // max(held, 1) - 2**63)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z."""
    return text.translate(_WORD_BYTES).split()
