"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.session import use_shared_checkpoints

# Bytes -> bytes: A-Z in lower case, everything but letters, digits and non-ASCII bytes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BATCH_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names given; whatever else the table carries cannot clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def octets(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def mapped(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """``step`` on bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read again: lost executors do not replay it, and
    later steps read the columns they need, compressed."""
    spark = df.sparkSession
    use_shared_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Empties the folder of a stored step that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
