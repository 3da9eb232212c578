"""Arrow helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.session import ship


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null becomes the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column without decoding; null becomes empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow with per-task state: make() builds the batch function once a task.

    The batch function returns columns by name in the order of `schema`; rows
    go out in the batches in which they came, so memory stays at one batch.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces_of(batch):
                out = work(part)
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(target, (out[f.name] for f in target), strict=True)],
                    schema=target,
                )

    return map_arrow(df, run, schema)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def pieces_of(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows, so that Python objects exist for few texts at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
