"""Functions of Arrow batches over tables with any column names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """df.mapInArrow, by position: names with dots or quotes, and repeated ones, do no harm on the way."""
    plain = T.StructType([T.StructField(f"_{i}", x.dataType, x.nullable) for i, x in enumerate(schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in f(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain.names)

    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).mapInArrow(run, plain).toDF(*schema.names)
