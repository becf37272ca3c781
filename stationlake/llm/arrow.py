"""Arrow helpers shared by the operators that run Python inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def add_columns(
    frame: DataFrame, inputs: list[str], fields: list[StructField], compute: Callable[..., list[pa.Array]],
    keep_inputs: bool = True,
) -> DataFrame:
    """The frame with new columns computed per Arrow batch from some of its columns.

    ``compute`` gets the input columns of a batch and returns one array per field.  A
    column of the frame with the name of a new field is replaced.  Without ``keep_inputs`` the
    input columns do not come back, so long texts travel to the Python worker only.
    """
    new = {f.name for f in fields}
    if new & set(inputs):
        raise ValueError("an input column cannot be replaced")
    base = frame.drop(*new)
    places = [base.columns.index(name) for name in inputs]
    back = [at for at in range(len(base.columns)) if keep_inputs or at not in places]
    schema = StructType([base.schema.fields[at] for at in back] + fields)
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = compute(*[batch.column(at) for at in places])
                yield pa.RecordBatch.from_arrays([batch.column(at) for at in back] + made, names=names)

    return base.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of a text column one after the other; null is the empty text."""
    for value in column:
        yield value.as_py() or ""


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
