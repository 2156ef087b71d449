"""Functions of rows in Python that hold a few rows at a time, whatever an Arrow batch holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: So many rows are Python objects at once; a batch stays in Arrow's form.
ROWS = 64


def by_row(run: Callable, kind: str, rows: int = ROWS) -> Callable[..., Column]:
    """A column function that calls ``run`` with the values of a row: strings, numbers, lists and dictionaries."""
    made = to_arrow_type(DataType.fromDDL(kind))

    def slices(batch: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
        for i in range(0, len(batch[0]), rows):
            yield pa.array([run(*row) for row in zip(*(c.slice(i, rows).to_pylist() for c in batch))], made)

    @F.arrow_udf(kind)
    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from slices(batch)

    @F.arrow_udf(kind)
    def single(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from slices((batch,))

    return lambda *columns: (several if len(columns) > 1 else single)(*columns)
