"""Arrow plumbing for the operators that need Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleanery.session import map_arrow, spread


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def map_batches(df: DataFrame, ddl: str, setup: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """``mapInArrow`` whose ``setup`` runs once a task and returns a function from a batch to its output columns."""
    out = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, step = to_arrow_schema(out), None
        for batch in batches:
            if not batch.num_rows:
                continue
            step = step or setup()
            columns = step(batch)
            arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return map_arrow(spread(df), run, out)
