"""Arrow batches inside tasks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Tokens, or bytes of eight, that are worked on at a time.
PIECE = 500_000
#: Rows of an Arrow batch: with documents of a few kB, a few MB.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_ROWS`` rows: a worker
    holds a batch whole, however small the pieces that it works on."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(conf.get(key, "10000"))
    if held <= 0 or held > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts (or lists of tokens) are of at most
    ``most`` together, or one row: rows differ by orders of magnitude, so a number
    of rows does not bound what the work on them takes."""
    values = batch.column(column)
    kind = values.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        sizes = pc.list_value_length(values)
    elif pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind):
        sizes = pc.binary_length(values)
        most *= 8
    else:
        yield batch
        return
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
    if not len(ends):
        yield batch
