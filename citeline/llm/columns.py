"""Adding results to rows without touching the columns they came with."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citeline.llm.words import bounded_batches, units


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_struct(
    df: DataFrame,
    text: str,
    name: str,
    kind: str,
    make: Callable[[], Callable[..., pa.Array]],
    spent: str | None = None,
) -> DataFrame:
    """``df`` with a column ``name`` of DDL type ``kind``, computed from the
    texts of ``text`` by Arrow tasks.

    ``make`` is called once per task and returns a function of the bytes and
    offsets of some texts, and of the column ``spent`` if one is named, which
    is used up. A column that already has the name is replaced; all
    others pass through unchanged, whatever they are called.
    """
    rest = df.drop(name)
    fields = T._parse_datatype_string(kind)
    schema = T.StructType(
        [*(f for f in rest.schema.fields if f.name != spent), T.StructField(name, fields)]
    )
    names = [c for c in rest.columns if c != spent]

    def run(batches):
        compute = make()
        for batch in batches:
            for rows, data, offsets in units(batch, text):
                more = [] if spent is None else [rows.column(spent)]
                result = compute(data, offsets, *more)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in names), result], names=[*names, name]
                )

    return bounded_batches(rest).mapInArrow(run, schema)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list array with counts[i] of the values in row i."""
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values
    )

