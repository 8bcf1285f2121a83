"""Rules that depend on the order of a key's rows, folded while the rows stream by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_in_order(rows: DataFrame, key: str, order: list[str], reads: list[str], step: Callable[..., tuple[object, tuple]], made: dict[str, T.DataType]) -> DataFrame:
    """rows with the columns `made`, from step(state, values of the columns `reads` ..) to (state, values), where the state of a key's first row is None.

    Keys are dealt to tasks and sorted there; a task reads its rows a batch at a time and holds one state, whatever the rows of a key. They are dealt by a
    hash of the key: by the key itself Spark would leave the exchange out behind a join on it, and then split a large key's rows over tasks as the join's skew.
    """
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, t) for c, t in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for own, *read in zip(*(batch.column(c).to_pylist() for c in (key, *reads)), strict=True):
                if not begun or own != current:
                    state, current, begun = None, own, True
                state, values = step(state, *read)
                out.append(values)
            columns = [pa.array([v[i] for v in out], T_ARROW[type(t)]) for i, t in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *made])

    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


T_ARROW = {T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.LongType: pa.int64()}
