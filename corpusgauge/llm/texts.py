"""Running a numpy function over every whole text of a column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusgauge.llm.codes import text_slices

PA = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}


def per_row(df: DataFrame, text: str, add: dict[str, T.DataType], of: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], keep_text: bool = False) -> DataFrame:
    """``df`` with columns made from its text column, one value for each row.

    ``of(bytes, offsets)`` gets a run of whole texts as UTF-8 bytes (a null is
    empty) and returns an array for each added column. The text column goes
    unless ``keep_text``. Columns of ``df`` named like an added one are replaced.
    """
    kept = [c for c in df.columns if c not in add and (keep_text or c != text)]
    fields = [df.schema[c] for c in kept] + [T.StructField(c, t) for c, t in add.items()]
    kinds = {c: PA[t] for c, t in add.items()}
    source = df.select(text, *[c for c in kept if c != text])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {c: [] for c in kinds}
            column = batch.column(0)
            for _, buf, offs in text_slices(column):
                for c, values in of(buf, offs).items():
                    made[c].append(values)
            if batch.num_rows:
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                arrays += [pa.array(np.concatenate(made[c])).cast(k) for c, k in kinds.items()]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *kinds])

    return source.mapInArrow(run, T.StructType(fields))


def per_text_rows(df: DataFrame, key: list[str], text: str, schema: T.StructType, of: Callable[[np.ndarray, np.ndarray, int], dict[str, np.ndarray]]) -> DataFrame:
    """Any number of rows for each text.

    ``of`` returns the array ``row`` (index of the text in its run) beside
    those of ``schema``; the key columns are taken along.
    """
    fields = [df.schema[c] for c in key] + list(schema.fields)
    names = schema.fieldNames()
    arrow = {f.name: PA[f.dataType] for f in schema.fields}
    source = df.select(text, *[c for c in key if c != text])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offs in text_slices(batch.column(0)):
                made = of(buf, offs)
                at = pa.array(made["row"] + row)
                if len(at):
                    arrays = [batch.column(batch.schema.get_field_index(c)).take(at) for c in key]
                    arrays += [pa.array(made[c]).cast(arrow[c]) for c in names]
                    yield pa.RecordBatch.from_arrays(arrays, [*key, *names])

    return source.mapInArrow(run, T.StructType(fields))
