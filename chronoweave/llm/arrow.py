"""Helpers for operators that read texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are turned into Python objects at once.
ROWS = 256


def with_id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as an empty one; other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], list[pa.Array]]], schema: str, fields: list[str]) -> DataFrame:
    """Per slice of (doc_id, text): the columns that make()'s function returns; make runs once in each task."""

    def run(batches):
        work = make()
        for part in slices(batches):
            out = work(part.column(0).to_pylist(), part.column(1).to_pylist())
            if out is not None:
                yield pa.RecordBatch.from_arrays(out, names=fields)

    return df.mapInArrow(run, schema)
