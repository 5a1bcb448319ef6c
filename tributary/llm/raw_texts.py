"""Columns computed from whole texts, read as UTF-8 bytes a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A task hands over results whenever it has read so many bytes; a longer text is a hand-over of its own.
PART_BYTES = 4 << 20


def parts(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch in order, null as empty, in lists of about PART_BYTES."""
    held, size = [], 0
    for scalar in column.cast(pa.binary()):
        raw = scalar.as_py() or b""
        held.append(raw)
        size += len(raw)
        if size >= PART_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def add_columns(docs: DataFrame, text: str, added: str, make: Callable[[], Callable[[list[bytes]], list[tuple]]]) -> DataFrame:
    """``docs`` without ``text``, with the columns ``added`` (a schema as text); columns of these names are replaced.

    ``make`` is called once per task and gives the function that turns texts into one tuple of values per text.
    """
    fields = T.StructType.fromDDL(added)
    others = [c for c in docs.columns if c not in (text, *fields.names)]
    names, types = [*others, *fields.names], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = 0
            for texts in parts(batch.column(batch.num_columns - 1)):
                columns = zip(*work(texts))
                made = [pa.array(list(c), t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns[:-1], *made], names=names)
                at += len(texts)

    schema = T.StructType([*[docs.schema[c] for c in others], *fields])
    return docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, schema)
