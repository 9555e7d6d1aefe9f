"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.sources.storage import saved, scratch, shared_dir  # noqa: F401

#: The ASCII white space that the contracts name: \x20 and \x09 to \x0D.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words are runs of anything but ASCII white space."""
    return F.array_remove(F.split(F.btrim(text, F.lit(WHITE)), WHITE_RUN), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts without other letters take the faster built-in, with the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def map_texts(rows: DataFrame, per_text: Callable[[str], tuple], schema: str) -> DataFrame:
    """per_text of every row, in Arrow batches. rows: an id and a text (null: empty); schema: the id's field, then the results'."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [per_text(t.as_py() or "") for t in batch.column(1)]  # one text at a time is a Python string
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    fields = T.StructType.fromDDL(schema)
    names, types = fields.names, [to_arrow_type(f.dataType) for f in fields[1:]]
    return rows.select(F.col(rows.columns[0]).cast("bigint"), F.col(rows.columns[1]).cast("string")).mapInArrow(batches, schema)
