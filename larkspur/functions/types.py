"""Struct types from short texts, without a running session, and Arrow columns of texts in bounded slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

#: Bytes of text, and rows, that a worker turns into Python's objects at a time; a longer text goes alone.
BYTES, ROWS = 1 << 20, 1024

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType())}


def struct(fields: str) -> T.StructType:
    """``name type, name type`` as a struct of nullable fields."""
    return T.StructType([T.StructField(*(name, _TYPES[kind])) for name, kind in (f.split() for f in fields.split(", "))])


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<float>": pa.list_(pa.float32())}


def struct_array(fields: str, rows: list[tuple]) -> pa.StructArray:
    """Rows as an Arrow column of that struct; NaN and null stay apart."""
    names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def slices(batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """A column's batches in parts of at most ``ROWS`` rows and about ``BYTES`` bytes, whatever the length of its texts."""
    for texts in batches:
        sizes, start, held = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > BYTES or i - start == ROWS):
                yield texts.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield texts.slice(start)
