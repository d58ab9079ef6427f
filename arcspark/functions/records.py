"""Tagged binary records: a StructType's fields by number, unset ones left out.

A record is a version byte (outermost only), then for each set field its
number and value, then -1; numbers are variable-length. A field's number is
its place in the struct, from 1, unless its metadata gives ``id``; integers
whose metadata says ``{"wire": "v"}`` are variable-length too.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from arcspark.functions.codec import vlong_decode, vlong_encode

VERSION = b"\x01"
_FIXED = {T.BooleanType: "?", T.ByteType: "b", T.IntegerType: ">i", T.LongType: ">q", T.FloatType: ">f", T.DoubleType: ">d"}


def _number(schema: T.StructType, i: int) -> int:
    return schema.fields[i].metadata.get("id", i + 1)


def _put(kind: T.DataType, value, wire: str | None) -> bytes:
    if wire == "v":
        return vlong_encode(int(value))
    if type(kind) in _FIXED:
        return struct.pack(_FIXED[type(kind)], value)
    if isinstance(kind, T.StringType):
        data = value.encode("utf-8", "surrogatepass")
        return vlong_encode(len(data)) + data
    if isinstance(kind, T.BinaryType):
        return struct.pack(">i", len(value)) + bytes(value)
    if isinstance(kind, T.ArrayType):
        return struct.pack(">i", len(value)) + b"".join(_put(kind.elementType, v, wire) for v in value)
    if isinstance(kind, T.MapType):
        return struct.pack(">i", len(value)) + b"".join(_put(kind.keyType, k, None) + _put(kind.valueType, v, None) for k, v in sorted(value.items()))
    if isinstance(kind, T.StructType):
        return _fields(kind, value)
    raise TypeError(kind)


def _fields(schema: T.StructType, row: dict) -> bytes:
    out = b"".join(vlong_encode(_number(schema, i)) + _put(f.dataType, row[f.name], f.metadata.get("wire")) for i, f in enumerate(schema.fields) if row.get(f.name) is not None)
    return out + vlong_encode(-1)


def encode(schema: T.StructType, row: dict) -> bytes:
    return VERSION + _fields(schema, row)


def _get(kind: T.DataType, data: bytes, at: int, wire: str | None):
    if wire == "v":
        return vlong_decode(data, at)
    if type(kind) in _FIXED:
        layout = _FIXED[type(kind)]
        return struct.unpack_from(layout, data, at)[0], at + struct.calcsize(layout)
    if isinstance(kind, T.StringType):
        n, at = vlong_decode(data, at)
        return data[at : at + n].decode("utf-8", "replace"), at + n
    if isinstance(kind, T.StructType):
        return _read(kind, data, at)
    n, at = struct.unpack_from(">i", data, at)[0], at + 4
    if isinstance(kind, T.BinaryType):
        return data[at : at + n], at + n
    if isinstance(kind, T.ArrayType):
        items = []
        for _ in range(n):
            item, at = _get(kind.elementType, data, at, wire)
            items.append(item)
        return items, at
    if isinstance(kind, T.MapType):
        pairs = {}
        for _ in range(n):
            key, at = _get(kind.keyType, data, at, None)
            pairs[key], at = _get(kind.valueType, data, at, None)
        return pairs, at
    raise TypeError(kind)


def _read(schema: T.StructType, data: bytes, at: int) -> tuple[dict, int]:
    by_number = {_number(schema, i): f for i, f in enumerate(schema.fields)}
    row = dict.fromkeys(schema.fieldNames())
    while True:
        number, at = vlong_decode(data, at)
        if number == -1:
            return row, at
        if number not in by_number:
            raise ValueError(f"no field {number}")
        f = by_number[number]
        row[f.name], at = _get(f.dataType, data, at, f.metadata.get("wire"))


def decode(schema: T.StructType, data: bytes) -> dict:
    """The record's fields; those it doesn't set are None."""
    return _read(schema, data, len(VERSION))[0]


def struct_encode(schema: T.StructType, row: Column) -> Column:
    """STRUCT -> BINARY, nested structs, arrays and maps too; a null struct gives null. Values keep their types: no floats for nulls."""

    @F.arrow_udf(T.BinaryType())
    def pack(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else encode(schema, _plain(schema, r)) for r in rows.to_pylist()], pa.binary())

    return pack(row)


def _bare(kind: T.DataType) -> T.DataType:
    """The type without its fields' metadata, which Arrow has no place for."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _bare(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_bare(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_bare(kind.keyType), _bare(kind.valueType), kind.valueContainsNull)
    return kind


def _plain(kind: T.DataType, value):
    """Arrow's maps, lists of pairs, as dictionaries."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _plain(f.dataType, value[f.name]) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_plain(kind.elementType, v) for v in value]
    if isinstance(kind, T.MapType):
        return {k: _plain(kind.valueType, v) for k, v in (value.items() if isinstance(value, dict) else value)}
    return value


def struct_decode(schema: T.StructType, data: Column) -> Column:
    """BINARY -> STRUCT; null gives null."""
    bare = _bare(schema)
    kind = to_arrow_type(bare)

    @F.arrow_udf(bare)
    def unpack(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else decode(schema, v) for v in values.to_pylist()], kind)

    return unpack(data)
