"""Tagged records: round trips and layout."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcspark import idl
from arcspark.functions import records

INNER = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.StringType())])
ROW = T.StructType([
    T.StructField("i", T.IntegerType()), T.StructField("v", T.LongType(), True, {"wire": "v"}), T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType()),
    T.StructField("l", T.ArrayType(T.StringType())), T.StructField("m", T.MapType(T.StringType(), T.LongType())), T.StructField("n", INNER), T.StructField("t", T.BooleanType(), True, {"id": 40}),
])


def test_round_trip():
    row = {"i": -5, "v": 1 << 40, "s": "é", "b": b"\0\1", "l": ["a", ""], "m": {"b": 2, "a": 1}, "n": {"x": 0.5, "y": None}, "t": True}
    assert records.decode(ROW, records.encode(ROW, row)) == row
    assert records.encode(ROW, {"i": 7}) == b"\x01" + b"\x01" + b"\0\0\0\x07" + b"\xff"
    assert records.decode(ROW, b"\x01\xff") == dict.fromkeys(ROW.fieldNames())
    with pytest.raises(ValueError):
        records.decode(ROW, b"\x01\x63\xff")


def test_columns(spark):
    flat = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType())])
    rows = spark.createDataFrame([(1, "a"), (2, "b")], flat)
    packed = rows.select("*", records.struct_encode(flat, F.struct("k", "s")).alias("p"))
    back = packed.select("k", "s", records.struct_decode(flat, F.col("p")).alias("r"))
    assert back.where("k <> r.k OR s <> r.s").isEmpty() and back.count() == 2


def test_columns_with_nulls_and_nested_values(spark):
    rows = [(-5, 1 << 62, None, b"\0", ["a", None][:1], {"b": 2, "a": 1}, (0.5, None), True), (None, None, "é", None, None, None, None, None), (1, -(1 << 60) - 1, "", b"", [], {}, (None, "y"), False)]
    df = spark.createDataFrame(rows, ROW)
    packed = df.select(records.struct_encode(ROW, F.struct("*")).alias("p"))
    back = packed.select(records.struct_decode(ROW, F.col("p")).alias("r")).select("r.*")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert spark.createDataFrame([(None,)], "p binary").select(records.struct_decode(ROW, F.col("p")).alias("r")).first().r is None


DESCRIPTION = """
// a description
include "other.jr";
module a.b {
  class Inner [nodirty] { double x = 1; ustring y = 2; }
  class Item [recordid] {
    enum Kind { ONE = 1; TWO = 2; }
    Kind kind = 1;
    [key] vlong at = 2;
    ustring name = 3 ;
    vector<ustring> words = 4;
    map<ustring, long> counts = 5;
    Inner inner = 6; /* nested */
    [transient] int cached = 7;
    comparator byName { name; at; }
  }
  service S { method m(in Item, out Item); }
}
"""


def test_description():
    found = idl.parse(DESCRIPTION)
    item = found["Item"]
    assert item.enums == {"Kind": {"ONE": 1, "TWO": 2}} and item.keys == ["at"] and item.orders == {"byName": ["name", "at"]} and item.transient == ["cached"]
    assert not found["Inner"].tracks_presence and not found["Inner"].schema["x"].nullable
    assert item.schema["inner"].dataType == found["Inner"].schema and item.schema["at"].metadata == {"id": 2, "wire": "v"}
    fields = idl.fixed_fields(item)
    assert fields.fieldNames() == ["kind", "at", "name", "words", "counts", "inner"]
    row = {"kind": 2, "at": 1 << 40, "name": "n", "words": ["x"], "counts": {"a": 1}, "inner": {"x": 1.5, "y": "z"}}
    assert records.decode(fields, records.encode(fields, row)) == row
    for bad in ("class X {}", "module m { class X { unknown y = 1; } }", "module m { class X { X y = 1; } }", "module m { class X {"):
        with pytest.raises(idl.IdlError):
            idl.parse(bad)
