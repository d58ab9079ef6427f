"""Record descriptions -> Spark schemas.

A description file holds modules of classes, enums, comparators and services.
``parse`` gives each class as a ``Record``: a StructType whose fields' numbers
(and variable-length marks) stand in their metadata, as ``functions.records``
reads them, with its key fields, orders and enumerated values. Services have
no meaning under Spark and are read past.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The plain types of the language.
PLAIN = {
    "byte": T.ByteType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "vint": T.IntegerType(), "long": T.LongType(), "vlong": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "ustring": T.StringType(), "buffer": T.BinaryType(),
}
VARIABLE = ("vint", "vlong")

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|([A-Za-z_][\w.]*|-?\d+|\"[^\"]*\"|[{}\[\]<>(),;=])|\s+", re.S)


@dataclass
class Record:
    name: str
    schema: T.StructType = field(default_factory=T.StructType)
    keys: list[str] = field(default_factory=list)
    orders: dict[str, list[str]] = field(default_factory=dict)
    enums: dict[str, dict[str, int]] = field(default_factory=dict)
    transient: list[str] = field(default_factory=list)
    #: Has presence marks for its fields; without them no field may be null.
    tracks_presence: bool = True


class IdlError(ValueError):
    """A description that can't be read."""


class _Reader:
    def __init__(self, text: str, known: dict[str, Record]):
        self.tokens = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise IdlError(f"unreadable at {text[at : at + 20]!r}")
            if m[1]:
                self.tokens.append(m[1])
            at = m.end()
        self.at, self.records = 0, known

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self, *wanted: str) -> str:
        token = self.peek()
        if not token or wanted and token not in wanted:
            raise IdlError(f"{' or '.join(wanted) or 'more'} expected, not {token or 'the end'!r}")
        self.at += 1
        return token

    def flags(self) -> list[str]:
        """Words in brackets, if any."""
        found = []
        while self.peek() == "[":
            self.next("[")
            while self.peek() != "]":
                if (token := self.next()) != ",":
                    found.append(token)
            self.next("]")
        return found

    def block(self) -> None:
        """Reads past a block in braces."""
        self.next("{")
        depth = 1
        while depth:
            depth += {"{": 1, "}": -1}.get(self.next(), 0)

    def file(self) -> None:
        while self.peek():
            word = self.next()
            if word in ("include", "import"):
                self.next()
                if self.peek() == ";":
                    self.next()
            elif word == "module":
                self.next()
                self.next("{")
                while self.peek() != "}":
                    self.member()
                self.next("}")
            else:
                raise IdlError(f"module expected, not {word!r}")

    def member(self) -> None:
        word = self.next("class", "service", "enum", ";")
        if word == "class":
            self.record()
        elif word == "service":
            self.next()
            self.block()
        elif word == "enum":
            self.enum(Record(""))

    def record(self) -> None:
        out = Record(self.next())
        flags = self.flags()
        out.tracks_presence = not {"nodirty", "raw"} & set(flags)
        if "recordid" in flags:
            out.schema.add("record_id", T.LongType(), True, {"transient": True})
        self.records[out.name] = out  # a record may hold itself
        self.next("{")
        while self.peek() != "}":
            if self.peek() == "enum":
                self.next()
                self.enum(out)
            elif self.peek() == "comparator":
                self.next()
                self.order(out)
            elif self.peek() == ";":
                self.next()
            else:
                self.field(out)
        self.next("}")

    def enum(self, owner: Record) -> None:
        values = owner.enums.setdefault(self.next(), {})
        self.next("{")
        while self.peek() != "}":
            name = self.next()
            self.next("=")
            values[name] = int(self.next())
            if self.peek() in (",", ";"):
                self.next()
        self.next("}")

    def order(self, owner: Record) -> None:
        fields = owner.orders.setdefault(self.next(), [])
        self.next("{")
        while self.peek() != "}":
            if (token := self.next()) != ";":
                fields.append(token)
        self.next("}")

    def kind(self, owner: Record) -> tuple[T.DataType, bool]:
        word = self.next()
        if word in PLAIN:
            return PLAIN[word], word in VARIABLE
        if word == "vector":
            self.next("<")
            item, variable = self.kind(owner)
            self.next(">")
            return T.ArrayType(item), variable
        if word == "map":
            self.next("<")
            key, _ = self.kind(owner)
            self.next(",")
            value, _ = self.kind(owner)
            self.next(">")
            return T.MapType(key, value), False
        if word in owner.enums:
            return T.IntegerType(), False
        name = word.rpartition(".")[2]
        if name == owner.name:
            raise IdlError(f"{name} holds itself: Spark has no recursive types")
        if name in self.records:
            return self.records[name].schema, False
        raise IdlError(f"unknown type {word!r}")

    def field(self, owner: Record) -> None:
        before = self.flags()
        kind, variable = self.kind(owner)
        before += self.flags()
        name = self.next()
        before += self.flags()
        number = None
        if self.peek() == "=":
            self.next("=")
            number = int(self.next())
        self.next(";")
        metadata = ({"id": number} if number is not None else {}) | ({"wire": "v"} if variable else {})
        if "transient" in before:
            owner.transient.append(name)
            metadata["transient"] = True
        if "key" in before:
            owner.keys.append(name)
        owner.schema.add(name, kind, owner.tracks_presence, metadata)


def parse(text: str, known: dict[str, Record] | None = None) -> dict[str, Record]:
    """The classes of a description, by name; ``known`` are those of descriptions it includes."""
    reader = _Reader(text, dict(known or {}))
    reader.file()
    return reader.records


def fixed_fields(record: Record) -> T.StructType:
    """The fields that are written: all but transient ones."""
    return T.StructType([f for f in record.schema.fields if not f.metadata.get("transient")])


def ordered(df: DataFrame, record: Record, order: str | None = None) -> DataFrame:
    """Rows by one of the record's named orders, or by its key fields."""
    return df.orderBy(*(record.orders[order] if order else record.keys))


def distinct_keys(df: DataFrame, record: Record) -> DataFrame:
    """One row for each value of the record's key fields."""
    return df.dropDuplicates(record.keys)
