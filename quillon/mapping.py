"""Collection mappings: an immutable, closed set of typed fields, and the rules for names.

A field is searchable only if indexed. `fast` asks for a column copy; storage here is columnar anyway, so it
has no other effect than to take part in equality and to be refused on text. Order of fields is no matter.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import MappingError, ValidationError

TYPES = {"text": T.StringType(), "keyword": T.StringType(), "i64": T.LongType(), "f64": T.DoubleType(), "date": T.TimestampType()}
ID, SOURCE, SEQ = "_id", "_source", "_seq"
#: Of the files that a collection keeps.
COMPRESSION = "zstd"


@dataclass(frozen=True)
class Field:
    type: str
    indexed: bool = False
    fast: bool = False


@dataclass(frozen=True, eq=False)
class Mapping:
    fields: MappingProxyType

    def __init__(self, fields: dict[str, Field] | None = None):
        checked = {}
        for name in sorted(fields or {}):
            spec = fields[name]
            if not name:
                raise MappingError("a field name is empty")
            if name.startswith("_"):
                raise MappingError(f"field {name!r}: names with a leading underscore are reserved")
            if spec.type not in TYPES:
                raise MappingError(f"field {name!r}: unknown type {spec.type!r}")
            if spec.type == "text" and spec.fast:
                raise MappingError(f"field {name!r}: text can't be fast")
            checked[name] = spec
        object.__setattr__(self, "fields", MappingProxyType(checked))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Mapping) and dict(self.fields) == dict(other.fields)

    def __hash__(self) -> int:
        return hash(tuple(self.fields.items()))

    def __reduce__(self):
        return Mapping, (dict(self.fields),)

    @classmethod
    def from_json(cls, text: str) -> Mapping:
        """{"fields": {name: {"type", "indexed", "fast"}}}; both flags are false where absent, a name given twice is refused."""

        def pairs(items):
            names = [k for k, _ in items]
            if len(set(names)) != len(names):
                raise MappingError("a name occurs twice")
            return dict(items)

        try:
            j = json.loads(text, object_pairs_hook=pairs)
        except ValueError as e:
            raise MappingError(f"invalid mapping: {e}") from None
        fields = j.get("fields", {}) if isinstance(j, dict) else None
        if not isinstance(fields, dict):
            raise MappingError("a mapping is an object with an object of fields")
        out = {}
        for name, spec in fields.items():
            flags = {k: spec.get(k, False) for k in ("indexed", "fast")} if isinstance(spec, dict) else {}
            if not flags or not isinstance(spec.get("type"), str) or not all(isinstance(v, bool) for v in flags.values()):
                raise MappingError(f"field {name!r}: a type and two flags are expected")
            out[name] = Field(spec["type"], **flags)
        return cls(out)

    def to_json(self) -> str:
        return json.dumps({"fields": {n: {"type": f.type, "indexed": f.indexed, "fast": f.fast} for n, f in self.fields.items()}}, sort_keys=True)

    def indexed(self, name: str) -> Field | None:
        spec = self.fields.get(name)
        return spec if spec and spec.indexed else None

    def text_fields(self) -> list[str]:
        return [n for n, f in self.fields.items() if f.type == "text" and f.indexed]

    def default_fields(self) -> list[str]:
        """The fields that a term without a field is looked up in: indexed text and keywords."""
        return [n for n, f in self.fields.items() if f.indexed and f.type in ("text", "keyword")]

    def column_fields(self) -> list[str]:
        """Fields with a typed column: those that are indexed or fast. Others are validated and live in the source only."""
        return [n for n, f in self.fields.items() if f.indexed or f.fast]

    def schema(self) -> T.StructType:
        """The committed table: id, source, sequence number, typed columns and, for indexed text, its tokens."""
        out = T.StructType([T.StructField(ID, T.StringType(), False), T.StructField(SOURCE, T.StringType()), T.StructField(SEQ, T.LongType())])
        for n in self.column_fields():
            f = self.fields[n]
            out.add(T.StructField(n, TYPES[f.type], True, {"type": f.type, "indexed": f.indexed, "fast": f.fast}))
        for n in self.text_fields():
            out.add(T.StructField(tokens_of(n), T.ArrayType(T.StringType())))
        return out

    def stored_schema(self) -> T.StructType:
        """How segments hold it: of an indexed text the tokens as one string, a space between them, and their number.

        A string costs a fraction of an array's elements; the text itself is in the source.
        """
        texts = self.text_fields()
        out = T.StructType([f for f in self.schema() if f.name not in {*texts, *map(tokens_of, texts)}])
        for n in texts:
            out.add(T.StructField(tokens_of(n), T.StringType())).add(T.StructField(size_of(n), T.IntegerType()))
        return out

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = [(n, f.type, f.indexed, f.fast) for n, f in self.fields.items()]
        return spark.createDataFrame(rows, "field string, type string, indexed boolean, fast boolean")


def tokens_of(field: str) -> str:
    """The column that holds a text field's tokens."""
    return f"_tokens_{field}"


def size_of(field: str) -> str:
    """The column that holds their number in a segment."""
    return f"_size_{field}"


NAME = r"^[a-z0-9-][a-z0-9_-]*$"


def valid_name(name: Column) -> Column:
    """1 to 255 bytes of a-z, 0-9, - and _, not starting with _."""
    return F.coalesce(name.rlike(NAME) & ~name.contains("\n") & (F.octet_length(name) <= 255), F.lit(False))


def check_name(name: str) -> str:
    ok = name and len(name) <= 255 and name[0] != "_" and all(c in "abcdefghijklmnopqrstuvwxyz0123456789_-" for c in name)
    if not ok:
        raise ValidationError(f"collection name {name!r} is not 1 to 255 of a-z, 0-9, - and _, or starts with _")
    return name
