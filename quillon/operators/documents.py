"""From source strings to typed documents: strict validation, extraction, and tables as collections."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import analyzer
from quillon.mapping import ID, SEQ, SOURCE, TYPES, Mapping, size_of, tokens_of
from quillon.plans.binder import parse_date

#: Ascending runs that are told apart in a partition; a scan's partition holds fewer files (an opened file counts as 4 MB of 128).
RUNS = 128
#: A leap is longer than so many steps of the run before it.
LEAP = 64


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _number(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("a number is out of range")
    return value


def _integer(text: str) -> int:
    _number(text)
    return int(text)


DECODER = json.JSONDecoder(parse_constant=_constant, parse_float=_number, parse_int=_integer)


def _strict(text: str):
    j = DECODER.decode(text)
    if "\\u" in text:
        json.dumps(j, ensure_ascii=False).encode()  # a lone surrogate is no character: UnicodeEncodeError
    return j


def _fits(kind: str, value) -> bool:
    if kind in ("text", "keyword"):
        return isinstance(value, str)
    if kind == "i64":
        return isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63
    if kind == "f64":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if not isinstance(value, str):
        return False
    try:
        parse_date(value)
    except ValueError:
        return False
    return True


def reason(mapping: Mapping, source: str | None) -> str | None:
    """Why the source is no document of the mapping, or None. The first field in the order of names decides."""
    try:
        j = _strict(source or "")
    except (ValueError, RecursionError):
        return "invalid JSON"
    if not isinstance(j, dict):
        return "not an object"
    for name in sorted(j):
        spec = mapping.fields.get(name)
        if spec is None:
            return f"unmapped field {name}"
        if not _fits(spec.type, j[name]):
            return f"field {name} is no {spec.type}"
    return None


def with_reason(rows: DataFrame, mapping: Mapping, source: str = SOURCE) -> DataFrame:
    """rows with a column reason (null: valid). Ingest only: JSON that trails off or repeats keys needs a strict parser."""
    schema = T.StructType([*rows.schema.fields, T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([reason(mapping, s) for s in b.column(source).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "reason"])

    return rows.mapInArrow(run, schema)


def with_places(rows: DataFrame, mapping: Mapping, source: str, order: str) -> DataFrame:
    """with_reason(), and where each valid row stands: its partition (part), the ascending run of `order` in it (run, place in run).

    A leap ends a run too, as a partition may hold files between which others lie. A partition of more runs than RUNS,
    or a row without order, has run -1 from there on; refused rows have no run.
    """
    added = [T.StructField("reason", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("run", T.IntegerType()), T.StructField("place", T.LongType())]
    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, place, first, last = TaskContext.get().partitionId(), 0, -1, None, None
        for b in batches:
            found, runs, places = [], [], []
            for s, o in zip(b.column(source).to_pylist(), b.column(order).to_pylist(), strict=True):
                found.append(reason(mapping, s))
                if found[-1] is not None:
                    runs.append(None)
                    places.append(None)
                    continue
                if at >= 0 and (o is None or o != o):
                    at = -1
                elif at >= 0 and last is not None and (o < last or place > 0 and isinstance(o, (int, float)) and o - last > LEAP * max((last - first) / place, 1)):
                    at, place = at + 1 if at < RUNS else -1, -1
                place, first, last = place + 1, first if place >= 0 else o, o
                runs.append(at)
                places.append(place)
            more = [pa.array(found, pa.string()), pa.array([part] * len(found), pa.int32()), pa.array(runs, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *(f.name for f in added)])

    return rows.mapInArrow(run, schema)


def date_column(text: Column) -> Column:
    """An RFC 3339 string as a timestamp (microseconds; a leap second is the one before it)."""
    return F.try_to_timestamp(F.regexp_replace(F.upper(text), r":60(\.|Z|[+-])", ":59$1"))


def extract(rows: DataFrame, mapping: Mapping, source: str = SOURCE, fields: list[str] | None = None) -> DataFrame:
    """rows with a typed column for each indexed or fast field (or those of fields) of a valid source, by built-in functions."""
    fields = mapping.column_fields() if fields is None else fields
    if not fields:
        return rows
    kind = lambda f: T.StringType() if mapping.fields[f].type == "date" else TYPES[mapping.fields[f].type]
    parsed = F.from_json(F.col(source), T.StructType([T.StructField(f, kind(f)) for f in fields]))
    rows = rows.withColumn("_parsed", parsed)
    for f in fields:
        c = F.col("_parsed").getField(f)
        rows = rows.withColumn(f, date_column(c) if mapping.fields[f].type == "date" else c)
    return rows.drop("_parsed")


def with_tokens(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """rows with the token arrays that search reads; a collection stores them."""
    for f in mapping.text_fields():
        rows = rows.withColumn(tokens_of(f), analyzer.tokens(F.col(f"`{f}`")))
    return rows


def to_stored(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """rows of the mapping's schema as segments hold them; no token holds a space."""
    for f in mapping.text_fields():
        c = F.col(f"`{tokens_of(f)}`")
        rows = rows.withColumn(size_of(f), F.when(c.isNotNull(), F.size(c))).withColumn(tokens_of(f), F.array_join(c, " "))
    return rows.select(*[F.col(f"`{n}`") for n in mapping.stored_schema().names])


def from_stored(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """to_stored() undone: null tokens stay null, an empty string has none. A text is taken from the source where it is read."""
    rows = extract(rows, mapping, fields=mapping.text_fields())
    for f in mapping.text_fields():
        c = F.col(f"`{tokens_of(f)}`")
        rows = rows.withColumn(tokens_of(f), F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " ")))
    return rows.select(*[F.col(f"`{n}`") for n in mapping.schema().names])


def collection_of(rows: DataFrame, mapping: Mapping, doc_id: Column, source: Column | None = None) -> DataFrame:
    """A table with typed columns of the mapping's names as a searchable collection. source: a JSON of the fields, by default."""
    fields = mapping.column_fields()
    source = F.to_json(F.struct(*[F.col(f"`{f}`") for f in mapping.fields])) if source is None and mapping.fields else source
    own = rows.select(doc_id.cast("string").alias(ID), (F.lit("{}") if source is None else source).alias(SOURCE), F.lit(0).cast("long").alias(SEQ), *[F.col(f"`{f}`").cast(TYPES[mapping.fields[f].type]).alias(f) for f in fields])
    return with_tokens(own, mapping)
