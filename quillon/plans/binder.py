"""A parsed query and a mapping, bound to columns: what matches, and what each match scores.

A bound node has `match` (never null: a missing field matches nothing, also under negation) and `score` (0
where it does not match). Scores need statistics of the collection; binding first collects which, one
aggregation pass gets them all, and only then are score columns made.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import ValidationError
from quillon.functions import analyzer, scoring
from quillon.mapping import ID, Mapping, tokens_of
from quillon.plans.tree import All, Bool, Boost, Exists, Node, Nothing, OneOf, Range, Term

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
RANGES = {"i64": (-(1 << 63), (1 << 63) - 1)}


def parse_date(text: str) -> datetime.datetime:
    """An RFC 3339 instant in UTC, cut to microseconds; ValueError for anything else."""
    if not re.fullmatch(RFC3339, text) or text[10] == " ":
        raise ValueError(f"{text!r} is no RFC 3339 date")
    text = re.sub(r"\.(\d+)", lambda m: "." + m[1][:6].ljust(6, "0"), text.upper())
    second = text[17:19]
    if second == "60":  # a leap second
        text = text[:17] + "59" + text[19:]
    return datetime.datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(datetime.UTC)


@dataclass
class Stats:
    """Documents with the field, mean tokens of text fields, documents with each term."""

    n: dict[str, int]
    average: dict[str, float]
    df: dict[tuple[str, str], int]


@dataclass
class Bound:
    match: Column
    score: Callable[[Stats], Column]
    terms: tuple[tuple[str, str], ...] = ()


def false() -> Column:
    return F.lit(False)


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def either(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else false()


def both(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)


def plus(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) if columns else F.lit(0.0)


class Binder:
    def __init__(self, mapping: Mapping):
        self.mapping = mapping

    def spec(self, name: str):
        if name == ID:
            return None
        spec = self.mapping.indexed(name)
        if spec is None:
            raise ValidationError(f"invalid query: {name!r} is no indexed field")
        return spec

    def bind(self, node: Node) -> Bound:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def literal(self, name: str, kind: str, text: str):
        try:
            if kind == "i64":
                if not re.fullmatch(r"[+-]?\d+", text):
                    raise ValueError
                value = int(text)
                if not RANGES["i64"][0] <= value <= RANGES["i64"][1]:
                    raise ValueError
                return F.lit(value).cast("long")
            if kind == "f64":
                value = float(text)
                if value in (float("inf"), float("-inf")) or value != value:
                    raise ValueError
                return F.lit(value)
            if kind == "date":
                return F.lit(parse_date(text))
        except ValueError:
            raise ValidationError(f"invalid query: {text!r} is no {kind} for field {name!r}") from None
        return F.lit(text)

    def _constant(self, match: Column) -> Bound:
        return Bound(match, lambda _: F.when(match, F.lit(1.0)).otherwise(F.lit(0.0)))

    def _all(self, node: All) -> Bound:
        return self._constant(F.lit(True))

    def _nothing(self, node: Nothing) -> Bound:
        return self._constant(false())

    def _exists(self, node: Exists) -> Bound:
        self.spec(node.field)
        return self._constant(F.col(f"`{node.field}`").isNotNull())

    def _boost(self, node: Boost) -> Bound:
        inner = self.bind(node.node)
        return Bound(inner.match, lambda s: inner.score(s) * F.lit(node.factor), inner.terms)

    def _bool(self, node: Bool) -> Bound:
        must, must_not, should = ([self.bind(n) for n in part] for part in (node.must, node.must_not, node.should))
        match = both([b.match for b in must]) if must else either([b.match for b in should])
        if must_not:
            match = match & ~either([b.match for b in must_not])
        scored = must + should
        return Bound(match, lambda s: F.when(match, plus([b.score(s) for b in scored])).otherwise(F.lit(0.0)), tuple(t for b in scored for t in b.terms))

    def _term(self, node: Term) -> Bound:
        if node.field is not None:
            return self._field_term(node.field, node)
        fields = self.mapping.default_fields()
        if not fields:
            raise ValidationError("invalid query: the mapping has no default field, so a term needs one")
        parts = [self._field_term(f, node) for f in fields]
        return Bound(either([p.match for p in parts]), lambda s: plus([p.score(s) for p in parts]), tuple(t for p in parts for t in p.terms))

    def _field_term(self, name: str, node: Term) -> Bound:
        spec = self.spec(name)
        if name == ID:
            return self._constant(sure(F.col(ID) == node.text))
        column = F.col(f"`{name}`")
        if spec.type != "text":
            match = sure(column == self.literal(name, spec.type, node.text))
            key = (name, node.text)
            return Bound(match, lambda s: F.when(match, F.lit(scoring.idf(s.n[name], s.df[key]))).otherwise(F.lit(0.0)), (key,))
        words = analyzer.analyze(node.text)
        if not words:
            return self._constant(false())
        tokens = F.col(f"`{tokens_of(name)}`")
        keys = tuple((name, w) for w in words)
        if len(words) == 1 and not node.prefix:
            match = sure(F.array_contains(tokens, words[0]))
            tf = analyzer.occurrences(tokens, words[0])
        elif node.prefix:
            start = " " + "  ".join(words)
            match = sure(F.contains(analyzer.padded(tokens), F.lit(start)))
            return self._constant(match)
        elif node.slop:
            match = sure(both([F.array_contains(tokens, w) for w in sorted(set(words))]) & analyzer.near(tokens, words, node.slop))
            tf = F.lit(1)
        else:
            match = sure(F.contains(analyzer.padded(tokens), F.lit(analyzer.phrase(words))))
            tf = analyzer.phrase_occurrences(tokens, words)

        def score(s: Stats) -> Column:
            weight = sum(scoring.idf(s.n[name], s.df[k]) for k in keys)
            return F.when(match, scoring.bm25(tf, F.size(tokens), s.average[name], weight)).otherwise(F.lit(0.0))

        return Bound(match, score, keys)

    def _range(self, node: Range) -> Bound:
        spec = self.spec(node.field)
        low = None if node.low is None else self.literal(node.field, spec.type, node.low) if spec else F.lit(node.low)
        high = None if node.high is None else self.literal(node.field, spec.type, node.high) if spec else F.lit(node.high)

        def inside(c: Column) -> Column:
            tests = []
            if low is not None:
                tests.append(c >= low if node.low_in else c > low)
            if high is not None:
                tests.append(c <= high if node.high_in else c < high)
            return both(tests) if tests else c.isNotNull()

        if spec and spec.type == "text":
            return self._constant(sure(F.exists(F.col(f"`{tokens_of(node.field)}`"), inside)))
        return self._constant(sure(inside(F.col(f"`{node.field}`"))))

    def _oneof(self, node: OneOf) -> Bound:
        spec = self.spec(node.field)
        if spec and spec.type == "text":
            words = sorted({w for v in node.values for w in analyzer.analyze(v)})
            tokens = F.col(f"`{tokens_of(node.field)}`")
            return self._constant(sure(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))) if words else false())
        values = [self.literal(node.field, spec.type if spec else "keyword", v) for v in node.values]
        return self._constant(sure(F.col(f"`{node.field}`").isin(*values)) if values else false())


def statistics(docs: DataFrame, mapping: Mapping, terms: tuple[tuple[str, str], ...]) -> Stats:
    """One aggregation over the collection, partial on the executors; one row of sums reaches the driver."""
    fields, terms = sorted({f for f, _ in terms}), sorted(set(terms))
    if not terms:
        return Stats({}, {}, {})
    binder, sums = Binder(mapping), []
    for i, f in enumerate(fields):
        text = mapping.fields[f].type == "text"
        c = F.col(f"`{tokens_of(f) if text else f}`")
        sums.append(F.count(c).alias(f"n{i}"))
        sums.append((F.avg(F.when(c.isNotNull(), F.size(c))) if text else F.lit(1.0)).alias(f"a{i}"))
    for i, (f, t) in enumerate(terms):
        spec = mapping.fields[f]
        hit = F.array_contains(F.col(f"`{tokens_of(f)}`"), t) if spec.type == "text" else F.col(f"`{f}`") == binder.literal(f, spec.type, t)
        sums.append(F.count_if(sure(hit)).alias(f"d{i}"))
    row = docs.agg(*sums).first()
    return Stats({f: row[f"n{i}"] for i, f in enumerate(fields)}, {f: float(row[f"a{i}"] or 0.0) for i, f in enumerate(fields)}, {t: row[f"d{i}"] for i, t in enumerate(terms)})
