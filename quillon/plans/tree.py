"""Nodes of a parsed query."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    field: str | None
    text: str
    quoted: bool = False
    slop: int = 0
    prefix: bool = False


@dataclass(frozen=True)
class Range:
    field: str
    low: str | None
    high: str | None
    low_in: bool = True
    high_in: bool = True


@dataclass(frozen=True)
class OneOf:
    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class Exists:
    field: str


@dataclass(frozen=True)
class Boost:
    node: Node
    factor: float


@dataclass(frozen=True)
class Bool:
    must: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()


Node = Term | Range | OneOf | All | Nothing | Exists | Boost | Bool
