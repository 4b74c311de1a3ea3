"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any
    type: str
    text: str = ""


@dataclass(frozen=True)
class Name:
    name: str
    text: str = ""


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    text: str = ""


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any
    text: str = ""


@dataclass(frozen=True)
class Not:
    arg: Any
    text: str = ""


@dataclass(frozen=True)
class Minus:
    arg: Any
    text: str = ""


@dataclass(frozen=True)
class Member:
    base: Any
    key: Any  # a field's name, or an expression
    text: str = ""


@dataclass(frozen=True)
class In:
    op: str
    left: Any
    items: tuple
    text: str = ""


@dataclass(frozen=True)
class Between:
    negated: bool
    arg: Any
    low: Any
    high: Any
    text: str = ""


@dataclass(frozen=True)
class Sub:
    """A tabular expression in a scalar place: toscalar(q), in (q)."""

    query: Any
    text: str = ""


@dataclass(frozen=True)
class Type:
    name: str
    text: str = ""


@dataclass(frozen=True)
class Star:
    text: str = "*"


@dataclass(frozen=True)
class Item:
    """An expression with the name it is given, if any."""

    name: str | None
    expr: Any


@dataclass
class Op:
    kind: str
    args: dict = field(default_factory=dict)


@dataclass
class Query:
    source: Op
    ops: list[Op]


@dataclass
class Let:
    name: str
    value: Any  # an expression, a Query or a Function


@dataclass
class Function:
    params: list[tuple]  # name, type or list of columns, default
    body: str


@dataclass
class Command:
    kind: str
    args: dict
    ops: list[Op] = field(default_factory=list)
