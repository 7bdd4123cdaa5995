"""Indicators by name: category, builder, input columns and defaults."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .expr import E

COLUMNS = ("open_", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Op:
    name: str
    category: str
    build: Callable[..., dict[str, E]]
    columns: tuple[str, ...]
    optional: tuple[str, ...]
    defaults: dict[str, Any] = field(hash=False)


OPS: dict[str, Op] = {}


def register(name: str, category: str, build: Callable[..., dict[str, E]]) -> None:
    """Adds an indicator: ``build`` takes expressions and parameters and returns
    expressions by output name. Parameters named like bar columns, or annotated
    ``E``, are inputs; those with a default of None are optional."""
    columns, optional, defaults = [], [], {}
    for p in inspect.signature(build).parameters.values():
        if p.name in COLUMNS or "E" in str(p.annotation).replace("|", " ").split():
            (columns if p.default is p.empty else optional).append(p.name)
        else:
            defaults[p.name] = p.default
    OPS[name] = Op(name, category, build, tuple(columns), tuple(optional), defaults)


def op(category: str, name: str | None = None):
    def add(build):
        register(name or build.__name__.strip("_"), category, build)
        return build

    return add


def categories() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for o in OPS.values():
        out.setdefault(o.category, []).append(o.name)
    return {c: sorted(names) for c, names in sorted(out.items())}
