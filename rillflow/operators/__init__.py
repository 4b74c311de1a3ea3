"""Pipeline operators: each turns a frame into a frame.  ``OPERATORS`` has them by name."""

from __future__ import annotations

from collections.abc import Callable

OPERATORS: dict[str, Callable] = {}


def operator(*names: str):
    def keep(f):
        for n in names:
            OPERATORS[n] = f
        return f

    return keep


from . import analytic, graph, nested, parsing, relational, summarize  # noqa: E402, F401
