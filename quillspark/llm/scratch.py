"""What the operators here share with the engine: tables in the shared folder; and names for columns of their own."""

from __future__ import annotations

from collections.abc import Iterable

from ..shared import discard, shared_dir, written

__all__ = ["discard", "free_name", "shared_dir", "written"]


def free_name(columns: Iterable[str], start: str = "__q") -> str:
    """A prefix that no column has, whatever its case: columns that an operator adds to a user's rows begin with it."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(start) for c in taken):
        start += "_"
    return start
