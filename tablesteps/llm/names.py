"""Names for helper columns that no table has."""

from __future__ import annotations

from collections.abc import Sequence


def free_prefix(columns: Sequence[str]) -> str:
    """A prefix that none of the columns starts with, in any case."""
    prefix = "_x_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix
