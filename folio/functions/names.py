"""Names for columns that come and go within an operator."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(taken: Iterable[str], base: str) -> str:
    """``base`` with as many underscores before it as it takes to differ from all ``taken`` names, in any letter case."""
    used = {c.lower() for c in taken}
    name = f"_{base}"
    while name.lower() in used:
        name = f"_{name}"
    return name
