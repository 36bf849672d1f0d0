"""Checks of configurations."""

from __future__ import annotations

import warnings
from collections.abc import Iterable


def warn_of_unknown(part: str, given: dict | None, known: Iterable[str]) -> dict:
    """The settings without those that are null; keys that change nothing are warned of."""
    given = dict(given or {})
    unknown = sorted(str(k) for k in given if k not in set(known))
    if unknown:
        warnings.warn(f"unknown {part} settings: {', '.join(unknown)}", stacklevel=3)
    return {k: v for k, v in given.items() if v is not None}
