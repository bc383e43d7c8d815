"""Column names: schema metadata, handled on the driver."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable, Sequence

# Fixed values.
MAX_COLUMNS = 2000
FALLBACK_NAME = "column"
EXTRA_PREFIX = "extra_"

_WORD = re.compile("[a-z0-9]+")


def slug(value: object) -> str:
    """Lower-case ASCII words of ``value`` joined by underscores."""
    decomposed = unicodedata.normalize("NFKD", str(value or ""))
    ascii_only = "".join(ch for ch in decomposed if ch.isascii())
    return "_".join(_WORD.findall(ascii_only.lower())) or FALLBACK_NAME


def unique_names(values: Iterable[object]) -> list[str]:
    """Slug every value; a repeated name takes the first free ``_2``, ``_3``… suffix."""
    names: dict[str, None] = {}
    for base in map(slug, values):
        numbered = (f"{base}_{n}" for n in itertools.count(2))
        names[next(n for n in itertools.chain([base], numbered) if n not in names)] = None
    return list(names)


def reserve(name: str, taken: Iterable[str]) -> str:
    """``name`` with as many leading underscores as it needs to be free."""
    taken = set(taken)
    while name in taken:
        name = f"_{name}"
    return name


def widened_names(names: Sequence[str], width: int) -> list[str]:
    """``names`` followed by ``extra_1``, ``extra_2``… up to ``width`` columns."""
    result = list(names)
    for n in range(1, width - len(names) + 1):
        result.append(reserve(f"{EXTRA_PREFIX}{n}", result))
    return check_width(result)


def check_width(names: Sequence[str]) -> list[str]:
    if not names:
        raise ValueError("the table has no header; nothing was processed")
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"the table has {len(names)} columns, the limit is {MAX_COLUMNS}")
    return list(names)
