"""All queries over the provided tables."""

from sieveframe.catalog import cleaning, events, inputs, texts  # noqa: F401
from sieveframe.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
