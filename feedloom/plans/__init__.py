"""Queries over the driver tables, with their SQL twins."""

from . import filters, functions, scoring, tables  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
