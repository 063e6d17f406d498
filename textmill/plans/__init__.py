"""Named queries over the driver's test tables, with DuckDB oracle SQL."""

from . import chats, evaluation, io, mixing, packing, runs, streams, tokens  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
