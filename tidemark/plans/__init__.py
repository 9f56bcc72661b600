"""Registered queries."""

from . import learning, signals, streams, ticks, trades
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "learning", "signals", "streams", "ticks", "trades"]
