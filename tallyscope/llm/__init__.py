"""Operators of a training-data pipeline, one module each, and their queries.

Every operator takes the columns it needs by name and picks only those, so further
columns of its input can have any name. Nothing outside this folder imports it.
"""

from . import bpe, chat, exact, langid, merkle, minhash, packing, periods, quality, rules, secrets, suffixes, urls  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
