"""Operators of a training-data pipeline and their queries.

Nothing else in the library imports this subpackage.
"""

from . import queries  # noqa: F401  (registers every query)
from .registry import ORACLE, QUERIES  # noqa: F401
