"""The registered queries."""

from catalog import charts, estimation, forecasts, preparation, rules  # noqa: F401
from catalog.base import CASES, Case

__all__ = ["CASES", "Case"]
