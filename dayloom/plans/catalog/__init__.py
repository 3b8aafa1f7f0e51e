"""Registered queries over the given tables, each with its SQL oracle where one exists."""

from dayloom.plans.catalog import (  # noqa: F401  (importing registers the queries)
    checks, evaluation, exogenous, features, files, forecasting, panels, plots, trends,
)
from dayloom.plans.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
