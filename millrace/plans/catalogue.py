"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import models, scalars, statistics, wrangling
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "models", "scalars", "statistics", "wrangling"]
