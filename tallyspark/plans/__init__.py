"""The operators applied to whole tables, by name, with equivalent SQL."""

from tallyspark.plans import corrections, extras, factors, forecasts, ladders, models, players, plays, scalars
from tallyspark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corrections", "extras", "factors", "forecasts", "ladders", "models", "players", "plays", "scalars"]
