"""Predicates, aggregates and value text."""

from .aggregates import Agg, AggFunc, count, max_, mean, min_, sum_
from .predicates import Expr, and_, col, not_, or_

__all__ = ["Agg", "AggFunc", "Expr", "and_", "col", "count", "max_", "mean", "min_", "not_", "or_", "sum_"]
