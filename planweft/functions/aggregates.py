"""Aggregations as Spark columns. All but the ordered ones combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planweft.errors import PlanError, check
from planweft.plans.expressions import Aggregation
from planweft.types import cast

ORDERED = ("NTH_ELEMENT", "ARGMAX", "ARGMIN")


def wide(x: Aggregation, a: Column) -> Column:
    """The operand as the type to sum in: the declared one."""
    return cast(a, x.type.as_nullable())


def aggregate(x: Aggregation, a: Column, order: Column | None) -> Column:
    """``order``: the order of rows, for ordered aggregations. NTH_ELEMENT of an inner place is the compiler's."""
    op = x.op
    if op == "SUM":
        made = F.sum(wide(x, a))
    elif op == "PRODUCT":
        made = F.product(a.cast("double"))
    elif op in ("MIN", "MAX", "MEAN", "MEDIAN"):
        made = {"MIN": F.min, "MAX": F.max, "MEAN": F.avg, "MEDIAN": F.median}[op](a)
    elif op == "COUNT_VALID":
        made = F.count(a)
    elif op == "COUNT_ALL":
        made = F.count(F.lit(1))
    elif op in ("ANY", "ALL"):
        made = (F.bool_or if op == "ANY" else F.bool_and)(a.cast("boolean"))
    elif op == "SUM_OF_SQUARES":
        made = F.sum(wide(x, a) * wide(x, a))
    elif op == "QUANTILE":
        check(x.q is not None, "QUANTILE needs q")
        made = F.percentile(a, x.q)
    elif op == "NUNIQUE":  # null counts as a value
        made = F.count_distinct(a) + F.coalesce(F.max(F.when(a.isNull(), 1).otherwise(0)), F.lit(0))
    elif op in ("ARGMAX", "ARGMIN"):
        # the first of equal values in arrival order; nulls are no extremes
        if op == "ARGMIN":
            made = F.min(F.when(a.isNotNull(), F.struct(a.alias("v"), order.alias("o"))))["o"]
        else:
            made = -F.max(F.when(a.isNotNull(), F.struct(a.alias("v"), (-order).alias("o"))))["o"]
    elif op == "NTH_ELEMENT":
        made = (F.min_by if x.n == 0 else F.max_by)(a, order)
    else:
        raise PlanError(f"unknown aggregation {op!r}")
    return cast(made, x.type)
