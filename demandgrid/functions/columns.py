"""Scalar column expressions shared by the analyses; all stay inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HOLIDAY_MONTHS = [1, 4, 5, 10, 12]
COST_SHARE = 0.4


def all_known(*names: str) -> Column:
    """True where every named column is present."""
    return reduce(Column.__and__, [F.col(name).isNotNull() for name in names])


def known_number(value: Column) -> Column:
    """A number with NaN as unknown."""
    return F.when(~F.isnan(value), value)


def ratio(above: Column, below: Column) -> Column:
    """Division that yields NULL instead of failing on a zero denominator."""
    return F.try_divide(above, below)


def percent(above: Column, below: Column) -> Column:
    return F.try_divide(above * 100.0, below)


def mean_where(condition: Column, value: Column) -> Column:
    """Aggregate: the mean of ``value`` over the rows for which ``condition`` holds."""
    return F.avg(F.when(condition, value))


def estimated_cost(units: Column, base_price: Column, cost_share: float = COST_SHARE) -> Column:
    return units * (base_price * cost_share)


def flag_as_double(flag: Column) -> Column:
    return flag.cast("int").cast("double")


def floor_bracket(value: Column, width: float = 10.0) -> Column:
    """Floor division, e.g. discount percent to its ten-percent bracket."""
    return F.floor(value / width)


def month_is_holiday(day: Column, months: Sequence[int] = HOLIDAY_MONTHS) -> Column:
    return F.month(day).isin(list(months))


def banded(value: Column, *bands: tuple[float, str], default: str) -> Column:
    """The label of the first band whose threshold ``value`` exceeds, in the order given."""
    (first, label), *rest = bands
    chain = F.when(value > first, label)
    for threshold, name in rest:
        chain = chain.when(value > threshold, name)
    return chain.otherwise(default)


def pareto_class(cumulative_pct: Column) -> Column:
    return banded(cumulative_pct, (80, "tail"), (50, "middle"), default="head")


def member_band(member_pct: Column) -> Column:
    return banded(member_pct, (30, "high"), (20, "medium"), default="low")


def growth_direction(growth_pct: Column) -> Column:
    return banded(growth_pct, (0, "up"), default="down")


SUBMISSION_ID = r"^(.*)_([^_]*)_([^_]*)$"


def submission_part(identifier: Column, part: int) -> Column:
    """Part 1 is store and category, 2 the forecast date, 3 the horizon."""
    return F.regexp_extract(identifier, SUBMISSION_ID, part)


def range_label(lo: Column, hi: Column) -> Column:
    """``5-13%`` from two bin edges, cut to whole numbers; an unknown edge is left out."""
    return F.concat_ws("", lo.cast("int").cast("string"), F.lit("-"), hi.cast("int").cast("string"), F.lit("%"))


def equal_width_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Left-closed bin number 0..bins-1 over [lo, hi]; the last bin also takes ``hi``.

    The floor is moved by one where rounding put the value on the wrong side of a bin edge.
    """
    width = (hi - lo) / bins
    raw = F.least(F.floor((value - lo) / width), F.lit(bins - 1).cast("long"))
    low_side = F.when(value < lo + raw * width, raw - 1)
    high_side = low_side.when((value >= lo + (raw + 1) * width) & (raw < bins - 1), raw + 1)
    return high_side.otherwise(raw)


def right_closed_bin(value: Column, edges: Sequence[float]) -> Column:
    """1-based number of the interval (edge, next edge] holding ``value``; NULL outside all of them."""
    pairs = list(zip(edges, edges[1:]))
    chain = F.when((value > pairs[0][0]) & (value <= pairs[0][1]), 1)
    for number, (lo, hi) in enumerate(pairs[1:], start=2):
        chain = chain.when((value > lo) & (value <= hi), number)
    return chain


# Acklam's published coefficients of the rational approximation to the inverse
# normal distribution (relative error below 1.15e-9).
_CENTRE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
               1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_CENTRE_BOTTOM = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
                  6.680131188771972e01, -1.328068155288572e01, 1.0]
_TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
                3.754408661907416e00, 1.0]
_TAIL = 0.02425


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution at probability ``p`` in (0, 1)."""
    q = p - 0.5
    centre = _polynomial(_CENTRE_TOP, q * q) * q / _polynomial(_CENTRE_BOTTOM, q * q)

    def tail(mass: Column) -> Column:
        t = F.sqrt(-2.0 * F.log(mass))
        return _polynomial(_TAIL_TOP, t) / _polynomial(_TAIL_BOTTOM, t)

    return F.when(p < _TAIL, tail(p)).when(p > 1 - _TAIL, -tail(1 - p)).otherwise(centre)
