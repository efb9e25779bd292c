"""Histograms, box plots, quantile and discount bins, skewness and normal plots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.functions import columns
from demandgrid.operators import distribution as dist
from demandgrid.operators import effects, facts, groups, ranking, series
from demandgrid.operators.quantiles import quantiles, summary, value_counts
from demandgrid.plans.catalog import add, report, shown
from demandgrid.plans.oracle import FLAGS, box_sql, describe_sql, hist_sql
from demandgrid.sources.star import Star

_TOP4_LINES = "(SELECT f.* FROM fact f JOIN top4 USING (category))"


def _top4_counts(s: Star) -> DataFrame:
    counts = value_counts(s.fact, "units_sold", ["category"])
    return ranking.keep_top_groups(counts, "category", F.col("n") * F.col("value"), 4)


def _hist(name: str, bins: int, counts: Callable[[Star], DataFrame], source: str, value: str, column=lambda: "value") -> None:
    """A histogram over value counts: the column is combined to its distinct values before binning."""
    add(
        f"d1_hist_{name}",
        lambda s: shown(dist.histogram(counts(s), column(), bins, weight="n")),
        hist_sql(source, value, bins),
    )


_hist("target", 50, lambda s: value_counts(s.calendar_target, "units_sold"), "ctgt", "units_sold")
_hist("target_log1p", 50, lambda s: value_counts(s.calendar_target, "units_sold"), "ctgt", "ln(1 + units_sold)", lambda: F.log1p("value"))
_hist("promo_discount", 20, lambda s: value_counts(s.promotion, "discount_pct"), "c_promo", "discount_pct")
_hist("seating", 10, lambda s: value_counts(s.store, "seating_capacity"), "c_store", "seating_capacity")
_hist("staff", 10, lambda s: value_counts(s.store, "staff_count"), "c_store", "staff_count")
_hist("store_mean", 10, lambda s: value_counts(groups.store_means(s.calendar_target), "mean_units"), "smean", "mean_units")
_hist("residual", 30, lambda s: value_counts(series.trend_residual(facts.daily_total(s.target)), "residual"),
      "(SELECT units_sold - mean AS x FROM trend WHERE n = 7)", "x")
_hist("variety", 5, lambda s: value_counts(groups.store_variety(s.target), "categories"),
      "(SELECT store_id, count(DISTINCT category) AS x FROM tgt GROUP BY ALL)", "x")
_hist("transactions", 10, lambda s: value_counts(groups.store_metrics(s.fact), "transactions"),
      "(SELECT store_id, count(DISTINCT order_id) AS x FROM fact GROUP BY ALL)", "x")
_hist("basket_units", 50, lambda s: value_counts(facts.baskets(s.transaction), "units"), "basket", "units")
_hist("basket_lines", 20, lambda s: value_counts(facts.baskets(s.transaction), "lines"), "basket", "lines")
_hist("discount", 40, lambda s: value_counts(s.transaction, "discount_applied"), "c_txn", "discount_applied")
_hist("member_frequency", 30, lambda s: value_counts(facts.member_frequency(s.order), "orders"), "freq", "orders")
_hist("daily_stockout", 30, lambda s: value_counts(effects.stockout_daily_rate(s.inventory), F.col("rate") * 100),
      "(SELECT rate * 100 AS x FROM inv_rate)", "x")
_hist("grid", 80, lambda s: value_counts(s.grid, "units_sold"), "grid", "units_sold")
_hist("grid_nonzero", 80, lambda s: value_counts(s.grid.where("units_sold > 0"), "units_sold"),
      "(SELECT * FROM grid WHERE units_sold > 0)", "units_sold")
_hist("grid_nonzero_log1p", 80, lambda s: value_counts(s.grid.where("units_sold > 0"), "units_sold"),
      "(SELECT * FROM grid WHERE units_sold > 0)", "ln(1 + units_sold)", lambda: F.log1p("value"))


@report("d1_hist_top4_category", hist_sql(_TOP4_LINES, "units_sold", 30, "category"))
def _(s):
    return shown(dist.histogram(_top4_counts(s), "value", 30, ["category"], weight="n"))


@report("d1_hist_revenue_50", hist_sql("fact", "revenue", 50, digits=8))
def _(s):
    return shown(dist.histogram(value_counts(s.fact, "revenue"), "value", 50, weight="n"), 8)


@report("d1_hist_revenue_40", hist_sql("fact", "revenue", 40, digits=8))
def _(s):
    return shown(dist.histogram(value_counts(s.fact, "revenue"), "value", 40, weight="n"), 8)


@report("d1_hist_store_revenue", hist_sql("(SELECT store_id, round(sum(revenue), 4) AS x FROM fact GROUP BY ALL)", "x", 10, digits=6))
def _(s):
    return shown(dist.histogram(groups.revenue_by(s.fact, "store_id"), F.round("revenue", 4), 10), 6)


@report("d2_cumulative_histogram", f"""WITH h AS ({hist_sql("ctgt", "units_sold", 50)})
    SELECT *, CAST(sum("count") OVER (ORDER BY bin) AS BIGINT) AS running FROM h""")
def _(s):
    return shown(dist.cumulative_histogram(dist.histogram(value_counts(s.calendar_target, "units_sold"), "value", 50, weight="n")))


# --- summaries -------------------------------------------------------------------------------

@report("d3_summary_target", describe_sql("ctgt", "units_sold"))
def _(s):
    return shown(summary(value_counts(s.calendar_target, "units_sold")))


@report("d3_summary_grid", describe_sql("grid", "units_sold"))
def _(s):
    return shown(summary(value_counts(s.grid, "units_sold")))


@report("d3_summary_basket", describe_sql("basket", "units"))
def _(s):
    return shown(summary(value_counts(facts.baskets(s.transaction), "units")))


@report("d3_summary_member_frequency", describe_sql("freq", "orders"))
def _(s):
    return shown(summary(value_counts(facts.member_frequency(s.order), "orders")))


@report("d4_zero_vs_positive", """SELECT CAST(count_if(units_sold = 0) AS BIGINT) AS zero, CAST(count_if(units_sold > 0) AS BIGINT) AS positive,
    round(100.0 * count_if(units_sold = 0) / count(*), 4) AS zero_pct FROM ctgt""")
def _(s):
    return shown(dist.zero_vs_positive(s.calendar_target))


_G1 = """WITH m AS (SELECT avg(units_sold) AS mu FROM {0}), d AS (SELECT units_sold - mu AS x FROM {0}, m)
    SELECT round(avg(x * x * x) / pow(avg(x * x), 1.5), 4) AS skew_biased FROM d"""


@report("d5_skewness_g1", _G1.format("ctgt"))
def _(s):
    return shown(dist.skewness(s.calendar_target).select("skew_biased"))


@report("d6_skewness_corrected", "SELECT round(skewness(units_sold), 4) AS skew_corrected FROM grid")
def _(s):
    return shown(dist.skewness(s.grid).select("skew_corrected"))


def _poly_sql(coefficients: list[float], x: str) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


_TAIL_SQL = "{0} / {1}".format(_poly_sql(columns._TAIL_TOP, "{t}"), _poly_sql(columns._TAIL_BOTTOM, "{t}"))
_T1, _T2 = "sqrt(-2.0 * ln(p))", "sqrt(-2.0 * ln(1 - p))"
_QUANTILE_SQL = (
    f"CASE WHEN p < {columns._TAIL} THEN {_TAIL_SQL.format(t=_T1)} WHEN p > {1 - columns._TAIL} THEN -({_TAIL_SQL.format(t=_T2)}) "
    f"ELSE {_poly_sql(columns._CENTRE_TOP, '((p - 0.5) * (p - 0.5))')} * (p - 0.5) / {_poly_sql(columns._CENTRE_BOTTOM, '((p - 0.5) * (p - 0.5))')} END"
)
_QQ = f"""o AS (SELECT units_sold AS value, row_number() OVER (ORDER BY units_sold) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM ctgt),
    m AS (SELECT *, CAST(CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END AS DOUBLE) AS p FROM o),
    qq AS (SELECT i AS "position", {_QUANTILE_SQL} AS theoretical, value FROM m)"""


@report("d7_qq_normal_points", f"""WITH {_QQ} SELECT "position", CASE WHEN abs(theoretical) < 0.00005 THEN 0.0 ELSE round(theoretical, 4) END AS theoretical, value FROM qq""")
def _(s):
    return shown(dist.normal_plot(s.calendar_target))


@report("d7_qq_normal_fit", f"""WITH {_QQ} SELECT round(regr_slope(value, theoretical), 4) AS slope,
    round(regr_intercept(value, theoretical), 4) AS intercept, round(corr(value, theoretical), 4) AS r FROM qq""")
def _(s):
    return shown(dist.normal_fit(dist.normal_plot(s.calendar_target)))


# --- box plots -------------------------------------------------------------------------------

def _flag_boxes(source: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{f}' AS flag, {f} AS flag_value, units_sold FROM {source}" for f in FLAGS)
    return box_sql(f"({long})", "flag, flag_value")


def _box(name: str, build: Callable[[Star], DataFrame], by: list[str], source: str) -> None:
    add(f"d8_box_{name}", lambda s: shown(dist.boxplot_stats(build(s), by)), box_sql(source, ", ".join(by)))


@report("d8_box_target_flags", _flag_boxes("ctgt"))
def _(s):
    return shown(dist.boxplot_stats(dist.flag_value_counts(s.calendar_target, "units_sold", FLAGS), ["flag", "flag_value"]))


@report("d8_box_grid_flags", _flag_boxes("cgrid"))
def _(s):
    return shown(dist.boxplot_stats(dist.flag_value_counts(s.calendar_grid, "units_sold", FLAGS), ["flag", "flag_value"]))


_box("target", lambda s: value_counts(s.calendar_target, "units_sold"), [], "ctgt")
_box("promo_day", lambda s: effects.day_flag_value_counts(s.calendar_target, effects.promo_dates(s.promotion, s.date_dim), "has_promo"),
     ["has_promo"], "promo_day_tgt")
_box("promo_cell", lambda s: value_counts(effects.promo_cells(s.grid, facts.promo_flag(s.promo_days)), "units_sold", ["has_promo"]),
     ["has_promo"], "promo_grid")
_box("event_store_day", lambda s: value_counts(
    effects.flag_rows(s.calendar_target, effects.event_store_days(s.local_event), effects.STORE_DAY, "has_event"), "units_sold", ["has_event"]),
     ["has_event"], "evt_tgt")
_box("event_cell", lambda s: value_counts(effects.event_cells(s.grid, s.local_event), "units_sold", ["has_event"]), ["has_event"], "evt_grid")
_box("event_cell_fanout", lambda s: value_counts(effects.event_cells(s.grid, s.local_event, dedupe=False), "units_sold", ["has_event"]),
     ["has_event"], "evt_grid_fan")
_box("stockout_cell", lambda s: value_counts(
    effects.stockout_cells(s.grid, facts.stockout_store_cat_day(s.inventory, s.product)), "units_sold", ["has_stockout"]),
     ["has_stockout"], "so_grid")


@report("d8_box_stockout_category", box_sql("(SELECT x.* FROM so_line x JOIN top4 USING (category))", "category, is_stockout"))
def _(s):
    lines = effects.top_stock_lines(effects.stock_lines(s.fact, s.inventory))
    return shown(dist.boxplot_stats(effects.stock_value_counts(lines, "category"), ["category", "is_stockout"]))


@report("d9_p99_clip_grid", "SELECT round(quantile_cont(units_sold, 0.99), 4) AS p99 FROM cgrid")
def _(s):
    return shown(quantiles(value_counts(s.calendar_grid, "units_sold"), {"p99": 0.99}))


@report("d9_p99_clip_event", "SELECT round(quantile_cont(units_sold, 0.99), 4) AS p99 FROM evt_grid_fan")
def _(s):
    return shown(quantiles(value_counts(effects.event_cells(s.grid, s.local_event, dedupe=False), "units_sold"), {"p99": 0.99}))


# --- bins ------------------------------------------------------------------------------------

@report("d10_quantile_bins", """WITH q AS (SELECT unnest(list_sort(list_distinct(quantile_cont(units_sold, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])))) AS e FROM ctgt),
    k AS (SELECT row_number() OVER (ORDER BY e) AS bin, e AS lo, lead(e) OVER (ORDER BY e) AS hi FROM q)
    SELECT CAST(bin AS INT) AS bin, round(lo, 4) AS lo, round(hi, 4) AS hi, count(units_sold) AS "count" FROM k
    LEFT JOIN ctgt ON (units_sold > lo OR (bin = 1 AND units_sold = lo)) AND units_sold <= hi WHERE hi IS NOT NULL GROUP BY ALL""")
def _(s):
    return shown(dist.quantile_bins(value_counts(s.calendar_target, "units_sold"), 5))


_CUT = """WITH b AS (SELECT min({c}) AS a, max({c}) AS z, (max({c}) - min({c})) / 5 AS w FROM {s}),
    e AS (SELECT CAST(i AS INT) AS bin, a + (i - 1) * w - CASE WHEN i = 1 THEN (z - a) * 0.001 ELSE 0 END AS lo, a + i * w AS hi FROM b, range(1, 6) AS t(i)),
    v AS (SELECT CAST(least(greatest(ceil(({c} - a) / w), 1), 5) AS INT) AS bin, {m} AS x FROM {s}, b)
    SELECT e.bin, round(lo, 4) AS lo, round(hi, 4) AS hi, {out} FROM e LEFT JOIN v USING (bin) GROUP BY ALL"""


@report("d11_cut_revenue_per_unit", _CUT.format(
    c="discount_applied", s="(SELECT * FROM c_txn WHERE discount_applied > 0)", m="revenue / units_sold", out="round(avg(x), 4) AS revenue_per_unit"))
def _(s):
    discounted = s.transaction.where("discount_applied > 0")
    each = columns.ratio(F.col("revenue"), F.col("units_sold"))
    return shown(dist.cut_equal_width(discounted, "discount_applied", 5, {"revenue_per_unit": each}))


@report("d11_cut_promo_discount", _CUT.format(
    c="discount_pct", s="c_promo", m="discount_pct", out='count(x) AS "count", round(avg(x), 4) AS mean'))
def _(s):
    return shown(dist.cut_equal_width(s.promotion, "discount_pct", 5, {"mean": F.col("discount_pct")}, count=True))


_BANDS = """WITH x AS (SELECT *, CASE {zero} WHEN discount_applied > 0 AND discount_applied <= 10 THEN 1 WHEN discount_applied > 10 AND discount_applied <= 20 THEN 2
    WHEN discount_applied > 20 AND discount_applied <= 30 THEN 3 WHEN discount_applied > 30 AND discount_applied <= 40 THEN 4
    WHEN discount_applied > 40 AND discount_applied <= 100 THEN 5 END AS bin FROM fact)
    SELECT bin, round(avg(units_sold), 4) AS mean_units, count(units_sold) AS lines, round(avg(revenue), 2) AS mean_revenue, round(sum(revenue), 4) AS revenue,
    round(avg(revenue - units_sold * (base_price * 0.4)), 2) AS mean_gross_profit,
    CAST([0, 0, 10, 20, 30, 40][bin + 1] AS DOUBLE) AS lo, CAST([0, 10, 20, 30, 40, 100][bin + 1] AS DOUBLE) AS hi FROM x WHERE bin IS NOT NULL GROUP BY bin"""


@report("d12_cut_explicit", _BANDS.format(zero=""))
def _(s):
    return shown(dist.discount_bands(s.fact), mean_revenue=2, mean_gross_profit=2)


@report("d12_cut_explicit_with_undiscounted", _BANDS.format(zero="WHEN discount_applied = 0 THEN 0"))
def _(s):
    return shown(dist.discount_bands(s.fact, with_undiscounted=True), mean_revenue=2, mean_gross_profit=2)


@report("d13_describe_of_describe", """SELECT neighborhood_type, round(min(mean), 2) AS mean_min, round(avg(mean), 2) AS mean_mean, round(max(mean), 2) AS mean_max,
    round(min(median), 2) AS median_min, round(avg(median), 2) AS median_mean, round(max(median), 2) AS median_max, max("max") AS max_max
    FROM hour_stats GROUP BY ALL""")
def _(s):
    lines = facts.hourly_fact(s.transaction, s.order, s.store)
    return shown(dist.describe_of_describe(ranking.hour_neighborhood_weekday(lines)), 2)


