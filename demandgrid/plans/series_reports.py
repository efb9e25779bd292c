"""Correlations, pivots, rolling statistics, autocorrelation, shares and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.operators import distribution, facts, groups, ranking, series
from demandgrid.plans.catalog import report, shown
from demandgrid.plans.oracle import FLAGS
from demandgrid.sources.driver_tables import CATEGORIES
from demandgrid.sources.sink import in_order

_COLUMNS = ["units_sold", *FLAGS]


def _number(column: str) -> str:
    return column if column == "units_sold" else f"CAST(CAST({column} AS INT) AS DOUBLE)"


@report("c1_corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CAST(1 AS DOUBLE) AS r" if a == b
    else f"SELECT '{a}' AS a, '{b}' AS b, round(corr({_number(a)}, {_number(b)}), 6) AS r FROM ctgt"
    for a in _COLUMNS for b in _COLUMNS
))
def _(s):
    return shown(series.corr_matrix(s.calendar_target, _COLUMNS), 6)


_STORE_SALES = "(SELECT * FROM smean JOIN c_store USING (store_id))"


def _store_sales(s):
    return groups.neighborhood_of_stores(groups.store_means(s.calendar_target), s.store)


@report("c2_corr_seats_units", f'SELECT round(corr(seating_capacity, mean_units), 6) AS r, count(*) AS "rows" FROM {_STORE_SALES}')
def _(s):
    return shown(series.corr_pair(_store_sales(s), "seating_capacity", "mean_units"), 6)


@report("c2_corr_staff_units", f'SELECT round(corr(staff_count, mean_units), 6) AS r, count(*) AS "rows" FROM {_STORE_SALES}')
def _(s):
    return shown(series.corr_pair(_store_sales(s), "staff_count", "mean_units"), 6)


@report("c2_corr_units_revenue", 'SELECT round(corr(units_sold, revenue), 6) AS r, count(*) AS "rows" FROM fact')
def _(s):
    return shown(series.corr_pair(s.fact, "units_sold", "revenue"), 6)


@report("c3_drive_through_mean", f"SELECT has_drive_through, round(avg(mean_units), 4) AS mean_units, count(*) AS stores FROM {_STORE_SALES} GROUP BY ALL")
def _(s):
    return shown(groups.attribute_bar(_store_sales(s), "has_drive_through"))


@report("c4_scatter_store_attributes", f"SELECT store_id, seating_capacity, staff_count, round(mean_units, 4) AS mean_units FROM {_STORE_SALES}")
def _(s):
    return shown(_store_sales(s).select("store_id", "seating_capacity", "staff_count", "mean_units"))


@report("c4_scatter_store_attributes_grid", """SELECT store_id, seating_capacity, staff_count, round(mean_units, 4) AS mean_units
    FROM sgrid JOIN c_store USING (store_id)""")
def _(s):
    sales = groups.neighborhood_of_stores(groups.store_means(s.grid), s.store)
    return shown(sales.select("store_id", "seating_capacity", "staff_count", "mean_units"))


@report("c4_scatter_units_revenue", """WITH e AS (SELECT min(units_sold) AS a, max(units_sold) AS z, min(revenue) AS b, max(revenue) AS y FROM fact),
    p AS (SELECT units_sold AS u, a, (z - a) / 25 AS wu, revenue AS r, b, (y - b) / 40 AS wr,
      least(floor((units_sold - a) / ((z - a) / 25)), 24) AS i, least(floor((revenue - b) / ((y - b) / 40)), 39) AS j FROM fact, e),
    x AS (SELECT CAST(CASE WHEN u < a + i * wu THEN i - 1 WHEN u >= a + (i + 1) * wu AND i < 24 THEN i + 1 ELSE i END AS INT) AS x_bin,
      CAST(CASE WHEN r < b + j * wr THEN j - 1 WHEN r >= b + (j + 1) * wr AND j < 39 THEN j + 1 ELSE j END AS INT) AS y_bin, a, wu, b, wr FROM p),
    c AS (SELECT x_bin, y_bin, a, wu, b, wr, count(*) AS n FROM x GROUP BY ALL)
    SELECT x_bin, y_bin, round(a + x_bin * wu, 6) AS x_lo, round(a + (x_bin + 1) * wu, 6) AS x_hi, round(b + y_bin * wr, 6) AS y_lo,
      round(b + (y_bin + 1) * wr, 6) AS y_hi, n AS "count" FROM c""")
def _(s):
    return shown(distribution.binned_scatter(s.fact, "units_sold", "revenue", 25, 40), 6)


@report("c4_scatter_stability", """SELECT store_id, round(avg(units_sold), 4) AS mean_units, round(stddev_samp(units_sold), 4) AS std_units FROM dstore GROUP BY ALL""")
def _(s):
    return shown(groups.demand_volatility(facts.daily_store(s.target)).select("store_id", "mean_units", "std_units"))


@report("c4_scatter_store_units_revenue", "SELECT store_id, round(avg(units_sold), 4) AS mean_units, round(avg(revenue), 2) AS mean_revenue FROM fact GROUP BY ALL")
def _(s):
    return shown(groups.store_metrics(s.fact).select("store_id", "mean_units", "mean_revenue"), mean_revenue=2)


@report("c4_scatter_hours_orders", "SELECT store_id, count(DISTINCT hour) AS x, count(order_id) AS y FROM fact GROUP BY ALL")
def _(s):
    activity = groups.store_activity(s.fact)
    return activity.select("store_id", F.col("hours_active").alias("x"), F.col("orders").alias("y"))


@report("c4_scatter_volume_value", """SELECT store_id, sum(units_sold) AS x, round(sum(revenue) / count(DISTINCT customer_id), 2) AS y,
    round(sum(revenue), 4) AS size, neighborhood_type FROM fact GROUP BY ALL""")
def _(s):
    points = groups.store_profitability(s.fact, s.store)
    return shown(points.select(
        "store_id", F.col("units").alias("x"), F.col("revenue_per_customer").alias("y"), F.col("revenue").alias("size"), "neighborhood_type"
    ), y=2)


@report("c4_scatter_discount_units", "SELECT discount_applied AS x, round(avg(units_sold), 4) AS y, count(*) AS size FROM fact GROUP BY ALL")
def _(s):
    effect = groups.discount_value_effect(s.fact)
    return shown(effect.select(F.col("discount_applied").alias("x"), F.col("mean_units").alias("y"), F.col("rows").alias("size")))


_PIVOT = "SELECT {r}, {c}, round(avg(units_sold), 4) AS mean_units FROM {s} GROUP BY ALL"


@report("c5_pivot_store_category_target", _PIVOT.format(r="store_id", c="category", s="tgt"))
def _(s):
    return shown(series.mean_pivot(s.target, "store_id", "category"))


@report("c5_pivot_store_category_grid", _PIVOT.format(r="store_id", c="category", s="grid"))
def _(s):
    return shown(series.mean_pivot(s.grid, "store_id", "category"))


_LISTED = ", ".join(f"'{c}'" for c in CATEGORIES)


@report("c5_pivot_store_category_wide", "SELECT store_id, " + ", ".join(
    f"""round(avg(units_sold) FILTER (category = '{c}'), 4) AS "{c}\"""" for c in CATEGORIES
) + f""", round(avg(units_sold) FILTER (category NOT IN ({_LISTED})), 4) AS "other" FROM tgt GROUP BY store_id""")
def _(s):
    return shown(series.mean_pivot_wide(s.target, "store_id", "category", CATEGORIES))


@report("c5_pivot_store_category_map", """SELECT store_id, CAST(count(*) AS INT) AS categories, string_agg(category || '=' || CAST(CAST(round(m) AS BIGINT) AS VARCHAR), ',' ORDER BY category) AS means
    FROM (SELECT store_id, category, avg(units_sold) AS m FROM tgt GROUP BY ALL) GROUP BY store_id""")
def _(s):
    pivot = series.mean_pivot_map(s.target, "store_id", "category")
    entry = F.transform(F.map_entries("means"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"]).cast("long").cast("string")))
    return pivot.select("store_id", F.size("means").alias("categories"), F.array_join(entry, ",").alias("means"))


@report("c6_pivot_category_neighborhood", _PIVOT.format(r="category", c="neighborhood_type", s="ctgt"))
def _(s):
    return shown(series.mean_pivot(s.calendar_target, "category", "neighborhood_type"))


@report("c7_pivot_weekday_hour", _PIVOT.format(r="weekday", c="hour", s="fact"))
def _(s):
    return shown(series.mean_pivot(s.fact, "weekday", "hour"))


# --- time series -----------------------------------------------------------------------------

@report("t1_rolling_trailing_7", """SELECT date, units_sold, CASE WHEN n = 7 THEN round(mean, 4) END AS mean, CASE WHEN n = 7 THEN round(std, 4) END AS std,
    CASE WHEN n = 7 THEN round(mean - std, 4) END AS lo, CASE WHEN n = 7 THEN round(mean + std, 4) END AS hi FROM trend""")
def _(s):
    return shown(series.rolling_trailing(facts.daily_total(s.target)))


_CENTERED = """SELECT {c}date, units_sold, CASE WHEN count(*) OVER w = 7 THEN round(avg(units_sold) OVER w, 4) END AS mean FROM {s}
    WINDOW w AS ({p}ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""


@report("t2_rolling_centered_7", _CENTERED.format(c="", s="daily_grid", p=""))
def _(s):
    return shown(series.rolling_centered(facts.daily_total(s.grid)))


@report("t2_rolling_centered_7_category", _CENTERED.format(
    c="category, ", s="(SELECT date, category, sum(units_sold) AS units_sold FROM grid GROUP BY ALL)", p="PARTITION BY category "))
def _(s):
    return shown(series.rolling_centered(facts.daily_total(s.grid, "category"), by=["category"]))


@report("t3_trend_residual", "SELECT date, round(mean, 4) AS trend, round(units_sold - mean, 4) + 0.0 AS residual FROM trend WHERE n = 7")
def _(s):
    return shown(series.trend_residual(facts.daily_total(s.target)))


@report("t4_acf_global_mean", """WITH m AS (SELECT date, units_sold - avg(units_sold) OVER () AS x, count(*) OVER () AS n, row_number() OVER (ORDER BY date) AS i FROM daily),
    c AS (SELECT sum(x * x) AS c0, any_value(n) AS n FROM m)
    SELECT CAST(h AS INT) AS lag, round(sum(a.x * b.x) / any_value(c0), 6) AS r, round(1.96 / sqrt(any_value(c.n)), 6) AS band95,
    round(2.58 / sqrt(any_value(c.n)), 6) AS band99 FROM range(1, 31) AS t(h), m a, m b, c WHERE b.i = a.i + h GROUP BY h""")
def _(s):
    return shown(series.acf_global_mean(facts.daily_total(s.calendar_target)), 6)


_ACF = "WITH l AS MATERIALIZED (SELECT store_id, category, units_sold AS x, count(*) OVER (PARTITION BY store_id, category) AS n, " + ", ".join(
    f"lag(units_sold, {h}) OVER (PARTITION BY store_id, category ORDER BY date) AS y{h}" for h in range(1, 31)) + " FROM {source}) " + " UNION ALL ".join(
    f"SELECT store_id, category, CAST({h} AS INT) AS lag, round(corr(x, y{h}), 6) AS r, round(1.96 / sqrt(any_value(n)), 6) AS band FROM l GROUP BY ALL"
    for h in range(1, 31))


@report("t5_acf_pearson", _ACF.format(source="grid"))
def _(s):
    return shown(series.acf_pearson(s.grid), 6)


@report("t5_acf_pearson_densest", _ACF.format(
    source="grid JOIN (SELECT store_id, category FROM grid GROUP BY ALL HAVING count(*) > 300 ORDER BY count(*) DESC, store_id, category LIMIT 1) USING (store_id, category)"))
def _(s):
    return shown(series.acf_pearson(series.rows_of_series(s.grid, series.densest_series(s.grid))), 6)


@report("t6_dense_series_pick", 'SELECT store_id, category, count(*) AS "rows" FROM grid GROUP BY ALL HAVING count(*) > 300')
def _(s):
    return series.dense_series(s.grid)


@report("t6_densest_series", """SELECT store_id, category, count(*) AS "rows" FROM grid GROUP BY ALL HAVING count(*) > 300
    ORDER BY count(*) DESC, store_id, category LIMIT 1""")
def _(s):
    return series.densest_series(s.grid)


@report("t7_forecast_window_flag", """SELECT date, units_sold, date BETWEEN DATE '2001-06-02' AND DATE '2001-08-01' AS in_window FROM daily""")
def _(s):
    return series.forecast_window_flag(facts.daily_total(s.target), "2001-06-02", "2001-08-01")


# --- shares and rankings ---------------------------------------------------------------------

@report("w1_share_of_total", "SELECT store_id, round(100 * sum(revenue) / (SELECT sum(revenue) FROM fact), 4) AS pct FROM fact GROUP BY ALL")
def _(s):
    return shown(ranking.share_of_total(groups.revenue_by(s.fact, "store_id"), "revenue").select("store_id", "pct"))


@report("w2_pareto_cumulative", """WITH r AS (SELECT category, sum(revenue) AS revenue FROM fact GROUP BY ALL),
    c AS (SELECT *, 100 * sum(revenue) OVER (ORDER BY revenue DESC, category) / sum(revenue) OVER () AS p FROM r)
    SELECT category, round(revenue, 4) AS revenue, round(p, 4) AS cum_pct, CASE WHEN p > 80 THEN 'tail' WHEN p > 50 THEN 'middle' ELSE 'head' END AS class FROM c""")
def _(s):
    return shown(ranking.pareto_cumulative(groups.revenue_by(s.fact, "category"), "category", "revenue"))


@report("w3_top_bottom_stores", """SELECT * FROM (SELECT store_id, round(mean_units, 4) AS mean_units, 'top' AS side FROM smean ORDER BY smean.mean_units DESC, store_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT store_id, round(mean_units, 4), 'bottom' FROM smean ORDER BY smean.mean_units, store_id LIMIT 5)""")
def _(s):
    means = groups.units_by(s.calendar_target, "store_id", "mean_units")
    return shown(ranking.top_bottom_k(means, "store_id", "mean_units", 5))


@report("w3_top10_stores", "SELECT store_id, round(mean_units, 4) AS mean_units FROM smean ORDER BY smean.mean_units DESC, store_id LIMIT 10")
def _(s):
    return shown(ranking.top_k(groups.units_by(s.calendar_target, "store_id", "mean_units"), "store_id", "mean_units", 10))


@report("w3_top5_hours_by_units", "SELECT hour, sum(units_sold) AS units FROM fact GROUP BY hour ORDER BY units DESC, hour LIMIT 5")
def _(s):
    return ranking.top_k(groups.units_by(s.fact, "hour", "units"), "hour", "units", 5)


@report("w3_top5_hours_by_mean", "SELECT hour, round(avg(units_sold), 4) AS mean_units FROM fact GROUP BY hour ORDER BY avg(units_sold) DESC, hour LIMIT 5")
def _(s):
    return shown(ranking.top_k(groups.units_by(s.fact, "hour", "mean_units"), "hour", "mean_units", 5))


@report("w3_top5_stores_by_volume", "SELECT store_id, round(avg(units_sold), 4) AS mean_units FROM fact GROUP BY store_id ORDER BY avg(units_sold) DESC, store_id LIMIT 5")
def _(s):
    return shown(ranking.top_k(groups.units_by(s.fact, "store_id", "mean_units"), "store_id", "mean_units", 5))


@report("w4_store_ranking", "SELECT store_id, round(mean_units, 4) AS mean_units, CAST(row_number() OVER (ORDER BY smean.mean_units, store_id) AS INT) AS rank FROM smean")
def _(s):
    return shown(ranking.ranked(groups.units_by(s.calendar_target, "store_id", "mean_units"), "store_id", "mean_units"))


_CANDLE = """SELECT {k}, round(h.mean, 4) AS mean, round(h.median, 4) AS median, round(coalesce(h.std, 0), 4) AS std, h."min", h."max",
    round(greatest(coalesce(h.std, 0), 1), 4) AS body_height, round(h.median - greatest(coalesce(h.std, 0), 1) / 2, 4) AS body_bottom FROM {s}"""


@report("w5_hour_neighborhood_weekday", _CANDLE.format(k="hour, neighborhood_type, weekday", s="hour_stats h"))
def _(s):
    return shown(ranking.hour_neighborhood_weekday(facts.hourly_fact(s.transaction, s.order, s.store)))


@report("w5_hour_neighborhood_weekday_complete", _CANDLE.format(
    k="k.hour, k.neighborhood_type, k.weekday",
    s="""(SELECT * FROM (SELECT DISTINCT hour FROM hourly_line), (SELECT DISTINCT neighborhood_type FROM hourly_line), (SELECT CAST(unnest(range(7)) AS INT) AS weekday)) k
    LEFT JOIN hour_stats h ON h.hour = k.hour AND h.neighborhood_type = k.neighborhood_type AND h.weekday = k.weekday"""))
def _(s):
    return shown(ranking.hour_neighborhood_weekday(facts.hourly_fact(s.transaction, s.order, s.store), complete=True))


@report("w6_workload_split", """WITH q AS (SELECT quantile_cont(units, 0.75) AS hi, quantile_cont(units, 0.25) AS lo FROM hours_rev)
    SELECT CASE WHEN units > hi THEN 'peak' WHEN units <= lo THEN 'off_peak' ELSE 'mid' END AS class, sum(units) AS units, count(*) AS hours FROM hours_rev, q GROUP BY ALL""")
def _(s):
    return ranking.workload_split(groups.hourly_revenue_volume(s.fact))


@report("w7_peak_hour_flag", """SELECT hour, round(mean_revenue, 2) AS mean_revenue,
    mean_revenue >= (SELECT quantile_cont(mean_revenue, 0.75) FROM hours_rev) AS is_peak FROM hours_rev""")
def _(s):
    hours = groups.hourly_revenue_volume(s.fact).select("hour", "mean_revenue")
    return shown(ranking.peak_hours(hours), 2)


@report("w8_basket_segments", """WITH q AS (SELECT quantile_cont(units, 0.25) AS lo, quantile_cont(units, 0.75) AS hi, count(*) AS n, sum(units) AS u FROM basket),
    r AS (SELECT 100.0 * count_if(units <= lo) / any_value(n) AS so, 100.0 * count_if(units >= hi) / any_value(n) AS lg,
      100 * sum(units) FILTER (units <= lo) / any_value(u) AS su, 100 * sum(units) FILTER (units >= hi) / any_value(u) AS lu FROM basket, q)
    SELECT 'small' AS segment, round(so, 4) AS pct_orders, round(su, 4) AS pct_units FROM r UNION ALL
    SELECT 'large', round(lg, 4), round(lu, 4) FROM r UNION ALL SELECT 'medium', round(100 - so - lg, 4), NULL FROM r""")
def _(s):
    return shown(ranking.basket_segments(facts.baskets(s.transaction)))


@report("w9_sorts", """SELECT category, units, row_number() OVER (ORDER BY units DESC, category) AS "position"
    FROM (SELECT category, sum(units_sold) AS units FROM grid GROUP BY ALL)""")
def _(s):
    return in_order(groups.units_by(s.grid, "category", "units"), "categories-by-units", F.desc("units"), "category")


@report("w9_sorts_cells", 'SELECT *, row_number() OVER (ORDER BY units_sold DESC, date, store_id, category) AS "position" FROM tgt')
def _(s):
    return in_order(s.target, "cells-by-units", F.desc("units_sold"), "date", "store_id", "category")
