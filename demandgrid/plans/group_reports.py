"""Grouped summaries: categories, stores, hours, weekdays, discounts, payments, members and headline figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.functions.calendar import ordered_weekday
from demandgrid.operators import facts, groups
from demandgrid.operators.ranking import top_k
from demandgrid.plans.catalog import report, shown
from demandgrid.plans.oracle import FLAGS, flags_sql
from demandgrid.sources.sink import in_order

_WEEK = "SELECT w.weekday, dayname(DATE '2024-01-01' + CAST(w.weekday AS INT)) AS day_name, {cols} FROM (SELECT CAST(unnest(range(7)) AS INT) AS weekday) w LEFT JOIN {src} m USING (weekday)"


@report("g1_category_summary", """SELECT category, sum(units_sold) AS units, round(avg(units_sold), 4) AS mean_units,
    round(stddev_samp(units_sold), 4) AS std_units, count(units_sold) AS "rows" FROM fact GROUP BY category""")
def _(s):
    return shown(groups.category_summary(s.fact))


_TOP = """SELECT category, {axis}, sum(units_sold) AS units, count(*) AS "rows", round(avg(units_sold), 4) AS mean_units
    FROM fact JOIN {top} USING (category) GROUP BY ALL"""


@report("g1_category_summary_in_order", """SELECT category, units, "rows", row_number() OVER (ORDER BY units DESC, category) AS "position"
    FROM (SELECT category, sum(units_sold) AS units, count(units_sold) AS "rows" FROM fact GROUP BY category)""")
def _(s):
    summary = groups.category_summary(s.fact).select("category", "units", "rows")
    return in_order(summary, "category-summary", F.desc("units"), "category")


@report("g2_category_monthly_mean", _TOP.format(axis="month", top="top4"))
def _(s):
    return shown(groups.top_category_profile(s.fact, "month"))


@report("g3_flag_means_target", flags_sql("ctgt", 'round(avg(units_sold), 4) AS mean_units, count(*) AS "rows"'))
def _(s):
    return shown(groups.flag_means(s.calendar_target, FLAGS))


@report("g3_flag_means_grid", flags_sql("cgrid", 'round(avg(units_sold), 4) AS mean_units, count(*) AS "rows"'))
def _(s):
    return shown(groups.flag_means(s.calendar_grid, FLAGS))


@report("g4_weekday_mean_target", _WEEK.format(cols="round(x, 4) AS mean_units", src="(SELECT weekday, avg(units_sold) AS x FROM ctgt GROUP BY ALL)"))
def _(s):
    return shown(ordered_weekday(groups.units_by(s.calendar_target, "weekday", "mean_units")))


@report("g4_weekday_mean_fact", _WEEK.format(cols="round(x, 4) AS mean_units", src="(SELECT weekday, avg(units_sold) AS x FROM fact GROUP BY ALL)"))
def _(s):
    return shown(ordered_weekday(groups.units_by(s.fact, "weekday", "mean_units")))


@report("g4_weekday_mean_grid", "SELECT day_of_week, round(avg(units_sold), 4) AS mean_units FROM cgrid GROUP BY ALL")
def _(s):
    return shown(groups.units_by(s.calendar_grid, "day_of_week", "mean_units"))


@report("g5_month_mean_units", "SELECT month, round(avg(units_sold), 4) AS mean_units FROM ctgt GROUP BY ALL")
def _(s):
    return shown(groups.units_by(s.calendar_target, "month", "mean_units"))


@report("g5_month_mean_units_grid", "SELECT month, round(avg(units_sold), 4) AS mean_units FROM cgrid GROUP BY ALL")
def _(s):
    return shown(groups.units_by(s.calendar_grid, "month", "mean_units"))


@report("g6_month_sum_units", "SELECT month, sum(units_sold) AS units FROM ctgt GROUP BY ALL")
def _(s):
    return groups.units_by(s.calendar_target, "month", "units")


@report("g7_week_sum_units", "SELECT CAST(week(date) AS INT) AS week, sum(units_sold) AS units FROM ctgt GROUP BY ALL")
def _(s):
    return groups.units_by(s.calendar_target.withColumn("week", F.weekofyear("date")), "week", "units")


@report("g7_iso_week_sum_units", """SELECT CAST(isoyear(date) AS INT) AS iso_year, CAST(week(date) AS INT) AS week, sum(units_sold) AS units
    FROM ctgt GROUP BY ALL""")
def _(s):
    from demandgrid.functions.calendar import iso_year

    weeks = s.calendar_target.withColumns({"week": F.weekofyear("date"), "iso_year": iso_year(F.col("date"))})
    return groups.units_by(weeks, ["iso_year", "week"], "units")


@report("g8_category_week_top_units", _TOP.format(axis="week", top="top4"))
def _(s):
    return shown(groups.top_category_profile(s.fact, "week"))


@report("g8_category_week_top_rows", _TOP.format(axis="week", top="top4rows"))
def _(s):
    return shown(groups.top_category_profile(s.fact, "week", by_rows=True))


_NEIGHBORHOOD = ("units", "mean_units", "std_units", "min_units", "max_units", "rows")


@report("g8_category_week_top5", _TOP.format(axis="week", top="(SELECT category FROM fact GROUP BY category ORDER BY sum(units_sold) DESC, category LIMIT 5)"))
def _(s):
    return shown(groups.top_category_profile(s.fact, "week", k=5))


@report("g9_neighborhood_stats", """SELECT neighborhood_type, sum(units_sold) AS units, round(avg(units_sold), 4) AS mean_units,
    round(stddev_samp(units_sold), 4) AS std_units, min(units_sold) AS min_units, max(units_sold) AS max_units, count(*) AS "rows",
    round(avg(units_sold) - stddev_samp(units_sold), 4) AS band_lo, round(avg(units_sold) + stddev_samp(units_sold), 4) AS band_hi
    FROM ctgt GROUP BY ALL""")
def _(s):
    stats = groups.units_by(s.calendar_target, "neighborhood_type", *_NEIGHBORHOOD)
    mean, std = F.col("mean_units"), F.col("std_units")
    return shown(stats.withColumns({"band_lo": mean - std, "band_hi": mean + std}))


@report("g10_category_perf", """SELECT category, round(avg(units_sold), 4) AS mean_units, count(*) AS "rows" FROM ctgt GROUP BY ALL""")
def _(s):
    return shown(groups.units_by(s.calendar_target, "category", "mean_units", "rows").orderBy(F.desc("mean_units"), "category"))


@report("g11_store_mean_total_target", "SELECT store_id, units, round(mean_units, 4) AS mean_units FROM smean")
def _(s):
    return shown(groups.store_means(s.calendar_target))


@report("g11_store_mean_total_grid", "SELECT store_id, units, round(mean_units, 4) AS mean_units FROM sgrid")
def _(s):
    return shown(groups.store_means(s.grid))


@report("g12_category_share", """SELECT category, sum(units_sold) AS units, round(100.0 * sum(units_sold) / (SELECT sum(units_sold) FROM grid), 1) AS pct
    FROM grid GROUP BY ALL""")
def _(s):
    return shown(groups.category_share(s.grid), 1)


@report("g13_hourly_units", """SELECT hour, round(avg(units_sold), 4) AS mean_units, count(*) AS "rows", sum(units_sold) AS units,
    round(stddev_samp(units_sold), 4) AS std_units FROM fact GROUP BY ALL""")
def _(s):
    return shown(groups.units_by(s.fact, "hour", "mean_units", "rows", "units", "std_units"))


@report("g14_hourly_by_category", _TOP.format(axis="hour", top="top4"))
def _(s):
    return shown(groups.top_category_profile(s.fact, "hour"))


@report("g15_hourly_revenue_volume", "SELECT hour, round(revenue, 4) AS revenue, units, round(mean_revenue, 2) AS mean_revenue FROM hours_rev")
def _(s):
    return shown(groups.hourly_revenue_volume(s.fact), mean_revenue=2)


@report("g16_discount_value_effect", """SELECT discount_applied, round(avg(units_sold), 4) AS mean_units, count(*) AS "rows" FROM fact GROUP BY ALL""")
def _(s):
    return shown(groups.discount_value_effect(s.fact))


@report("g16_discount_bracket_effect", """SELECT CAST(floor(discount_applied / 10) AS BIGINT) AS bracket, round(avg(units_sold), 4) AS mean_units
    FROM fact GROUP BY ALL""")
def _(s):
    return shown(groups.discount_bracket_effect(s.fact))


@report("g17_payment_mix", """SELECT payment_method, count(*) AS orders, round(100.0 * count(*) / (SELECT count(*) FROM c_ord), 4) AS pct
    FROM c_ord GROUP BY ALL""")
def _(s):
    return shown(groups.payment_mix(s.order))


@report("g17_payment_revenue", """SELECT payment_method, round(sum(revenue), 4) AS revenue, round(avg(revenue), 2) AS mean_revenue
    FROM c_txn JOIN c_ord USING (order_id) GROUP BY ALL""")
def _(s):
    return shown(groups.payment_revenue(s.transaction, s.order), mean_revenue=2)


@report("g18_orders_by_hour", "SELECT hour, count(*) AS orders FROM c_ord GROUP BY ALL")
def _(s):
    return groups.orders_by_hour(s.order)


@report("g19_member_mix", """SELECT customer_id IS NOT NULL AS is_member, count(*) AS orders,
    round(100.0 * count(*) / (SELECT count(*) FROM c_ord), 4) AS pct FROM c_ord GROUP BY ALL""")
def _(s):
    return shown(groups.member_mix(s.order))


@report("g19_member_revenue", """SELECT customer_id IS NOT NULL AS is_member, round(sum(revenue), 4) AS revenue, count(*) AS lines
    FROM c_txn JOIN c_ord USING (order_id) GROUP BY ALL""")
def _(s):
    return shown(groups.member_revenue(s.transaction, s.order))


@report("g20_neighborhood_counts", 'SELECT neighborhood_type, count(*) AS "rows" FROM c_store GROUP BY ALL')
def _(s):
    return groups.value_counts_of(s.store, "neighborhood_type")


@report("g20_drive_through_counts", 'SELECT has_drive_through, count(*) AS "rows" FROM c_store GROUP BY ALL')
def _(s):
    return groups.value_counts_of(s.store, "has_drive_through")


@report("g20_promo_type_counts", 'SELECT promo_type, count(*) AS "rows" FROM c_promo GROUP BY ALL')
def _(s):
    return groups.value_counts_of(s.promotion, "promo_type")


@report("g20_event_type_counts", 'SELECT event_type, count(*) AS "rows" FROM c_evt GROUP BY ALL')
def _(s):
    return groups.value_counts_of(s.local_event, "event_type")


@report("g20_category_counts", 'SELECT category, count(*) AS "rows" FROM c_prod GROUP BY ALL')
def _(s):
    return groups.value_counts_of(s.product, "category")


@report("g21_store_revenue", "SELECT store_id, round(sum(revenue), 4) AS revenue FROM fact GROUP BY ALL")
def _(s):
    return shown(groups.revenue_by(s.fact, "store_id"))


@report("g21_category_revenue", "SELECT category, round(sum(revenue), 4) AS revenue FROM fact GROUP BY ALL")
def _(s):
    return shown(groups.revenue_by(s.fact, "category"))


@report("g22_store_metrics", """SELECT store_id, round(avg(units_sold), 4) AS mean_units, round(avg(revenue), 2) AS mean_revenue,
    count(DISTINCT order_id) AS transactions FROM fact GROUP BY ALL""")
def _(s):
    return shown(groups.store_metrics(s.fact), mean_revenue=2)


@report("g23_store_activity", "SELECT store_id, count(order_id) AS orders, count(DISTINCT hour) AS hours_active FROM fact GROUP BY ALL")
def _(s):
    return groups.store_activity(s.fact)


@report("g24_store_efficiency", """SELECT store_id, round(sum(revenue), 4) AS revenue, count(DISTINCT order_id) AS orders,
    round(sum(revenue) / count(DISTINCT order_id), 2) AS revenue_per_order FROM fact GROUP BY ALL""")
def _(s):
    return shown(groups.store_efficiency(s.fact), revenue_per_order=2)


@report("g25_store_profitability", """SELECT store_id, neighborhood_type, round(sum(revenue), 4) AS revenue, sum(units_sold) AS units,
    count(DISTINCT customer_id) AS customers, round(sum(revenue) / nullif(count(DISTINCT customer_id), 0), 2) AS revenue_per_customer FROM fact GROUP BY ALL""")
def _(s):
    return shown(groups.store_profitability(s.fact, s.store), revenue_per_customer=2)


@report("g26_store_category_variety", "SELECT store_id, count(DISTINCT category) AS categories FROM tgt GROUP BY ALL")
def _(s):
    return groups.store_variety(s.target)


_CV = """SELECT store_id, round(stddev_samp(units_sold), 4) AS std_units, round(avg(units_sold), 4) AS mean_units,
    round(stddev_samp(units_sold) / nullif(avg(units_sold), 0), 4) AS cv FROM dstore GROUP BY ALL"""


@report("g27_demand_volatility", _CV)
def _(s):
    return shown(groups.demand_volatility(facts.daily_store(s.target)))


@report("g28_store_cv", "SELECT store_id, cv, neighborhood_type FROM (" + _CV + ") JOIN c_store USING (store_id)")
def _(s):
    """Each store's coefficient of variation over its days (over one mean per store it would always be undefined)."""
    cv = groups.demand_volatility(facts.daily_store(s.target)).select("store_id", "cv")
    return shown(cv.join(s.store.select("store_id", "neighborhood_type"), "store_id"))


@report("g29_revenue_volatility_month", """SELECT CAST(month(date) AS INT) AS month, round(stddev_samp(r), 2) AS std_revenue
    FROM (SELECT date, sum(revenue) AS r FROM fact GROUP BY ALL) GROUP BY ALL""")
def _(s):
    return shown(groups.revenue_volatility_month(s.fact), 2)


@report("g30_weekend_hour", "SELECT is_weekend, hour, round(avg(units_sold), 4) AS mean_units FROM fact GROUP BY ALL")
def _(s):
    return shown(groups.units_by(s.fact, ["is_weekend", "hour"], "mean_units"))


@report("g30_weekend_category", "SELECT is_weekend, category, round(avg(units_sold), 4) AS mean_units FROM fact GROUP BY ALL")
def _(s):
    return shown(groups.units_by(s.fact, ["is_weekend", "category"], "mean_units"))


@report("g30_weekend_totals", "SELECT is_weekend, round(sum(revenue), 4) AS revenue, count(*) AS lines FROM fact GROUP BY ALL")
def _(s):
    return shown(groups.weekday_weekend_totals(s.fact))


@report("g31_weekend_holiday_interaction", "SELECT is_weekend, is_holiday, round(avg(units_sold), 4) AS mean_units FROM ctgt GROUP BY ALL")
def _(s):
    return shown(groups.weekend_holiday_interaction(s.calendar_target))


@report("g31_weekend_holiday_matrix", """SELECT is_weekend, round(avg(units_sold) FILTER (NOT is_holiday), 4) AS regular,
    round(avg(units_sold) FILTER (is_holiday), 4) AS holiday FROM ctgt GROUP BY ALL""")
def _(s):
    return shown(groups.weekend_holiday_matrix(s.calendar_target))


@report("g32_discount_by_category", """SELECT category, round(avg(discount_applied), 4) AS mean_discount, max(discount_applied) AS max_discount,
    min(discount_applied) AS min_discount, count(*) AS "rows" FROM fact GROUP BY ALL""")
def _(s):
    return shown(groups.discount_by_category(s.fact))


@report("g33_discount_volume_lift", """SELECT round(avg(units_sold) FILTER (discount_applied = 0), 4) AS units_no_discount,
    round(avg(units_sold) FILTER (discount_applied > 0), 4) AS units_discount, round(avg(units_sold) FILTER (discount_applied = 0) * 100, 4) AS margin_no_discount,
    round(avg(units_sold) FILTER (discount_applied > 0) * 50, 4) AS margin_discount FROM c_txn""")
def _(s):
    return shown(groups.discount_volume_lift(s.transaction))


@report("g34_product_mix", """WITH m AS (SELECT category, round(sum(units_sold)) AS units, round(sum(revenue)) AS revenue, count(order_id) AS lines FROM fact GROUP BY ALL)
    SELECT *, round(revenue / units, 4) AS avg_price, round(units / sum(units) OVER () * 100, 4) AS units_pct,
    round(revenue / sum(revenue) OVER () * 100, 4) AS revenue_pct FROM m""")
def _(s):
    return shown(groups.product_mix(s.fact))


@report("g35_weekday_revenue", _WEEK.format(cols="round(x, 2) AS mean_revenue, lines", src="(SELECT weekday, avg(revenue) AS x, count(order_id) AS lines FROM fact GROUP BY ALL)"))
def _(s):
    return shown(ordered_weekday(groups.weekday_revenue(s.fact)), 2)


@report("g36_month_revenue", "SELECT month, round(avg(revenue), 2) AS mean_revenue, round(sum(revenue), 4) AS revenue FROM fact GROUP BY ALL")
def _(s):
    return shown(groups.month_revenue(s.fact), mean_revenue=2)


@report("g37_kpi_scorecard", """WITH f AS (SELECT sum(revenue) AS r, sum(units_sold) AS u, avg(revenue) AS m,
    (sum(revenue) FILTER (month > 9) - sum(revenue) FILTER (month <= 9)) / sum(revenue) FILTER (month <= 9) * 100 AS g FROM fact),
    d AS (SELECT avg(x) AS dr FROM (SELECT sum(revenue) AS x FROM fact GROUP BY date)),
    o AS (SELECT 100.0 * count(customer_id) / count(*) AS mp FROM c_ord)
    SELECT round(r, 2) AS total_revenue, round(dr, 2) AS mean_daily_revenue, u AS total_units, round(m, 2) AS mean_line_revenue,
    round(g, 2) AS growth_pct, round(mp, 2) AS member_pct, CASE WHEN mp > 30 THEN 'high' WHEN mp > 20 THEN 'medium' ELSE 'low' END AS member_band,
    CASE WHEN g > 0 THEN 'up' ELSE 'down' END AS direction FROM f, d, o""")
def _(s):
    return shown(groups.kpi_scorecard(s.fact, s.order), 2)


@report("g38_holiday_period_impact", """SELECT round(avg(revenue) FILTER (month NOT IN (1, 4, 5, 10, 12)), 2) AS regular_mean,
    round(avg(revenue) FILTER (month IN (1, 4, 5, 10, 12)), 2) AS holiday_mean FROM fact""")
def _(s):
    return shown(groups.holiday_period_impact(s.fact), 2)


@report("g39_data_readiness", """WITH n AS (SELECT (SELECT count(*) FROM c_store) AS stores, (SELECT count(DISTINCT category) FROM c_prod) AS categories,
    min(date) AS d0, date_diff('day', min(date), max(date)) + 1 AS days FROM tgt)
    SELECT round(100.0 * count(*) / any_value(n.stores * n.categories * n.days), 4) AS data_coverage,
    round(100.0 * count(DISTINCT t.store_id) / any_value(n.stores), 4) AS store_coverage,
    round(100.0 * count(DISTINCT t.category) / any_value(n.categories), 4) AS category_coverage,
    round(100.0 * count(DISTINCT t.date) / any_value(n.days), 4) AS date_range FROM tgt t CROSS JOIN n""")
def _(s):
    return shown(groups.data_readiness(s.target, s.store, s.product))


@report("g40_distinct_values", """SELECT DISTINCT 'neighborhood_type' AS "column", neighborhood_type AS value FROM fact UNION ALL
    SELECT DISTINCT 'category', category FROM fact UNION ALL SELECT DISTINCT 'store_id', CAST(store_id AS VARCHAR) FROM fact""")
def _(s):
    return groups.distinct_values(s.fact, "neighborhood_type", "category", "store_id")


@report("g41_store_attr_bar", """SELECT neighborhood_type, round(avg(mean_units), 4) AS mean_units, count(*) AS stores
    FROM sgrid JOIN c_store USING (store_id) GROUP BY ALL""")
def _(s):
    return shown(groups.attribute_bar(groups.neighborhood_of_stores(groups.store_means(s.grid), s.store)))


_TIMES = " + ".join(f"CAST(spot >= {edge} AS INT)" for edge in groups.poisson_edges())


@report("g41_store_attr_bar_interval", f"""WITH m AS (SELECT neighborhood_type, store_id, mean_units FROM sgrid JOIN c_store USING (store_id)),
    d AS (SELECT *, CAST('0x' || substr(md5('17:' || replicate || ':' || store_id), 1, 8) AS BIGINT) AS spot FROM m, range(1, 1001) AS r(replicate)),
    w AS (SELECT *, {_TIMES} AS times FROM d),
    b AS (SELECT neighborhood_type, replicate, sum(times * mean_units) / nullif(sum(times), 0) AS mean FROM w GROUP BY ALL),
    i AS (SELECT neighborhood_type, quantile_cont(mean, 0.025) AS ci_lo, quantile_cont(mean, 0.975) AS ci_hi FROM b GROUP BY ALL)
    SELECT neighborhood_type, round(avg(mean_units), 4) AS mean_units, count(*) AS stores, round(any_value(ci_lo), 4) AS ci_lo, round(any_value(ci_hi), 4) AS ci_hi
    FROM m JOIN i USING (neighborhood_type) GROUP BY neighborhood_type""")
def _(s):
    return shown(groups.attribute_bar_interval(groups.neighborhood_of_stores(groups.store_means(s.grid), s.store)))


@report("g21_top_categories_by_revenue", "SELECT category, round(sum(revenue), 4) AS revenue FROM fact GROUP BY ALL ORDER BY sum(revenue) DESC, category LIMIT 5")
def _(s):
    return shown(top_k(groups.revenue_by(s.fact, "category"), "category", "revenue", 5))
