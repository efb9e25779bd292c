"""Promotion, local event and stockout effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.operators import effects, facts
from demandgrid.operators.ranking import top_k
from demandgrid.plans.catalog import report, shown
from demandgrid.sources.sink import in_order

_MEANS = 'SELECT {flag}, round(avg(units_sold), 4) AS mean_units, count(*) AS "rows" FROM {source} GROUP BY ALL'
_EFFECT = """SELECT {flag}, round(avg(units_sold), 4) AS mean, round(median(units_sold), 4) AS median, round(stddev_samp(units_sold), 4) AS std,
    count(*) AS "rows" FROM {source} GROUP BY ALL"""
_COVERAGE = """WITH t AS (SELECT category FROM {source} GROUP BY category ORDER BY sum(units_sold) DESC, category LIMIT 4),
    g AS (SELECT category, {flag}, avg(units_sold) AS m, count(*) AS n FROM {source} JOIN t USING (category) GROUP BY ALL)
    SELECT category, {flag}, round(m, 4) AS mean_units, n AS "rows", round(100.0 * n / sum(n) OVER (PARTITION BY category), 4) AS coverage_pct FROM g"""


@report("f1_promo_effect_day", _MEANS.format(flag="has_promo", source="promo_day_tgt"))
def _(s):
    return shown(effects.day_flag_means(s.calendar_target, effects.promo_dates(s.promotion, s.date_dim), "has_promo"))


@report("f1_promo_effect_category", _COVERAGE.format(flag="has_promo", source="promo_day_tgt"))
def _(s):
    return shown(effects.category_flag_means(s.calendar_target, effects.promo_dates(s.promotion, s.date_dim), ["date"], "has_promo"))


@report("f2_promo_effect_daily_revenue", """SELECT d.date IN (SELECT date FROM promo_dates) AS has_promo, round(avg(r), 2) AS mean_daily_revenue, count(*) AS days
    FROM (SELECT date, sum(revenue) AS r FROM fact GROUP BY date) d GROUP BY ALL""")
def _(s):
    return shown(effects.promo_daily_revenue(s.fact, s.promotion, s.date_dim), 2)


@report("f3_promo_effect_cell", _EFFECT.format(flag="has_promo", source="promo_grid"))
def _(s):
    return shown(effects.effect(effects.promo_cells(s.grid, facts.promo_flag(s.promo_days)), "has_promo"))


@report("f4_promo_type_effect", """SELECT promo_type, round(avg(units_sold), 4) AS mean_units, count(*) AS promo_days
    FROM promo_long LEFT JOIN grid USING (store_id, category, date) GROUP BY ALL""")
def _(s):
    return shown(effects.promo_type_effect(s.promo_days, s.grid))


@report("f4_promo_type_effect_in_order", """SELECT promo_type, promo_days, row_number() OVER (ORDER BY m DESC, promo_type) AS "position"
    FROM (SELECT promo_type, avg(units_sold) AS m, count(*) AS promo_days FROM promo_long LEFT JOIN grid USING (store_id, category, date) GROUP BY ALL)""")
def _(s):
    types = effects.promo_type_effect(s.promo_days, s.grid)
    return in_order(types, "promo-types", F.desc("mean_units"), "promo_type").select("promo_type", "promo_days", "position")


def _event_target(s):
    return effects.flag_rows(s.calendar_target, effects.event_store_days(s.local_event), effects.STORE_DAY, "has_event")


@report("f5_event_effect_store_day", _MEANS.format(flag="has_event", source="evt_tgt"))
def _(s):
    return shown(effects.cell_effect(_event_target(s), "has_event"))


@report("f5_event_effect_category", _COVERAGE.format(flag="has_event", source="evt_tgt"))
def _(s):
    members = effects.event_store_days(s.local_event)
    return shown(effects.category_flag_means(s.calendar_target, members, effects.STORE_DAY, "has_event"))


@report("f6_event_effect_cell", _EFFECT.format(flag="has_event", source="evt_grid"))
def _(s):
    return shown(effects.effect(effects.event_cells(s.grid, s.local_event), "has_event"))


@report("f6_event_effect_cell_fanout", _EFFECT.format(flag="has_event", source="evt_grid_fan"))
def _(s):
    return shown(effects.effect(effects.event_cells(s.grid, s.local_event, dedupe=False), "has_event"))


@report("f7_event_effect_date", """SELECT date IN (SELECT date FROM evt_dates) AS has_event, round(sum(revenue)) AS revenue, round(avg(revenue)) AS mean_revenue,
    count(revenue) AS lines, round(sum(units_sold)) AS units, round(avg(units_sold)) AS mean_units FROM fact GROUP BY ALL""")
def _(s):
    return shown(effects.event_effect_date(s.fact, s.local_event), 0)


@report("f8_event_lift", """WITH x AS (SELECT avg(units_sold) FILTER (date IN (SELECT date FROM evt_dates)) AS b,
    avg(units_sold) FILTER (date NOT IN (SELECT date FROM evt_dates)) AS a FROM fact)
    SELECT round((b - a) / a * 100, 4) AS unit_lift_pct, round((b - a) / a * 100 * 0.8, 4) AS revenue_lift_pct FROM x""")
def _(s):
    return shown(effects.event_lift(s.fact, s.local_event))


@report("f9_events_per_store_top10", "SELECT store_id, count(*) AS events FROM c_evt GROUP BY ALL ORDER BY events DESC, store_id LIMIT 10")
def _(s):
    return effects.events_per_store(s.local_event, 10)


_RATE = 'SELECT {by}round(100.0 * count_if(is_stockout) / count(*), 4) AS stockout_pct, count(*) AS "rows" FROM {source} {group}'


@report("f10_stockout_line_rate", _RATE.format(by="", source="so_line", group=""))
def _(s):
    return shown(effects.stock_line_rate(effects.stock_lines(s.fact, s.inventory)))


@report("f10_stockout_line_rate_same_store", _RATE.format(by="", source="so_line_store", group=""))
def _(s):
    return shown(effects.stock_line_rate(effects.stock_lines(s.fact, s.inventory, with_store=True)))


@report("f10_stockout_line_rate_category", _RATE.format(by="category, ", source="so_line", group="GROUP BY category"))
def _(s):
    return shown(effects.stock_line_rate(effects.stock_lines(s.fact, s.inventory), "category"))


@report("f10_stockout_line_impact", """SELECT is_stockout, round(avg(units_sold), 4) AS mean, round(median(units_sold), 4) AS median, count(*) AS "rows"
    FROM so_line GROUP BY ALL""")
def _(s):
    return shown(effects.stock_line_impact(effects.stock_lines(s.fact, s.inventory)))


@report("f10_stockout_line_category_week", _RATE.format(by="category, week, ", source="so_line JOIN top4 USING (category)", group="GROUP BY category, week"))
def _(s):
    lines = effects.top_stock_lines(effects.stock_lines(s.fact, s.inventory))
    return shown(effects.stock_line_rate(lines, "category", "week"))


@report("f11_stockout_daily_rate", 'SELECT date, round(rate, 4) AS rate, CAST(stockouts AS BIGINT) AS stockouts, n AS "rows" FROM inv_rate')
def _(s):
    return shown(effects.stockout_daily_rate(s.inventory))


@report("f12_stockout_by_category", """SELECT category, round(avg(CAST(is_stockout AS DOUBLE)), 4) AS rate, CAST(count_if(is_stockout) AS BIGINT) AS stockouts
    FROM c_inv JOIN c_prod USING (product_id) GROUP BY ALL""")
def _(s):
    return shown(effects.stockout_by_category(s.inventory, s.product))


@report("f12_top5_stockout_categories", """SELECT category, CAST(count_if(is_stockout) AS BIGINT) AS stockouts
    FROM c_inv JOIN c_prod USING (product_id) GROUP BY ALL ORDER BY stockouts DESC, category LIMIT 5""")
def _(s):
    counts = effects.stockout_by_category(s.inventory, s.product).select("category", "stockouts")
    return top_k(counts, "category", "stockouts", 5)


@report("f13_stockout_week_rate", "SELECT CAST(week(date) AS INT) AS week, round(avg(rate), 4) AS rate FROM inv_rate GROUP BY ALL")
def _(s):
    return shown(effects.stockout_week_rate(s.inventory))


@report("f13_stockout_iso_week_rate", """SELECT CAST(isoyear(date) AS INT) AS iso_year, CAST(week(date) AS INT) AS week, round(avg(rate), 4) AS rate
    FROM inv_rate GROUP BY ALL""")
def _(s):
    return shown(effects.stockout_week_rate(s.inventory, with_year=True))


@report("f14_stockout_rate_store_day", 'SELECT round(avg(CAST(any_stockout AS DOUBLE)), 4) AS rate, count(*) AS "rows" FROM so_day')
def _(s):
    return shown(effects.flag_rate(facts.stockout_store_day(s.inventory), "any_stockout"))


@report("f14_stockout_rate_cell", 'SELECT round(avg(CAST(has_stockout AS DOUBLE)), 4) AS rate, count(*) AS "rows" FROM so_cell')
def _(s):
    return shown(effects.flag_rate(facts.stockout_store_cat_day(s.inventory, s.product), "has_stockout"))


@report("f14_stockout_rate_cell_category", 'SELECT category, round(avg(CAST(has_stockout AS DOUBLE)), 4) AS rate, count(*) AS "rows" FROM so_cell GROUP BY ALL')
def _(s):
    return shown(effects.flag_rate(facts.stockout_store_cat_day(s.inventory, s.product), "has_stockout", "category"))


@report("f15_stockout_effect_cell", _MEANS.format(flag="has_stockout", source="so_grid"))
def _(s):
    cells = effects.stockout_cells(s.grid, facts.stockout_store_cat_day(s.inventory, s.product))
    return shown(effects.cell_effect(cells, "has_stockout"))
