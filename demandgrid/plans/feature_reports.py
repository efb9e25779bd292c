"""Forecasting features and their error metric."""

from __future__ import annotations


from demandgrid.operators import effects, facts, features
from demandgrid.plans.catalog import report, shown

_SERIES = "PARTITION BY store_id, category ORDER BY date"


@report("r1_lag_features", "SELECT store_id, category, date, units_sold, " + ", ".join(
    f"lag(units_sold, {n}) OVER ({_SERIES}) AS lag_{n}" for n in features.LAGS) + " FROM grid")
def _(s):
    return features.lag_features(s.grid)


def _past(days: int, gap: int = 1) -> str:
    return f"({_SERIES} ROWS BETWEEN {days + gap - 1} PRECEDING AND {gap} PRECEDING)"


@report("r2_rolling_features", "SELECT store_id, category, date, units_sold, " + ", ".join(
    f"CASE WHEN count(*) OVER {_past(w)} = {w} THEN round(avg(units_sold) OVER {_past(w)}, 4) END AS rolling_{w}_mean" for w in features.WINDOWS)
    + f", CASE WHEN count(*) OVER {_past(7)} = 7 THEN round(stddev_samp(units_sold) OVER {_past(7)}, 4) END AS rolling_7_std FROM grid")
def _(s):
    return shown(features.rolling_features(s.grid))


@report("r3_horizon_safe_features", " UNION ALL ".join(
    f"SELECT store_id, category, date, CAST({h} AS INT) AS horizon, units_sold, "
    + ", ".join((f"lag(units_sold, {n}) OVER ({_SERIES})" if n >= h else "CAST(NULL AS DOUBLE)") + f" AS lag_{n}" for n in features.LAGS)
    + f", CASE WHEN count(*) OVER {_past(7, h)} = 7 THEN round(avg(units_sold) OVER {_past(7, h)}, 4) END AS rolling_mean FROM grid"
    for h in features.HORIZONS))
def _(s):
    return shown(features.horizon_safe_features(s.grid))


@report("r4_calendar_store_features", """WITH p AS (SELECT store_id, category, date, avg(discount_pct) AS avg_discount,
    string_agg(DISTINCT promo_type, ',' ORDER BY promo_type) AS promo_types FROM promo_long GROUP BY ALL)
    SELECT g.store_id, g.category, g.date, g.units_sold, p.date IS NOT NULL AS has_promo, round(p.avg_discount, 4) AS avg_discount, coalesce(p.promo_types, '') AS promo_types,
    e.has_event AS has_local_event, lag(x.has_stockout) OVER (PARTITION BY g.store_id, g.category ORDER BY g.date) AS yesterday_stockout,
    c.is_weekend, c.is_holiday, c.is_payday, c.is_school_break, c.is_rainy_season, c.month, CAST(isodow(g.date) - 1 AS INT) AS weekday,
    s.neighborhood_type, s.seating_capacity, s.staff_count, s.has_drive_through
    FROM grid g LEFT JOIN p USING (store_id, category, date) JOIN evt_grid e USING (store_id, category, date)
    JOIN so_grid x USING (store_id, category, date) LEFT JOIN c_cal c USING (date) LEFT JOIN c_store s USING (store_id)""")
def _(s):
    stockouts = facts.stockout_store_cat_day(s.inventory, s.product)
    return shown(features.calendar_store_features(s.grid, s.date_dim, s.store, s.promo_days, s.local_event, stockouts))


@report("r5_weekday_encoding", "SELECT date, " + ", ".join(f"CAST(isodow(date) - 1 = {i} AS INT) AS weekday_{i}" for i in range(7))
    + ", round(sin((isodow(date) - 1) * 2 * pi() / 7), 4) AS weekday_sin, round(cos((isodow(date) - 1) * 2 * pi() / 7), 4) AS weekday_cos FROM c_cal")
def _(s):
    return shown(features.weekday_encoding(s.date_dim.select("date")))


@report("r6_target_encode", f"""SELECT store_id, category, date, units_sold,
    round(avg(units_sold) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 8) AS past_mean FROM grid""")
def _(s):
    return shown(features.target_encode(s.grid), 8)


@report("r7_mae_eval", "SELECT horizon, round(avg(abs(units_sold - predicted)), 4) AS mae, count(predicted) AS \"rows\" FROM ("
    + " UNION ALL ".join(f"SELECT CAST({h} AS INT) AS horizon, units_sold, lag(units_sold, 7) OVER ({_SERIES}) AS predicted FROM grid" for h in features.HORIZONS)
    + ") GROUP BY horizon")
def _(s):
    return shown(features.mae_eval(features.seasonal_prediction(s.grid)))


@report("r8_stockout_weight", """SELECT store_id, category, date, units_sold, has_stockout, CASE WHEN has_stockout THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM so_grid""")
def _(s):
    cells = effects.stockout_cells(s.grid, facts.stockout_store_cat_day(s.inventory, s.product))
    return features.stockout_weight(cells)


