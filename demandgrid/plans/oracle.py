"""SQL twins of the canonical relations, and templates for the repeated report shapes.

Written for DuckDB over the same parquet tables. Every report names the relations it reads;
:func:`sql` puts those, and what they read in turn, in front of it as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

FLAGS = ["is_weekend", "is_holiday", "is_payday", "is_school_break", "is_rainy_season"]

RELATIONS: dict[str, str] = {
    "c_txn": """SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS units_sold,
        l_extendedprice * (1 - l_discount) AS revenue, round(l_discount * 500) AS discount_applied FROM lineitem""",
    "c_ord": """SELECT o_orderkey AS order_id, CAST(o_orderkey % 25 AS INT) AS store_id, CAST(o_orderdate AS DATE) AS date,
        CAST(6 + (o_orderkey * 31 + o_custkey) % 16 AS INT) AS hour,
        CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS customer_id, o_orderpriority AS payment_method FROM orders""",
    "c_prod": "SELECT p_partkey AS product_id, p_type AS category, p_retailprice AS base_price FROM part",
    "c_store": """SELECT n_nationkey AS store_id, r_name AS neighborhood_type,
        CAST(20 + (n_nationkey * 37) % 60 AS INT) AS seating_capacity, CAST(3 + (n_nationkey * 11) % 13 AS INT) AS staff_count,
        n_nationkey % 3 = 0 AS has_drive_through FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "c_span": "SELECT min(CAST(o_orderdate AS DATE)) AS d0, max(CAST(o_orderdate AS DATE)) AS d1 FROM orders",
    "c_days": "SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM c_span",
    "c_cal": """SELECT date, isodow(date) >= 6 AS is_weekend,
        strftime(date, '%m-%d') IN ('01-01','04-13','04-14','04-15','05-01','12-05','12-31') AS is_holiday,
        (day(date) IN (15, 25) OR date = last_day(date)) AS is_payday, month(date) IN (3, 4, 10) AS is_school_break,
        month(date) BETWEEN 5 AND 10 AS is_rainy_season, dayname(date) AS day_of_week, CAST(month(date) AS INT) AS month FROM c_days""",
    "c_promo": """SELECT CAST(floor(p_partkey / 10.0) % 25 AS INT) AS store_id, p_partkey AS product_id,
        CASE p_size % 4 WHEN 0 THEN 'bundle' WHEN 1 THEN 'discount' WHEN 2 THEN 'bogo' ELSE 'happy_hour' END AS promo_type,
        CAST(5 + 5 * (floor(p_partkey / 10.0) % 9) AS DOUBLE) AS discount_pct,
        DATE '1995-01-01' + CAST((p_partkey * 13) % 2300 AS INT) AS start_date,
        DATE '1995-01-01' + CAST((p_partkey * 13) % 2300 AS INT) + CAST(p_size % 14 AS INT) AS end_date
        FROM part WHERE p_partkey % 10 = 0""",
    "c_evt": """SELECT CAST(o_orderkey % 25 AS INT) AS store_id, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS event_type
        FROM orders WHERE o_orderkey % 97 = 0 UNION ALL
        SELECT CAST(o_orderkey % 25 AS INT), CAST(o_orderdate AS DATE), 'REPEAT' FROM orders WHERE o_orderkey % 970 = 0""",
    "c_inv": """SELECT store_id, product_id, date, bool_or(units_sold >= 46) AS is_stockout
        FROM c_txn JOIN c_ord USING (order_id) GROUP BY ALL""",
    "c_cust": "SELECT c_custkey AS customer_id, c_mktsegment AS segment, c_acctbal AS balance FROM customer",
    "c_sub": """SELECT concat(store_id, '_', category, '_', CAST(d1 - CAST(back AS INT) AS DATE), '_', h, 'd') AS id
        FROM c_store, (SELECT DISTINCT category FROM c_prod), c_span, range(0, 61) AS r(back), (VALUES (1), (3), (7)) AS v(h)""",
    "fact": """SELECT t.*, o.store_id, o.date, o.hour, o.customer_id, o.payment_method, p.category, p.base_price,
        s.neighborhood_type, s.seating_capacity, s.staff_count, s.has_drive_through,
        c.is_weekend, c.is_holiday, c.is_payday, c.is_school_break, c.is_rainy_season, dayname(o.date) AS day_of_week,
        CAST(month(o.date) AS INT) AS month, CAST(week(o.date) AS INT) AS week, CAST(isodow(o.date) - 1 AS INT) AS weekday
        FROM c_txn t JOIN c_ord o USING (order_id) JOIN c_prod p USING (product_id) JOIN c_store s USING (store_id)
        JOIN c_cal c ON c.date = o.date""",
    "tgt": """SELECT store_id, category, date, sum(units_sold) AS units_sold
        FROM c_txn JOIN c_ord USING (order_id) JOIN c_prod USING (product_id) GROUP BY ALL""",
    "ctgt": """SELECT t.*, c.is_weekend, c.is_holiday, c.is_payday, c.is_school_break, c.is_rainy_season, s.neighborhood_type,
        CAST(month(t.date) AS INT) AS month, CAST(isodow(t.date) - 1 AS INT) AS weekday
        FROM tgt t JOIN c_cal c USING (date) JOIN c_store s USING (store_id)""",
    "keys": """SELECT store_id, category, CAST(d AS DATE) AS date FROM (SELECT DISTINCT store_id FROM tgt),
        (SELECT DISTINCT category FROM tgt),
        (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM tgt)""",
    "grid": """SELECT k.store_id, k.category, k.date, coalesce(t.units_sold, 0.0) AS units_sold
        FROM keys k LEFT JOIN tgt t ON t.store_id = k.store_id AND t.category = k.category AND t.date = k.date""",
    "cgrid": "SELECT g.*, c.* EXCLUDE (date) FROM grid g LEFT JOIN c_cal c USING (date)",
    "promo_long": """SELECT o.store_id, p.category, CAST(o.d AS DATE) AS date, o.product_id, o.promo_type, o.discount_pct
        FROM (SELECT p.*, unnest(generate_series(greatest(start_date, d0), least(end_date, d1), INTERVAL 1 DAY)) AS d FROM c_promo p, c_span) o
        LEFT JOIN c_prod p USING (product_id)""",
    "promo_flag": """SELECT store_id, category, date, count(discount_pct) AS promos, avg(discount_pct) AS avg_discount
        FROM promo_long GROUP BY ALL""",
    "promo_dates": "SELECT DISTINCT date FROM promo_long",
    "evt_dates": "SELECT DISTINCT date FROM c_evt",
    "evt_days": "SELECT DISTINCT store_id, date FROM c_evt",
    "so_day": "SELECT store_id, date, bool_or(is_stockout) AS any_stockout FROM c_inv GROUP BY ALL",
    "so_cell": """SELECT store_id, category, date, bool_or(is_stockout) AS has_stockout
        FROM c_inv JOIN c_prod USING (product_id) GROUP BY ALL""",
    "daily": "SELECT date, sum(units_sold) AS units_sold FROM tgt GROUP BY date",
    "daily_grid": "SELECT date, sum(units_sold) AS units_sold FROM grid GROUP BY date",
    "dstore": "SELECT store_id, date, sum(units_sold) AS units_sold FROM tgt GROUP BY ALL",
    "basket": "SELECT order_id, sum(units_sold) AS units, count(product_id) AS lines FROM c_txn GROUP BY ALL",
    "freq": "SELECT customer_id, count(order_id) AS orders FROM c_ord WHERE customer_id IS NOT NULL GROUP BY ALL",
    "smean": "SELECT store_id, sum(units_sold) AS units, avg(units_sold) AS mean_units FROM ctgt GROUP BY ALL",
    "sgrid": "SELECT store_id, sum(units_sold) AS units, avg(units_sold) AS mean_units FROM grid GROUP BY ALL",
    "top4": "SELECT category FROM fact GROUP BY category ORDER BY sum(units_sold) DESC, category LIMIT 4",
    "top4rows": "SELECT category FROM fact GROUP BY category ORDER BY count(*) DESC, category LIMIT 4",
    "promo_day_tgt": "SELECT t.*, t.date IN (SELECT date FROM promo_dates) AS has_promo FROM ctgt t",
    "evt_tgt": "SELECT t.*, d.date IS NOT NULL AS has_event FROM ctgt t LEFT JOIN evt_days d ON d.store_id = t.store_id AND d.date = t.date",
    "promo_grid": """SELECT g.*, coalesce(f.promos > 0, false) AS has_promo FROM grid g LEFT JOIN promo_flag f
        ON f.store_id = g.store_id AND f.category = g.category AND f.date = g.date""",
    "evt_grid": """SELECT g.*, d.date IS NOT NULL AS has_event FROM grid g LEFT JOIN evt_days d
        ON d.store_id = g.store_id AND d.date = g.date""",
    "evt_grid_fan": """SELECT g.*, d.date IS NOT NULL AS has_event FROM grid g LEFT JOIN c_evt d
        ON d.store_id = g.store_id AND d.date = g.date""",
    "so_grid": """SELECT g.*, coalesce(c.has_stockout, false) AS has_stockout FROM grid g LEFT JOIN so_cell c
        ON c.store_id = g.store_id AND c.category = g.category AND c.date = g.date""",
    "so_line": """SELECT f.category, f.week, f.units_sold, coalesce(i.is_stockout, false) AS is_stockout FROM fact f
        LEFT JOIN c_inv i ON i.product_id = f.product_id AND i.date = f.date""",
    "so_line_store": """SELECT f.category, f.week, f.units_sold, coalesce(i.is_stockout, false) AS is_stockout FROM fact f
        LEFT JOIN c_inv i ON i.product_id = f.product_id AND i.date = f.date AND i.store_id = f.store_id""",
    "inv_rate": """SELECT date, avg(CAST(is_stockout AS DOUBLE)) AS rate, count_if(is_stockout) AS stockouts,
        count(is_stockout) AS n FROM c_inv GROUP BY date""",
    "hours_rev": """SELECT hour, sum(revenue) AS revenue, sum(units_sold) AS units, avg(revenue) AS mean_revenue FROM fact GROUP BY hour""",
    "hourly_line": """SELECT t.units_sold, o.hour, o.date, s.neighborhood_type, CAST(isodow(o.date) - 1 AS INT) AS weekday
        FROM c_txn t JOIN c_ord o USING (order_id) JOIN c_store s USING (store_id)""",
    "hour_stats": """SELECT hour, neighborhood_type, weekday, avg(units_sold) AS mean, median(units_sold) AS median,
        coalesce(stddev_samp(units_sold), 0) AS std, min(units_sold) AS min, max(units_sold) AS max FROM hourly_line GROUP BY ALL""",
    "trend": """SELECT date, units_sold, avg(units_sold) OVER w AS mean, stddev_samp(units_sold) OVER w AS std, count(*) OVER w AS n
        FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
}


def _needed(text: str, found: list[str]) -> None:
    for name, body in RELATIONS.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(body, found)
            found.append(name)


def sql(report: str) -> str:
    """The report with the relations it reads in front."""
    found: list[str] = []
    _needed(report, found)
    parts = [f"{name} AS ({RELATIONS[name]})" for name in found]
    report = report.strip()
    if report.upper().startswith("WITH "):
        parts.append(report[5:])
        return "WITH " + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + report


def hist_sql(source: str, value: str, bins: int, by: str = "", digits: int = 4) -> str:
    """Left-closed equal-width histogram with its empty bins."""
    keys, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    group = f"GROUP BY {by}" if by else ""
    match = f"c.bin = r.bin AND c.{by} = e.{by}" if by else "c.bin = r.bin"
    out = f"e.{by}, " if by else ""
    return f"""WITH d AS (SELECT {keys}CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL),
    m AS (SELECT {keys}min(v) AS a, max(v) AS z FROM d {group}),
    e AS (SELECT {keys}CASE WHEN a = z THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = z THEN z + 0.5 ELSE z END AS hi FROM m),
    p AS (SELECT {keys}v, lo, (hi - lo) / {bins} AS w, least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) AS b FROM d JOIN e {on}),
    c AS (SELECT {keys}CASE WHEN v < lo + b * w THEN b - 1 WHEN v >= lo + (b + 1) * w AND b < {bins - 1} THEN b + 1 ELSE b END AS bin,
        count(*) AS n FROM p GROUP BY ALL)
    SELECT {out}CAST(r.bin AS INT) AS bin, round(lo + r.bin * ((hi - lo) / {bins}), {digits}) AS lo,
        round(lo + (r.bin + 1) * ((hi - lo) / {bins}), {digits}) AS hi, CAST(coalesce(n, 0) AS BIGINT) AS "count"
    FROM e CROSS JOIN range({bins}) AS r(bin) LEFT JOIN c ON {match}"""


def box_sql(source: str, by: str = "", value: str = "units_sold") -> str:
    """Quartiles, whiskers and outliers, overall or per (comma-separated) key."""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    on = f"USING ({by})" if by else "ON true"
    return f"""WITH q AS (SELECT {keys}quantile_cont({value}, 0.25) AS q1, median({value}) AS med, quantile_cont({value}, 0.75) AS q3
        FROM {source} {group}),
    f AS (SELECT s.*, q1, med, q3, q1 - (q3 - q1) * 1.5 AS low, q3 + (q3 - q1) * 1.5 AS high FROM (SELECT * FROM {source}) s JOIN q {on})
    SELECT {keys}count(*) AS n, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
        round(least(min(CASE WHEN {value} >= low THEN {value} END), q1), 4) AS whisker_lo,
        round(greatest(max(CASE WHEN {value} <= high THEN {value} END), q3), 4) AS whisker_hi,
        CAST(count_if({value} < low OR {value} > high) AS BIGINT) AS outliers
    FROM f GROUP BY {keys}q1, med, q3"""


def describe_sql(source: str, value: str) -> str:
    return f"""SELECT count({value}) AS "count", round(avg({value}), 4) AS mean, round(stddev_samp({value}), 4) AS std,
        round(CAST(min({value}) AS DOUBLE), 4) AS "min", round(quantile_cont({value}, 0.25), 4) AS q25, round(median({value}), 4) AS median,
        round(quantile_cont({value}, 0.75), 4) AS q75, round(CAST(max({value}) AS DOUBLE), 4) AS "max" FROM {source}"""


def flags_sql(source: str, select: str, flags: Sequence[str] = FLAGS) -> str:
    """The same aggregate under every flag, stacked."""
    return " UNION ALL ".join(
        f"SELECT '{flag}' AS flag, {flag} AS flag_value, {select} FROM {source} GROUP BY {flag}" for flag in flags
    )
