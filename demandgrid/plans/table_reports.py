"""Reports over single tables, projections, joins and the core derived relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.functions import calendar, columns
from demandgrid.operators import effects, facts, groups, profile
from demandgrid.operators.ranking import pareto_cumulative
from demandgrid.plans.catalog import report, shown
from demandgrid.plans.oracle import RELATIONS
from demandgrid.sources.schemas import CALENDAR_FLAGS, SCHEMAS
from demandgrid.sources.sink import with_bucketed_lines, write_result, write_text
from demandgrid.sources.star import load_tables, parse_failures

BUCKETS = 8  # of the bucketed lines in reports, fit for the test tables
_SQL_TABLES = {
    "transaction": "c_txn", "order": "c_ord", "product": "c_prod", "store": "c_store", "date_dim": "c_cal",
    "promotion": "c_promo", "local_event": "c_evt", "inventory": "c_inv", "customer": "c_cust", "submission": "c_sub",
}


# --- loading and profiling -------------------------------------------------------------------

@report("l1_load_tables", " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS "rows" FROM {r}""" for t, r in _SQL_TABLES.items()))
def _(s):
    tables = load_tables(s.store.sparkSession, write_text(s))
    return profile.row_counts(tables)


_DATE_COLUMNS = {
    "order": ["date"], "date_dim": ["date"], "promotion": ["start_date", "end_date"], "inventory": ["date"], "local_event": ["date"],
}


@report("l2_parse_dates", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", min({c}) AS "first", max({c}) AS "last", count(DISTINCT {c}) AS days FROM {_SQL_TABLES[t]}"""
    for t, cs in _DATE_COLUMNS.items() for c in cs
))
def _(s):
    tables = load_tables(s.store.sparkSession, write_text(s))
    return profile.date_columns({t: (tables[t], cs) for t, cs in _DATE_COLUMNS.items()})


@report("l2_parse_failures", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", CAST(0 AS BIGINT) AS failed FROM (SELECT count(*) FROM {r})"""
    for t, r in _SQL_TABLES.items() for c in SCHEMAS[t].names
))
def _(s):
    return parse_failures(s.store.sparkSession, write_text(s))


@report("l3_table_profile", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS "rows", {len(SCHEMAS[t].names)} AS cols,
    {"CASE WHEN count(customer_id) < count(*) THEN 'customer_id' END" if t == 'order' else 'CAST(NULL AS VARCHAR)'} AS "column",
    {"round(100.0 * (count(*) - count(customer_id)) / count(*), 1)" if t == 'order' else 'CAST(NULL AS DOUBLE)'} AS null_pct FROM {r}"""
    for t, r in _SQL_TABLES.items()
))
def _(s):
    return profile.table_profile(s.tables)


@report("l4_date_range_and_cardinality", """
SELECT 'order_first' AS measure, CAST(min(date) AS VARCHAR) AS value FROM c_ord UNION ALL
SELECT 'order_last', CAST(max(date) AS VARCHAR) FROM c_ord UNION ALL
SELECT 'stores', CAST(count(DISTINCT store_id) AS VARCHAR) FROM c_ord UNION ALL
SELECT 'inventory_first', CAST(min(date) AS VARCHAR) FROM c_inv UNION ALL
SELECT 'inventory_last', CAST(max(date) AS VARCHAR) FROM c_inv UNION ALL
SELECT 'products', CAST(count(DISTINCT product_id) AS VARCHAR) FROM c_txn""")
def _(s):
    return profile.date_range_and_cardinality(s.order, s.inventory, s.transaction)


@report("l4_products_per_category", 'SELECT category, count(*) AS "rows" FROM c_prod GROUP BY category')
def _(s):
    return groups.value_counts_of(s.product, "category")


@report("l5_head_orders", "SELECT * FROM c_ord ORDER BY order_id LIMIT 10")
def _(s):
    return profile.head(s.order, "order_id", 10)


@report("l5_head_submission", "SELECT * FROM c_sub ORDER BY id LIMIT 10")
def _(s):
    return profile.head(s.submission, "id", 10)


@report("l5_head_promotions", "SELECT * FROM c_promo ORDER BY product_id LIMIT 3")
def _(s):
    return profile.head(s.promotion, "product_id", 3)


@report("l5_show_stores", "SELECT * FROM c_store")
def _(s):
    return s.store.orderBy("store_id")


@report("l6_write_result", "SELECT category, month, sum(units_sold) AS units, round(avg(units_sold), 4) AS mean_units FROM fact GROUP BY ALL")
def _(s):
    spark = s.transaction.sparkSession
    name = f"category_month-{spark.sparkContext.applicationId}"
    path = write_result(groups.units_by(s.fact, ["category", "month"], "units", "mean_units"), name)
    return shown(spark.read.parquet(path))


# --- projections, predicates, derived columns ------------------------------------------------

@report("p1_column_subset", "SELECT order_id, store_id, date, hour FROM c_ord")
def _(s):
    return s.order.select("order_id", "store_id", "date", "hour")


@report("p2_calendar_features", """SELECT DISTINCT date, dayname(date) AS day_name, CAST(month(date) AS INT) AS month,
    CAST(week(date) AS INT) AS week, CAST(isoyear(date) AS INT) AS iso_year, CAST(isodow(date) - 1 AS INT) AS weekday FROM c_ord""")
def _(s):
    return calendar.calendar_features(s.order.select("date").distinct())


@report("p3_ordered_weekday", """SELECT w.weekday, dayname(DATE '2024-01-01' + CAST(w.weekday AS INT)) AS day_name, round(m.mean_units, 4) AS mean_units
    FROM (SELECT CAST(unnest(range(7)) AS INT) AS weekday) w LEFT JOIN
    (SELECT weekday, avg(units_sold) AS mean_units FROM ctgt GROUP BY weekday) m USING (weekday)""")
def _(s):
    return shown(calendar.ordered_weekday(groups.units_by(s.calendar_target, "weekday", "mean_units")))


@report("p4_bool_filter_split", """SELECT is_weekend, count(*) AS "rows", sum(units_sold) AS units FROM ctgt GROUP BY ALL""")
def _(s):
    return groups.bool_split(s.calendar_target, "is_weekend")


@report("p5_eq_and_filter", """SELECT category, is_payday, count(*) AS "rows", round(avg(units_sold), 4) AS mean_units FROM ctgt
    WHERE category = 'ECONOMY' AND is_payday GROUP BY ALL""")
def _(s):
    chosen = s.calendar_target.where((F.col("category") == "ECONOMY") & F.col("is_payday"))
    return shown(groups.units_by(chosen, ["category", "is_payday"], "rows", "mean_units"))


@report("p6_null_predicates", "SELECT customer_id IS NOT NULL AS is_member, count(*) AS orders FROM c_ord GROUP BY ALL")
def _(s):
    return s.order.groupBy(F.col("customer_id").isNotNull().alias("is_member")).agg(F.count("*").alias("orders"))


@report("p7_isin_membership", """SELECT date IN (SELECT date FROM promo_dates) AS on_promo_date, count(*) AS orders FROM c_ord GROUP BY ALL""")
def _(s):
    dates = effects.promo_dates(s.promotion, s.date_dim)
    per_day = s.order.groupBy("date").agg(F.count("*").alias("orders"))
    on = effects.rows_on(per_day, dates, ["date"]).withColumn("on_promo_date", F.lit(True))
    off = effects.rows_not_on(per_day, dates, ["date"]).withColumn("on_promo_date", F.lit(False))
    return on.unionByName(off).groupBy("on_promo_date").agg(F.sum("orders").alias("orders"))


@report("p8_month_in_list", """SELECT month(date) IN (1, 4, 5, 10, 12) AS holiday_month, count(*) AS lines FROM fact GROUP BY ALL""")
def _(s):
    flag = columns.month_is_holiday(F.col("date")).alias("holiday_month")
    return s.fact.groupBy(flag).agg(F.count("*").alias("lines"))


@report("p9_interval_predicate", """SELECT d.date, count(*) AS promos FROM c_days d JOIN c_promo p ON d.date BETWEEN p.start_date AND p.end_date
    GROUP BY ALL""")
def _(s):
    return effects.active_promos(s.promotion, s.date_dim)


@report("p10_fillna", """SELECT s.store_id, coalesce(n, 0) AS promotions, coalesce(r, 0.0) AS mean_discount FROM c_store s LEFT JOIN
    (SELECT store_id, count(*) AS n, round(avg(discount_pct), 4) AS r FROM c_promo GROUP BY ALL) USING (store_id)""")
def _(s):
    promotions = s.promotion.groupBy("store_id").agg(F.count("*").alias("promotions"), F.avg("discount_pct").alias("mean_discount"))
    filled = s.store.select("store_id").join(promotions, "store_id", "left")
    return shown(filled.fillna({"promotions": 0, "mean_discount": 0.0}))


@report("p11_log1p", "SELECT units_sold, round(ln(1 + units_sold), 4) AS log_units, count(*) AS cells FROM tgt GROUP BY ALL")
def _(s):
    per_value = s.target.groupBy("units_sold").agg(F.count("*").alias("cells"))
    return shown(per_value.withColumn("log_units", F.log1p("units_sold")))


@report("p12_ratio_per_row", "SELECT order_id, product_id, revenue / units_sold AS revenue_per_unit FROM c_txn WHERE discount_applied > 0")
def _(s):
    discounted = s.transaction.where("discount_applied > 0")
    return discounted.select("order_id", "product_id", columns.ratio(F.col("revenue"), F.col("units_sold")).alias("revenue_per_unit"))


@report("p13_gross_profit", """SELECT order_id, product_id, round(units_sold * (base_price * 0.4), 4) AS estimated_cost,
    round(revenue - units_sold * (base_price * 0.4), 4) AS gross_profit FROM fact""")
def _(s):
    cost = columns.estimated_cost(F.col("units_sold"), F.col("base_price"))
    return shown(s.fact.select("order_id", "product_id", cost.alias("estimated_cost"), (F.col("revenue") - cost).alias("gross_profit")))


@report("p14_bool_to_float", "SELECT date, " + ", ".join(f"CAST(CAST({f} AS INT) AS DOUBLE) AS {f}" for f in CALENDAR_FLAGS) + " FROM c_cal")
def _(s):
    return s.date_dim.select("date", *[columns.flag_as_double(F.col(f)).alias(f) for f in CALENDAR_FLAGS])


@report("p15_floor_div_bracket", """SELECT discount_applied, CAST(floor(discount_applied / 10) AS BIGINT) AS bracket, count(*) AS lines
    FROM c_txn GROUP BY ALL""")
def _(s):
    per_value = s.transaction.groupBy("discount_applied").agg(F.count("*").alias("lines"))
    return per_value.withColumn("bracket", columns.floor_bracket(F.col("discount_applied")))


@report("p16_unit_scaling", """SELECT category, round(sum(units_sold) / 1e3, 4) AS kilo_units, round(sum(revenue) / 1e6, 4) AS mega_revenue,
    round(sum(revenue) / 1e9, 4) AS giga_revenue FROM fact GROUP BY ALL""")
def _(s):
    sums = s.fact.groupBy("category").agg(F.sum("units_sold").alias("u"), F.sum("revenue").alias("r"))
    return shown(sums.select(
        "category", (F.col("u") / 1e3).alias("kilo_units"), (F.col("r") / 1e6).alias("mega_revenue"), (F.col("r") / 1e9).alias("giga_revenue")
    ))


@report("p17_threshold_class", """WITH r AS (SELECT store_id, sum(revenue) AS revenue FROM fact GROUP BY ALL),
    c AS (SELECT *, 100 * sum(revenue) OVER (ORDER BY revenue DESC, store_id) / sum(revenue) OVER () AS cum_pct FROM r)
    SELECT store_id, CASE WHEN cum_pct > 80 THEN 'tail' WHEN cum_pct > 50 THEN 'middle' ELSE 'head' END AS class FROM c""")
def _(s):
    return pareto_cumulative(groups.revenue_by(s.fact, "store_id"), "store_id", "revenue").select("store_id", "class")


@report("p18_rsplit_id", r"""SELECT id, regexp_extract(id, '^(.*)_([^_]*)_([^_]*)$', 1) AS store_cat,
    regexp_extract(id, '^(.*)_([^_]*)_([^_]*)$', 2) AS forecast_date, regexp_extract(id, '^(.*)_([^_]*)_([^_]*)$', 3) AS horizon FROM c_sub""")
def _(s):
    return profile.submission_parts(s.submission)


@report("p18_submission_summary", """WITH p AS (SELECT split_part(id, '_', -2) AS d FROM c_sub)
    SELECT count(*) AS "rows", count(DISTINCT d) AS dates, min(d) AS "first", max(d) AS "last" FROM p""")
def _(s):
    return profile.submission_summary(profile.submission_parts(s.submission))


@report("p18_horizon_counts", """SELECT split_part(id, '_', -1) AS horizon, count(*) AS "rows" FROM c_sub GROUP BY ALL""")
def _(s):
    return groups.value_counts_of(profile.submission_parts(s.submission), "horizon")


@report("p19_flatten_names", """SELECT hour, round(avg(units_sold), 4) AS units_sold_mean, max(units_sold) AS units_sold_max,
    round(avg(revenue), 2) AS revenue_mean, round(max(revenue), 2) AS revenue_max FROM fact GROUP BY ALL""")
def _(s):
    measures = [f(c).alias(f"{c}_{n}") for c in ("units_sold", "revenue") for n, f in (("mean", F.avg), ("max", F.max))]
    return shown(s.fact.groupBy("hour").agg(*measures), revenue_mean=2, revenue_max=2)


@report("p20_bin_label_format", """WITH b AS (SELECT min(discount_pct) AS a, (max(discount_pct) - min(discount_pct)) / 5 AS w, max(discount_pct) - min(discount_pct) AS r FROM c_promo),
    e AS (SELECT CAST(i AS INT) AS bin, a + (i - 1) * w - CASE WHEN i = 1 THEN r * 0.001 ELSE 0 END AS lo, a + i * w AS hi FROM b, range(1, 6) AS t(i))
    SELECT bin, concat(CAST(trunc(lo) AS INT), '-', CAST(trunc(hi) AS INT), '%') AS label FROM e""")
def _(s):
    from demandgrid.operators.distribution import cut_equal_width

    bins = cut_equal_width(s.promotion, "discount_pct", 5, {}, count=True, widen=False)
    return bins.select("bin", columns.range_label(F.col("lo"), F.col("hi")).alias("label"))


# --- joins -----------------------------------------------------------------------------------

@report("a1_master_fact", "SELECT * REPLACE (round(revenue, 4) AS revenue) FROM fact")
def _(s):
    return shown(s.fact)


@report("a1_master_fact_bucketed", "SELECT * REPLACE (round(revenue, 4) AS revenue) FROM fact")
def _(s):
    return shown(with_bucketed_lines(s, BUCKETS).fact)


@report("a1_master_fact_hourly", "SELECT units_sold, hour, date, neighborhood_type, weekday FROM hourly_line")
def _(s):
    lines = facts.hourly_fact(s.transaction, s.order, s.store)
    return lines.select("units_sold", "hour", "date", "neighborhood_type", "weekday")


@report("a1_events_hourly_store", """SELECT s.neighborhood_type, hour(ts) AS hour, event_type AS category, count(*) AS n, round(sum(value), 4) AS units
    FROM events JOIN c_store s ON s.store_id = user_id % 25 GROUP BY ALL""")
def _(s):
    from demandgrid.sources.driver_tables import hourly_events

    events = hourly_events(s.transaction.sparkSession, s.folder)
    joined = events.join(s.store.select("store_id", "neighborhood_type"), "store_id")
    counted = joined.groupBy("neighborhood_type", "hour", "category").agg(F.count("*").alias("n"), F.sum("units_sold").alias("units"))
    return shown(counted).withColumn("hour", F.col("hour").cast("long"))


@report("a2_left_join_calendar", "SELECT * FROM cgrid")
def _(s):
    return s.calendar_grid


@report("a3_inner_enrich", "SELECT s.*, round(m.mean_units, 4) AS mean_units FROM smean m JOIN c_store s USING (store_id)")
def _(s):
    return shown(groups.units_by(s.calendar_target, "store_id", "mean_units").join(s.store, "store_id"))


@report("a4_left_join_flag", """SELECT p.has_promo, e.has_event, x.has_stockout, count(*) AS cells, sum(p.units_sold) AS units
    FROM promo_grid p JOIN evt_grid e USING (store_id, category, date) JOIN so_grid x USING (store_id, category, date) GROUP BY ALL""")
def _(s):
    cells = effects.promo_cells(s.grid, facts.promo_flag(s.promo_days))
    cells = effects.event_cells(cells, s.local_event)
    cells = effects.stockout_cells(cells, facts.stockout_store_cat_day(s.inventory, s.product))
    return cells.groupBy("has_promo", "has_event", "has_stockout").agg(F.count("*").alias("cells"), F.sum("units_sold").alias("units"))


@report("a5_left_join_product", "SELECT * FROM promo_long")
def _(s):
    return s.promo_days


@report("a6_left_join_target", "SELECT p.*, g.units_sold FROM promo_long p LEFT JOIN grid g USING (store_id, category, date)")
def _(s):
    return effects.left_join_target(s.promo_days, s.grid)


@report("a7_semi_restrict", """SELECT customer_id IS NOT NULL AS is_member, count(*) AS lines, round(sum(revenue), 4) AS revenue
    FROM c_txn JOIN c_ord USING (order_id) GROUP BY ALL""")
def _(s):
    return shown(groups.member_revenue(s.transaction, s.order).select("is_member", "lines", "revenue"))


@report("a8_range_join_promo", "SELECT store_id, category, date, units_sold, has_promo FROM promo_day_tgt")
def _(s):
    flagged = effects.flag_rows(s.target, effects.promo_dates(s.promotion, s.date_dim), ["date"], "has_promo")
    return flagged.select(*facts.CELL, "units_sold", "has_promo")


@report("a9_date_set_join", """SELECT o.date, o.date IN (SELECT date FROM promo_dates) AS has_promo, o.date IN (SELECT date FROM evt_dates) AS has_event,
    round(sum(revenue), 4) AS revenue FROM fact o GROUP BY ALL""")
def _(s):
    days = groups.daily_revenue(s.fact)
    days = effects.flag_rows(days, effects.promo_dates(s.promotion, s.date_dim), ["date"], "has_promo")
    return shown(effects.flag_rows(days, effects.event_dates(s.local_event), ["date"], "has_event"))


@report("a10_event_key_join", "SELECT store_id, category, date, units_sold, has_event FROM evt_tgt")
def _(s):
    flagged = effects.flag_rows(s.target, effects.event_store_days(s.local_event), effects.STORE_DAY, "has_event")
    return flagged.select(*facts.CELL, "units_sold", "has_event")


@report("a11_cross_join_dims", "SELECT * FROM keys")
def _(s):
    return facts.grid_keys(s.target)


# --- core derived relations ------------------------------------------------------------------

@report("b1_daily_target", "SELECT * FROM tgt")
def _(s):
    return s.target


@report("b1_daily_target_calendar", "SELECT * FROM ctgt")
def _(s):
    return s.calendar_target


@report("b2_full_grid", "SELECT * FROM grid")
def _(s):
    return s.grid


@report("b3_grid_zero_rate", """SELECT count(*) AS cells, CAST(count_if(units_sold = 0) AS BIGINT) AS zero_cells,
    round(avg(CAST(units_sold = 0 AS DOUBLE)), 4) AS zero_rate FROM grid""")
def _(s):
    return shown(facts.grid_zero_rate(s.grid))


@report("b4_promo_daily_long", "SELECT * FROM promo_long")
def _(s):
    return s.promo_days


@report("b5_promo_flag", "SELECT * REPLACE (round(avg_discount, 4) AS avg_discount) FROM promo_flag")
def _(s):
    return shown(facts.promo_flag(s.promo_days))


@report("b6_stockout_store_day", "SELECT * FROM so_day")
def _(s):
    return facts.stockout_store_day(s.inventory)


@report("b7_stockout_store_cat_day", "SELECT * FROM so_cell")
def _(s):
    return facts.stockout_store_cat_day(s.inventory, s.product)


@report("b8_daily_total", "SELECT * FROM daily")
def _(s):
    return facts.daily_total(s.target)


@report("b8_daily_total_category", "SELECT date, category, sum(units_sold) AS units_sold FROM grid GROUP BY ALL")
def _(s):
    return facts.daily_total(s.grid, "category")


@report("b9_daily_store", "SELECT * FROM dstore")
def _(s):
    return facts.daily_store(s.target)


@report("b10_basket", "SELECT * FROM basket")
def _(s):
    return facts.baskets(s.transaction)


@report("b11_member_frequency", "SELECT * FROM freq")
def _(s):
    return facts.member_frequency(s.order)


assert all(name in RELATIONS for name in _SQL_TABLES.values())
