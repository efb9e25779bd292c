"""Times headline reports: one warm-up, then the median of three runs each; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import time

from demandgrid.plans import REPORTS
from demandgrid.session import build_session
from demandgrid.sources.driver_tables import driver_star

HEADLINE = [
    "a1_master_fact", "b1_daily_target", "b2_full_grid", "c1_corr_matrix", "d1_hist_revenue_50", "d1_hist_target",
    "d3_summary_target", "d7_qq_normal_fit", "d8_box_target_flags", "d10_quantile_bins", "d12_cut_explicit",
    "f1_promo_effect_category", "f3_promo_effect_cell", "f10_stockout_line_impact", "g1_category_summary",
    "g2_category_monthly_mean", "g3_flag_means_target", "g22_store_metrics", "g25_store_profitability", "g37_kpi_scorecard",
    "r2_rolling_features", "t1_rolling_trailing_7", "t5_acf_pearson", "w5_hour_neighborhood_weekday", "w8_basket_segments",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        app="bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        start = time.perf_counter()
        REPORTS[name].build(driver_star(spark, folder)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINE:
        seconds(name)
        times[name] = round(statistics.median(seconds(name) for _ in range(repeats)), 3)
    print(json.dumps({
        "metric": "sum of median seconds over headline reports", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
