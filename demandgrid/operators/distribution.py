"""The tables behind histograms, box plots, binned summaries, skewness and normal plots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.columns import (
    all_known, equal_width_bin, estimated_cost, normal_quantile, percent, right_closed_bin,
)
from demandgrid.operators.quantiles import aggregated, attach, quantiles, rank_spans, value_counts
from demandgrid.session import spread

DISCOUNT_EDGES = [0, 10, 20, 30, 40, 100]
RANKS_PER_CHUNK = 100_000


def _bounds(data: DataFrame, by: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Least and greatest value per group as ``<prefix>lo`` and ``<prefix>hi``.

    A constant column gets half a unit each way.
    """
    ends = aggregated(data, by, *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{c}") for c in columns.values()])
    ends = ends.withColumnsRenamed({f"_{c}": c for c in columns.values()})
    pad = {c: F.when(F.col(c)["lo"] == F.col(c)["hi"], 0.5).otherwise(0.0) for c in columns.values()}
    return ends.select(
        *by,
        *[(F.col(c)["lo"] - pad[c]).alias(f"{prefix}lo") for prefix, c in columns.items()],
        *[(F.col(c)["hi"] + pad[c]).alias(f"{prefix}hi") for prefix, c in columns.items()],
    )


def histogram(
    df: DataFrame, column: str | Column, bins: int, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """(by..., bin, lo, hi, count): left-closed bins of equal width over each group's range.

    Empty bins are kept. ``weight`` names a count column when ``df`` is already value counts.
    """
    value = F.col(column) if isinstance(column, str) else column
    count = F.col(weight) if weight else F.lit(1)
    data = df.select(*by, value.cast("double").alias("value"), count.cast("long").alias("n"))
    data = data.where(all_known(*by, "value"))
    bounds = _bounds(data, by, {"": "value"})
    lo, hi, number = F.col("lo"), F.col("hi"), F.col("bin")
    filled = attach(data, bounds, by).select(
        *by, "lo", "hi", equal_width_bin(F.col("value"), lo, hi, bins).alias("bin"), "n"
    )
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))
    empty = bounds.select(*by, "lo", "hi", F.explode(numbers).alias("bin"), F.lit(0).cast("long").alias("n"))
    width = (hi - lo) / bins
    return (
        filled.unionByName(empty)
        .where(lo.isNotNull())
        .groupBy(*by, "lo", "hi", "bin")
        .agg(F.sum("n").alias("count"))
        .select(
            *by,
            number.cast("int").alias("bin"),
            (lo + number * width).alias("lo"),
            (lo + (number + 1) * width).alias("hi"),
            "count",
        )
    )


def cumulative_histogram(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running count over the bins of :func:`histogram` (as many rows per group as bins)."""
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("running", F.sum("count").over(upto))


def binned_scatter(df: DataFrame, x: str, y: str, x_bins: int, y_bins: int) -> DataFrame:
    """Row-level scatter as counts on a grid of equal-width cells, with the cells' edges (occupied cells only).

    Rows are combined to distinct points first; the bounds and the cells both come from these, so ``df`` is computed once.
    """
    data = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(all_known("x", "y"))
    points = data.groupBy("x", "y").agg(F.count("*").alias("n"))
    placed = attach(points, _bounds(points, (), {"x_": "x", "y_": "y"}))
    sides = {"x": x_bins, "y": y_bins}
    numbers = [equal_width_bin(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), bins).cast("int").alias(f"{c}_bin") for c, bins in sides.items()]
    ends = ["x_lo", "x_hi", "y_lo", "y_hi"]
    cells = placed.select(*numbers, *ends, "n").groupBy("x_bin", "y_bin", *ends).agg(F.sum("n").alias("count"))
    edges = {}
    for c, bins in sides.items():
        lo, width = F.col(f"{c}_lo"), (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / bins
        edges |= {f"{c}_lo": lo + F.col(f"{c}_bin") * width, f"{c}_hi": lo + (F.col(f"{c}_bin") + 1) * width}
    return cells.withColumns(edges).select("x_bin", "y_bin", *ends, "count")


def zero_vs_positive(df: DataFrame, column: str = "units_sold") -> DataFrame:
    value = F.col(column)
    return df.agg(
        F.count_if(value == 0).alias("zero"),
        F.count_if(value > 0).alias("positive"),
        percent(F.count_if(value == 0), F.count("*")).alias("zero_pct"),
    )


def skewness(df: DataFrame, column: str = "units_sold") -> DataFrame:
    """Both skewness definitions: the moment ratio and its correction for sample bias."""
    n, biased = F.count(column).cast("double"), F.skewness(column)
    corrected = F.when(n > 2, F.try_divide(biased * F.sqrt(n * (n - 1)), n - 2))
    return df.agg(biased.alias("skew_biased"), corrected.alias("skew_corrected"))


def boxplot_stats(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at the furthest value within 1.5 IQR, and outliers per group."""
    quartiles = quantiles(counts, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    boxed = attach(counts, quartiles, by)
    value, q1, q3 = F.col("value"), F.col("q1"), F.col("q3")
    reach = (q3 - q1) * 1.5
    low_fence, high_fence = q1 - reach, q3 + reach
    inside = (value >= low_fence) & (value <= high_fence)
    return (
        boxed.groupBy(*by, "q1", "median", "q3")
        .agg(
            F.sum("n").alias("n"),
            F.least(F.min(F.when(value >= low_fence, value)), q1).alias("whisker_lo"),
            F.greatest(F.max(F.when(value <= high_fence, value)), q3).alias("whisker_hi"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
        )
        .select(*by, "n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "outliers")
    )


def flag_value_counts(df: DataFrame, column: str, flags: Sequence[str]) -> DataFrame:
    """Value counts under each of several flags at once: (flag, flag_value, value, n).

    Rows are combined over all flags before the flags are unfolded.
    """
    combined = df.groupBy(*flags, F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    pairs = ", ".join(f"'{flag}', {flag}" for flag in flags)
    long = combined.selectExpr("value", "n", f"stack({len(flags)}, {pairs}) AS (flag, flag_value)")
    return long.where(all_known("flag_value", "value")).groupBy("flag", "flag_value", "value").agg(F.sum("n").alias("n"))


def quantile_bins(counts: DataFrame, bins: int) -> DataFrame:
    """Counts in quantile bins; equal edges are merged, so fewer than ``bins`` may result."""
    names = [f"e{i}" for i in range(bins + 1)]
    edges = quantiles(counts, {name: i / bins for i, name in enumerate(names)}).select(
        F.array_distinct(F.array(*names)).alias("edges")
    )
    below = F.size(F.filter("edges", lambda e: e < F.col("value")))
    placed = attach(counts, edges).select("edges", F.greatest(below, F.lit(1)).alias("bin"), "n")
    every = edges.where(F.size("edges") > 1).select(
        "edges", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"), F.lit(0).cast("long").alias("n")
    )
    filled = placed.unionByName(every).where(F.size("edges") > 1).groupBy("edges", "bin").agg(F.sum("n").alias("count"))
    at = F.col("bin")
    return filled.select("bin", F.element_at("edges", at).alias("lo"), F.element_at("edges", at + 1).alias("hi"), "count")


def cut_equal_width(
    df: DataFrame, column: str, bins: int, means: Mapping[str, Column], count: bool = False, widen: bool = True
) -> DataFrame:
    """Means of the given row values (and on request the ``count`` of rows) over right-closed bins of equal width.

    The lowest edge sits 0.1 % of the range below the minimum, so that the minimum is inside. Rows are combined to
    sums per distinct value of ``column`` first; bounds and bins both come from these, so ``df`` is computed once.

    A constant column gets 0.1 % of its value each way, and a column without values no bins. With ``widen`` off, all edges
    of a constant column are its value, with its rows in the first bin, and a column without values has bins with NULL edges.
    """
    value = F.col("_value")
    sums = [f(row).alias(f"{name}_{part}") for name, row in means.items() for part, f in (("sum", F.sum), ("n", F.count))]
    known = df.withColumn("_value", F.col(column).cast("double")).where(value.isNotNull()).groupBy("_value").agg(*sums, *[F.count("*").alias("_n")] * count)
    measures = {"count": F.sum("_n")} if count else {}
    measures |= {name: F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n")) for name in means}
    lo, hi = F.col("_lo"), F.col("_hi")
    ends = aggregated(known, (), F.min(value).alias("least"), F.max(value).alias("most"))
    least, most = F.col("least"), F.col("most")
    pad = F.when(least != most, 0.0).otherwise(F.when(least != 0, F.abs(least) * 0.001).otherwise(0.001)) if widen else F.lit(0.0)
    ends = ends.select((least - pad).alias("_lo"), (most + pad).alias("_hi"), (most != least).alias("_spread"))
    width = (hi - lo) / bins
    number = F.least(F.greatest(F.ceil(F.try_divide(value - lo, width)), F.lit(1)), F.lit(bins)).cast("int")
    summed = attach(known, ends).groupBy(number.alias("bin")).agg(*[m.alias(name) for name, m in measures.items()])
    numbers = df.sparkSession.range(1, bins + 1, 1, 1).select(F.col("id").cast("int").alias("bin"))
    every = attach(numbers, ends).where(lo.isNotNull() | F.lit(not widen))
    low_edge = lo + (F.col("bin") - 1) * width
    lowered = F.when((F.col("bin") == 1) & F.col("_spread"), low_edge - (hi - lo) * 0.001).otherwise(low_edge)
    return every.join(summed, "bin", "left").select(
        "bin", lowered.alias("lo"), (lo + F.col("bin") * width).alias("hi"), *[F.coalesce("count", F.lit(0)).alias("count")] * count, *means
    )


def discount_bands(
    fact: DataFrame, edges: Sequence[float] = DISCOUNT_EDGES, with_undiscounted: bool = False
) -> DataFrame:
    """Units, revenue and estimated gross profit by right-closed discount band.

    Undiscounted lines belong to no band; ``with_undiscounted`` reports them as band 0.
    """
    band = right_closed_bin(F.col("discount_applied"), edges)
    if with_undiscounted:
        band = F.when(F.col("discount_applied") == 0, 0).otherwise(band)
    lo = F.array(*[F.lit(float(e)) for e in edges])
    profit = F.col("revenue") - estimated_cost(F.col("units_sold"), F.col("base_price"))
    return (
        fact.withColumn("bin", band)
        .where(all_known("bin"))
        .groupBy("bin")
        .agg(
            F.avg("units_sold").alias("mean_units"),
            F.count("units_sold").alias("lines"),
            F.avg("revenue").alias("mean_revenue"),
            F.sum("revenue").alias("revenue"),
            F.avg(profit).alias("mean_gross_profit"),
        )
        .withColumns(
            {"lo": F.when(F.col("bin") > 0, F.get(lo, F.col("bin") - 1)).otherwise(0.0), "hi": F.get(lo, F.col("bin"))}
        )
    )


def normal_plot(df: DataFrame, column: str = "units_sold") -> DataFrame:
    """Every observation in order against its normal quantile: (position, theoretical, value).

    Ranks come from value counts. A value that occurs often is unfolded in chunks that are
    spread over the cluster first, so no task unfolds a hot value alone.
    """
    spans = rank_spans(value_counts(df, column))
    chunks = spans.select(
        "value",
        "total",
        "last",
        F.explode(F.sequence("first", "last", F.lit(RANKS_PER_CHUNK))).alias("chunk"),
    )
    until = F.least(F.col("chunk") + (RANKS_PER_CHUNK - 1), F.col("last"))
    ranks = chunks.repartition(spread(df.sparkSession), "chunk").select(
        "value", "total", F.explode(F.sequence(F.col("chunk") + 1, until + 1)).alias("position")
    )
    n, i = F.col("total").cast("double"), F.col("position").cast("double")
    ends = F.pow(F.lit(0.5), 1.0 / n)
    median_rank = F.when(i == n, ends).when(i == 1, 1 - ends).otherwise((i - 0.3175) / (n + 0.365))
    return ranks.select("position", normal_quantile(median_rank).alias("theoretical"), "value")


def normal_fit(points: DataFrame) -> DataFrame:
    """Least-squares line through the points of :func:`normal_plot`, and their correlation."""
    return points.agg(
        F.regr_slope("value", "theoretical").alias("slope"),
        F.regr_intercept("value", "theoretical").alias("intercept"),
        F.corr("value", "theoretical").alias("r"),
    )


def describe_of_describe(stats: DataFrame, by: str = "neighborhood_type") -> DataFrame:
    """Second-level summary of hourly statistics per neighbourhood."""
    levels = (("min", F.min), ("mean", F.avg), ("max", F.max))
    measures = [f(c).alias(f"{c}_{name}") for c in ("mean", "median") for name, f in levels]
    return stats.groupBy(by).agg(*measures, F.max("max").alias("max_max"))
