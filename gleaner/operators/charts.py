"""Data sets behind the charts: histograms, shares, box statistics, line fits, point samples."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.columns import all_named, literal_rows, named, number
from gleaner.functions.labels import humanize_label
from gleaner.operators.profile import value_counts
from gleaner.operators.quantiles import exact_quantiles
from gleaner.operators.schema import Roles

# Points of a scatter chart, terms of a keyword cloud, charts of a group, links beside a cloud.
SCATTER_POINTS = 2_000
CLOUD_TERMS = 12
CHARTS_PER_GROUP = 4
MATCH_LINKS = 12


def histogram_bins(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum; empty bins are kept, the maximum is in the last."""
    value = number(column)
    edges = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if edges["low"] is None:
        return df.limit(0).select(
            F.lit(0).alias("bin"), value.alias("bin_start"), value.alias("bin_end"), F.lit(0).cast("bigint").alias("count"))
    low, width = edges["low"], (edges["high"] - edges["low"]) / bins
    place = F.lit(0) if width == 0 else F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    # Both sides have at most one row per bin.
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(counted), "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"), (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"))


def category_share(df: DataFrame, columns: list[str], top: int = 6) -> DataFrame:
    """Top categories of each column and their share among those shown."""
    ranking = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    shown = value_counts(df, columns).withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= top)
    return shown.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("column"))).drop("ordinal")


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whisker ends within 1.5 interquartile ranges, and the number of points beyond."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    parts = []
    for i, c in enumerate(columns):
        value, (q1, _, q3) = number(c), quartiles[c]
        reach = 1.5 * ((q3 or 0.0) - (q1 or 0.0))
        inside = value.between((q1 or 0.0) - reach, (q3 or 0.0) + reach)
        parts += [
            F.min(F.when(inside, value)).alias(f"low{i}"), F.max(F.when(inside, value)).alias(f"high{i}"),
            F.count_if(~inside).alias(f"out{i}")]
    found = df.agg(*parts).first()
    return literal_rows(df.sparkSession, [
        {"column": c, **dict(zip(("q1", "median", "q3"), quartiles[c])), "whisker_low": found[f"low{i}"], "whisker_high": found[f"high{i}"], "outliers": found[f"out{i}"]}
        for i, c in enumerate(columns)
    ], {"column": "string", **{n: "double" for n in ("q1", "median", "q3", "whisker_low", "whisker_high")}, "outliers": "bigint"})


def outlier_points(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The rows drawn as single points in a box plot: beyond 1.5 interquartile ranges."""
    q1, _, q3 = exact_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    if q1 is None:
        return df.limit(0).select(*all_named(keys), number(column).alias("value"))
    value = number(column)
    reach = 1.5 * (q3 - q1)
    return df.where((value < q1 - reach) | (value > q3 + reach)).select(*all_named(keys), value.alias("value"))


def ols_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line over all complete rows."""
    a, b = number(x), number(y)
    return df.agg(
        F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"))


def scatter_points(df: DataFrame, order_by: list[str], x: str, y: str, points: int = SCATTER_POINTS) -> DataFrame:
    """The first complete rows in order, as many as a scatter chart draws."""
    return df.where(number(x).isNotNull() & number(y).isNotNull()).orderBy(*all_named(order_by)).limit(points).select(*all_named([*order_by, x, y]))


def line_points(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Raw date and metric of every complete row, in date order."""
    return df.where(named(date).isNotNull() & number(metric).isNotNull()).select(named(date), named(metric)).orderBy(named(date), named(metric))


def heatmap_cells(matrix: DataFrame) -> DataFrame:
    """Correlation cells as shown in a heat map, 2 decimals."""
    return matrix.withColumn("r", F.round("r", 2))


def anomaly_points(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The reported outlier rows as points, sized by the distance of their score from the cut-off."""
    return rows.select(
        *all_named(keys), named(x).alias("x"), named(y).alias("y"), F.col("_isolation_anomaly").alias("flagged"),
        F.abs("_anomaly_score").alias("size"))


def keyword_cloud(keywords: DataFrame, keys: list[str], top: int = CLOUD_TERMS) -> DataFrame:
    """The first keywords with a display weight between one half and one."""
    return keywords.where(F.col("rank") <= top).select(*keys, "rank", "term", (0.5 + 0.5 * F.col("importance")).alias("weight"))


def match_links(matches: DataFrame, keys: list[str], top: int = MATCH_LINKS) -> DataFrame:
    """The first listed matches of terms and columns, as shown beside a keyword cloud: column label and whole percent."""
    return matches.where(F.col("rank") <= top).select(
        *all_named(keys), "rank", "term", humanize_label(F.col("column")).alias("label"), F.floor(F.col("score") * 100).cast("int").alias("percent"), "match_method")


def chart_list(roles: Roles, trend_metrics: list[str], correlated: bool, outliers: bool) -> list[tuple[str, str, str]]:
    """(group, kind, column) of the charts a table gets: at most four per group, from its first columns."""
    nums, cats = roles.numerical, roles.categorical
    primary = [("line", m) for m in trend_metrics[:2]] + [("histogram", c) for c in nums[:2]]
    category = [(kind, c) for c in cats[:2] for kind in ("share", "bar")]
    advanced = [("box", c) for c in nums[:2]]
    advanced += [("heatmap", "")] * correlated
    if len(nums) >= 2:
        advanced += [("outliers", f"{nums[0]} {nums[1]}")] * outliers + [("scatter", f"{nums[0]} {nums[1]}")]
    groups = (("primary", primary), ("category", category), ("advanced", advanced))
    return [(group, kind, column) for group, charts in groups for kind, column in charts[:CHARTS_PER_GROUP]]
