"""Table operators on small frames with values worked out by hand or by pandas and numpy."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise
from gleaner.operators import anomalies, charts, correlation, groups, isolation, profile, quantiles, schema, trends
from gleaner.plans.tables import analyse_table
from gleaner.sources import files, prepare


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.mark.parametrize("values", [
    [float(i) for i in range(1000)],
    [random.Random(1).gauss(0, 1) for _ in range(999)],
    [1.0] * 400 + [2.0] * 400 + [float(i) for i in range(100)],
    [5.0],
    [0.0, 1.0] * 300,
])
@pytest.mark.parametrize("exact_rows", [10, 1_000_000])
def test_quantiles_equal_numpy(spark, values, exact_rows):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(4)
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = quantiles.exact_quantiles(df, ["v"], probabilities, exact_rows)["v"]
    assert found == pytest.approx(list(np.percentile(values, [100 * p for p in probabilities])), abs=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}


def test_large_tables_take_the_narrowing_path(spark, monkeypatch):
    df = spark.createDataFrame([(float(i * i % 101),) for i in range(500)], "v double")
    small = rows(profile.numeric_stats(df, ["v"]), "median")
    monkeypatch.setattr(quantiles, "EXACT_ROWS", 50)
    assert rows(profile.numeric_stats(df, ["v"]), "median") == small


def test_numeric_stats_edges(spark):
    df = spark.createDataFrame([(1.0, 7.0, None, 3), (2.0, 7.0, None, None), (9.0, 7.0, None, None)],
                               "a double, constant double, empty double, single int")
    found = {r["column"]: r for r in profile.numeric_stats(df, df.columns).collect()}
    assert set(found) == {"a", "constant", "single"}
    assert found["a"]["skew"] == pytest.approx(pd.Series([1, 2, 9]).skew())
    assert found["a"]["std"] == pytest.approx(np.std([1, 2, 9]))
    assert (found["constant"]["std"], found["constant"]["skew"]) == (0.0, 0.0)
    assert (found["single"]["std"], found["single"]["skew"]) == (0.0, 0.0)
    assert found["single"]["missing_pct"] == pytest.approx(200 / 3)


def test_correlation_is_pairwise_complete(spark, monkeypatch):
    frame = pd.DataFrame({"a": [1.0, 2, 3, 4, None], "b": [2.0, None, 1, 9, 4], "c": [5.0] * 5})
    df = spark.createDataFrame([tuple(None if math.isnan(v) else v for v in r) for r in frame.itertuples(index=False)],
                               "a double, b double, c double")
    found = {(r["i"], r["j"]): r["r"] for r in correlation.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert found[(0, 1)] == pytest.approx(frame.corr().loc["a", "b"], abs=1e-3)
    assert found[(0, 2)] is None and found[(1, 2)] is None
    monkeypatch.setattr(correlation, "BLOCK", 2)
    assert {(r["i"], r["j"]): r["r"] for r in correlation.correlation_pairs(df, ["a", "b", "c"]).collect()} == found


def test_group_tables_nulls_and_ties(spark):
    df = spark.createDataFrame([("x", None, True), ("y", 5.0, False), (None, 5.0, True), ("x", None, True)],
                               "g string, v double, flag boolean")
    found = groups.groupby_tables(df, ["g", "flag"], ["v"])
    assert rows(found.where("category = 'g'").orderBy("rank"), "group", "sum", "count") == [
        ("Missing", 5.0, 1), ("y", 5.0, 1), ("x", 0.0, 0)]
    assert {r["group"] for r in found.where("category = 'flag'").collect()} == {"True", "False"}


def test_wide_categories_are_not_grouped(spark):
    df = spark.range(200).select(F.concat(F.lit("k"), (F.col("id") % 41).cast("string")).alias("wide"),
                                 F.concat(F.lit("k"), (F.col("id") % 40).cast("string")).alias("narrow"))
    assert profile.narrow_columns(df, ["wide", "narrow"], 40) == ["narrow"]
    assert profile.fewest_distinct(df, ["wide", "narrow"], 1) == ["narrow"]


def test_a_hot_value_is_counted_whole(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    top = profile.category_profile(df, ["c"]).where("rank = 1").first()
    assert (top["value"], top["count"]) == ("hot", 10_000)


def test_roles_and_thresholds(spark):
    dates = [f"2024-01-{i:02d}" for i in range(1, 11)]
    data = [(dates[i] if i < 7 else "no", dates[i] if i < 7 and i else "no", str(i) if i < 5 else "x", str(i) if i < 4 else "x",
             True, 1.5, dt.date(2024, 1, 1)) for i in range(10)]
    df = spark.createDataFrame(data, "d70 string, d60 string, n50 string, n40 string, flag boolean, x double, day date")
    _, roles = schema.detect_roles(df)
    assert roles.datetime == ["d70", "day"] and roles.numerical == ["x"]
    assert roles.categorical == ["d60", "n50", "n40", "flag"]
    loose = dict(schema.loose_coerce(df.select("d70", "d60", "n50", "n40")).dtypes)
    assert loose == {"d70": "timestamp_ntz", "d60": "timestamp_ntz", "n50": "double", "n40": "string"}


def test_number_and_timestamp_texts(spark):
    df = spark.createDataFrame([("5d",), (" 12 ",), ("1e3",), ("inf",), (".5",), ("2024",), ("T1",)], "t string")
    assert [r[0] for r in df.select(schema.parse_number(F.col("t"))).collect()] == [None, 12.0, 1000.0, None, 0.5, 2024.0, None]
    stamps = spark.createDataFrame([("2024",), ("12:30",), ("2024-02-30",), ("2024-02-03 04:05:06.789",), ("3 Feb 2024",), ("2/3/2024",)], "t string")
    found = [r[0] for r in stamps.select(schema.parse_timestamp(F.col("t"))).collect()]
    assert found == [None, None, None, dt.datetime(2024, 2, 3, 4, 5, 6, 789000), dt.datetime(2024, 2, 3), dt.datetime(2024, 2, 3)]


def pandas_frequency(stamps):
    ordered = pd.Series(sorted(set(stamps)))
    if len(ordered) < 2:
        return "day"
    days = ordered.diff().dropna().dt.total_seconds().median() / 86_400
    return "day" if days <= 2 else "week" if days <= 14 else "month" if days <= 45 else "quarter"


@pytest.mark.parametrize("seed", range(6))
def test_frequency_equals_sorting_everything(spark, seed):
    rng = random.Random(seed)
    start, stamps = dt.datetime(2020, 1, 1), []
    for _ in range(rng.choice([1, 2, 3, 40])):
        start += dt.timedelta(days=rng.choice([0, 0, 1, 3, 10, 20, 60]), seconds=rng.randrange(90_000), microseconds=rng.randrange(1_000_000))
        stamps += [start] * rng.choice([1, 3])
    df = spark.createDataFrame([(s,) for s in stamps], "t timestamp_ntz")
    assert trends.infer_frequency(df, "t").first()["frequency"] == pandas_frequency(stamps)


@pytest.mark.parametrize("gaps,expected", [([2, 2], "day"), ([1, 3], "day"), ([1, 4], "week"), ([14], "week"), ([15], "month"),
                                           ([45], "month"), ([46], "quarter"), ([0.5, 0.7, 3.0, 3.4], "day"), ([], "day")])
def test_frequency_limits(spark, gaps, expected):
    stamps = [dt.datetime(2024, 1, 1)]
    for g in gaps:
        stamps.append(stamps[-1] + dt.timedelta(days=g))
    df = spark.createDataFrame([(s,) for s in stamps], "t timestamp_ntz")
    assert trends.infer_frequency(df, "t").first()["frequency"] == expected == pandas_frequency(stamps)


@pytest.mark.parametrize("partitions", [1, 7])
def test_index_trend_equals_polyfit(spark, partitions):
    rng = np.random.default_rng(3)
    y = rng.normal(size=200).cumsum() + 5
    z = [None if i % 4 == 0 else float(v) for i, v in enumerate(y)]
    df = spark.createDataFrame([(i, float(y[i]), z[i]) for i in range(200)], "id int, y double, z double").repartition(partitions, "y")
    found = {r["metric"]: r for r in trends.index_trend(df, ["id"], ["y", "z"]).collect()}
    kept = [v for v in z if v is not None]
    for name, values in (("y", list(y)), ("z", kept)):
        assert found[name]["rows"] == len(values)
        assert found[name]["slope"] == pytest.approx(np.polyfit(range(len(values)), values, 1)[0])
        assert found[name]["pct_change"] == pytest.approx(100 * (values[-1] - values[0]) / abs(values[0]))


def test_trends_need_enough_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "id int, v double")
    assert trends.index_trend(df, ["id"], ["v"]).count() == 0
    same = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)] * 5, "d date, v double")
    assert trends.datetime_trend(same, ["d"], ["v"]).count() == 0


def test_trend_from_zero_uses_the_slope(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, i + 1), float(i)) for i in range(5)], "d date, v double")
    found = trends.datetime_trend(df, ["d"], ["v"]).first()
    assert (found["pct_change"], found["direction"], found["slope"]) == (None, "rising", pytest.approx(1.0))
    negative = spark.createDataFrame([(dt.date(2024, 1, i + 1), -10.0 + i) for i in range(5)], "d date, v double")
    assert trends.datetime_trend(negative, ["d"], ["v"]).first()["pct_change"] == pytest.approx(40.0)


def test_zscore_guards(spark):
    few = spark.createDataFrame([(1.0,), (2.0,), (None,), (None,), (900.0,)], "v double")
    assert anomalies.zscore_anomalies(few, ["v"]).count() == 0
    many = spark.createDataFrame([(0.0, 1.0)] * 99 + [(100.0, 1.0)], "v double, constant double")
    assert rows(anomalies.zscore_anomalies(many, ["v", "constant"]), "v") == [(100.0,)]
    # One of ten equal rows differs: its score is exactly 3, which is not more than 3.
    edge = spark.createDataFrame([(0.0,)] * 9 + [(10.0,)], "v double")
    assert anomalies.zscore_anomalies(edge, ["v"]).count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    values = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    return spark.createDataFrame(values + [(600, 40.0, -40.0), (601, None, 0.0), (602, None, None)], "id long, a double, b double")


def test_forest_flags_and_planted_row(spark, planted):
    flagged = isolation.flag_anomalies(planted, ["id"], ["a", "b"], trees=60)
    assert flagged.count() == 603
    assert 0.04 <= flagged.where("_isolation_anomaly").count() / 602 <= 0.06
    assert isolation.anomaly_rows(planted, ["id"], ["a", "b"], flagged=flagged).first()["id"] == 600
    empty = flagged.where("id = 602").first()
    assert (empty["_isolation_anomaly"], empty["_anomaly_score"]) == (False, 0.0)


def test_forest_does_not_depend_on_partitions(spark, planted):
    scores = [
        {r["id"]: r["_anomaly_score"] for r in isolation.flag_isolation(planted.repartition(n), ["id"], ["a", "b"], trees=20).collect()}
        for n in (1, 5)]
    assert scores[0] == scores[1]


def test_forest_needs_ten_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "id long, v double")
    assert isolation.flag_isolation(df, ["id"], ["v"]).where("_isolation_anomaly").count() == 0


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    found = charts.histogram_bins(df, "v", 4).orderBy("bin")
    assert rows(found, "count") == [(2,), (0,), (0,), (0,)]


def test_unique_names():
    assert prepare.unique_names(["x", "x", "x_2", " ", "x"]) == ["x", "x_3", "x_2", "column_4", "x_4"]


def test_prepare_table_drops_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("inf")), (float("nan"), None, 2.0)], "a double, nothing string, c double")
    frame, warnings = prepare.prepare_table(df)
    assert frame.columns == ["a", "c"] and warnings == ["Dropped 1 empty column(s)."]
    assert {tuple(r) for r in frame.collect()} == {(1.0, None), (None, 2.0)}
    with pytest.raises(ValueError):
        prepare.prepare_table(df.select("nothing"))


def test_table_analysis_without_dates_uses_row_order(spark):
    df = spark.createDataFrame([(i, float(i + 1), "a" if i % 2 else "b") for i in range(30)], "id int, v double, g string")
    result = analyse_table(df, ["id"], forest=False)
    assert rows(result.trends, "frequency", "direction") == [("row order", "rising")]
    assert result.roles.numerical == ["v"] and result.kpis.first()["columns"] == 2
    titles = [r["title"] for r in result.ranked.orderBy("rank").collect()]
    assert titles[0] == "V Trend" and "G Leader: a" in titles


def test_table_without_numbers_has_no_findings(spark):
    df = spark.createDataFrame([(i, "a") for i in range(9)], "id int, g string")
    result = analyse_table(df, ["id"], columns=["g"])
    assert result.ranked.count() == 0 and result.stats is None and result.trends is None
    assert result.categories.first()["count"] == 9


def test_chart_list():
    roles = schema.Roles(["a", "b", "c"], ["g"], ["d"])
    found = charts.chart_list(roles, ["c", "a", "b"], True, True)
    assert found == [
        ("primary", "line", "c"), ("primary", "line", "a"), ("primary", "histogram", "a"), ("primary", "histogram", "b"),
        ("category", "share", "g"), ("category", "bar", "g"),
        ("advanced", "box", "a"), ("advanced", "box", "b"), ("advanced", "heatmap", ""), ("advanced", "outliers", "a b")]
    assert charts.chart_list(schema.Roles(["a"], [], []), [], False, False) == [("primary", "histogram", "a"), ("advanced", "box", "a")]


def test_nan_and_infinity_count_as_missing(spark):
    rows = [(i, float(i % 7)) for i in range(200)] + [(200, float("nan")), (201, float("inf"))]
    df = spark.createDataFrame(rows, "id long, x double")
    clean = spark.createDataFrame(rows[:200], "id long, x double")
    assert anomalies.zscore_anomalies(df, ["x"]).count() == 0
    dirty, plain = (analyse_table(d, ["id"], forest=False).stats.drop("missing").first().asDict() for d in (df, clean))
    assert {k: v for k, v in dirty.items() if "miss" not in k and "null" not in k} == {k: v for k, v in plain.items() if "miss" not in k and "null" not in k}


def test_long_whole_numbers_keep_their_digits(spark):
    cells = spark.createDataFrame([("1234567890123456789", "12345678901234567890"), ("1234567890123456788", "12345678901234567891")], "a string, b string")
    typed = files.infer_types(cells)
    assert dict(typed.dtypes) == {"a": "bigint", "b": "decimal(38,0)"}
    assert {str(r["a"]) for r in typed.collect()} == {"1234567890123456789", "1234567890123456788"}
    assert {str(r["b"]) for r in typed.collect()} == {"12345678901234567890", "12345678901234567891"}


def test_files_of_any_size_are_usable_by_default(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    assert files.file_inventory(spark, str(tmp_path)).first()["error"] is None
    assert files.file_inventory(spark, str(tmp_path), max_bytes=1).first()["error"]


def test_any_column_name(spark):
    day = dt.datetime(2024, 1, 1)
    data = [(i, float(i % 11) if i % 50 else float("nan"), float(i) if i != 7 else float("inf"), "ab"[i % 2], day + dt.timedelta(days=i), f"2024-01-{i % 28 + 1:02d}")
            for i in range(300)]
    names = ["Row. id", "Amt. USD", "No.", "Kind `x`", "When. at", "Day. text"]
    plain_names = ["id", "a", "b", "c", "d", "e"]
    odd, plain = (analyse_table(spark.createDataFrame(data, n), [n[0]]) for n in (names, plain_names))
    assert odd.roles == schema.Roles(names[1:3], names[3:4], names[4:])
    for result in ("kpis", "schema", "missing", "stats", "categories", "groups", "trends", "correlation", "top_correlation",
                   "anomaly_summary", "anomaly_rows", "insights", "ranked"):
        assert getattr(odd, result).count() == getattr(plain, result).count(), result
    table, (key, a, b, kind, when, _) = odd.table, names
    for df in (profile.describe_all(table, odd.roles), profile.column_summary(table, [key]), schema.schema_profile(table),
               schema.loose_coerce(table), trends.datetime_trend(table, [when], [a, b]), trends.index_trend(table, [key], [a, b]),
               charts.histogram_bins(table, a), charts.box_stats(table, [a, b]), charts.outlier_points(table, [key], a),
               charts.ols_fit(table, a, b), charts.scatter_points(table, [key], a, b), charts.line_points(table, when, a),
               charts.category_share(table, [kind]), charts.anomaly_points(odd.anomaly_rows, [key], a, b), anomalies.zscore_matrix(table, [key], [a, b])):
        assert df.count() > 0 or df.columns == [key, "value"]
    assert quantiles.exact_quantiles(table, [a], [0.5], 10)[a][0] == pytest.approx(np.median([r[1] for r in data if r[1] == r[1]]))


def test_times_with_offsets_and_other_shapes(spark):
    texts = ["2024-03-01T00:30:00+02:00", "2024-03-01 00:30:00.5Z", "2024-03-01T00:30:00-0530", "20240301", "2024-03", "20241301", "12345678", "2024-01-05", "10:30:00Z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r["v"] for r in df.select("i", schema.parse_timestamp(F.col("t")).alias("v")).orderBy("i").collect()]
    assert found == [dt.datetime(2024, 2, 29, 22, 30), dt.datetime(2024, 3, 1, 0, 30, 0, 500000), dt.datetime(2024, 3, 1, 6, 0), dt.datetime(2024, 3, 1),
                     dt.datetime(2024, 3, 1), None, None, dt.datetime(2024, 1, 5), None]


def test_outlier_guards(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "id int, v double")
    assert anomalies.guard_warning(df, ["v"]) is None
    assert "numeric rows" in anomalies.guard_warning(df.limit(4), ["v"])
    assert "numeric columns" in analyse_table(df.select("id", F.lit("a").alias("g")), ["id"], columns=["g"]).anomaly_warning


WIDE = 300


def counted_source(spark, seen, n=2000):
    """A table of 300 columns whose every scan adds its rows to ``seen``: numbers, some missing, some with a great offset, one constant."""

    def rows(frames):
        for frame in frames:
            seen.add(len(frame))
            base = frame["id"].to_numpy()
            out = {}
            for c in range(WIDE):
                v = np.sin(base * (c % 7 + 1) + c) * (c + 1) + (1e9 if c % 50 == 3 else 0) + base * (c % 3)
                v[(base + c) % 11 == 0] = np.nan
                out[f"c{c}"] = np.full(len(base), 0.1) if c == 9 else v
            yield pd.DataFrame(out)

    return spark.range(0, n, 1, 4).mapInPandas(rows, ", ".join(f"c{c} double" for c in range(WIDE)))


def wide_frame(n=2000):
    base = np.arange(n)
    out = {}
    for c in range(WIDE):
        v = np.sin(base * (c % 7 + 1) + c) * (c + 1) + (1e9 if c % 50 == 3 else 0) + base * (c % 3)
        v[(base + c) % 11 == 0] = np.nan
        out[f"c{c}"] = np.full(n, 0.1) if c == 9 else v
    return pd.DataFrame(out)


def test_wide_statistics_take_two_scans(spark):
    """Moments, medians and quartiles of 300 columns: one pass for counts and sketches, one that settles the ranks."""
    seen, n = spark.sparkContext.accumulator(0), 2000
    df, frame = counted_source(spark, seen), wide_frame()
    found = {r["column"]: r for r in profile.numeric_stats(df, df.columns).collect()}
    assert seen.value == 2 * n
    for c in frame:
        assert found[c]["median"] == pytest.approx(frame[c].median(), rel=1e-12, abs=1e-9) and found[c]["mean"] == pytest.approx(frame[c].mean(), rel=1e-9, abs=1e-9)
    quartiles = quantiles.exact_quantiles(df, df.columns, [0.25, 0.5, 0.75])
    assert seen.value == 4 * n
    for c in frame:
        assert quartiles[c] == pytest.approx(list(frame[c].quantile([0.25, 0.5, 0.75])), rel=1e-12, abs=1e-9)


def test_wide_correlations_take_one_scan(spark):
    """Beside a look at the first rows; the matrix and the strongest pair read the same sums."""
    seen, n = spark.sparkContext.accumulator(0), 2000
    df, frame = counted_source(spark, seen), wide_frame()
    sums = materialise(correlation.correlations(df, df.columns), "correlations")
    assert n <= seen.value <= n + 1000
    found = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.correlation_matrix(df, df.columns, sums).collect()}
    top = correlation.top_correlation(df, df.columns, sums).first()
    assert seen.value <= n + 1000 and len(found) == WIDE * WIDE
    wanted = frame.corr()
    for a in list(frame)[::13]:
        for b in frame:
            assert found[a, b] is None if "c9" in (a, b) else found[a, b] == pytest.approx(wanted.loc[a, b], abs=5.1e-4)
    size = max(abs(v) for (a, b), v in found.items() if a != b and v is not None)
    assert abs(top["r"]) == size


def test_great_offsets_cost_no_digits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=3000)
    data = np.stack([x + 1e12, x * 0.5 + rng.normal(size=3000) * 0.5 - 3e11, np.full(3000, 7e15), np.where(np.arange(3000) % 2, 0.1, np.nan)], axis=1)
    df = spark.createDataFrame(pd.DataFrame(data, columns=list("abcd"))).repartition(5)
    found = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.correlation_pairs(df, list("abcd")).collect()}
    assert found["a", "b"] == pytest.approx(np.corrcoef(data[:, 0] - 1e12, data[:, 1] + 3e11)[0, 1], abs=1e-3)
    assert [found[k] for k in (("a", "c"), ("b", "c"), ("a", "d"), ("c", "d"))] == [None] * 4


def test_wide_distincts_copy_no_rows(spark):
    """Distinct counts of 300 columns of all kinds without an Expand, and the first samples of each in row order."""
    n = 400
    data = pd.DataFrame({"k": np.arange(n)} | {f"c{c}": [None if (i + c) % 17 == 0 else f"v{(i * 7 + c) % (c + 1)}" for i in range(n)] for c in range(298)})
    df = spark.createDataFrame(data).withColumn("zero", F.when(F.col("k") % 2 == 0, 0.0).otherwise(-0.0)).repartition(4)
    profiled = schema.schema_profile(df)
    assert "Expand" not in profiled._jdf.queryExecution().toString()
    found = {r["column"]: r for r in profiled.collect()}
    for c in data:
        assert (found[c]["unique"], found[c]["non_null"], found[c]["missing"]) == (data[c].nunique(), data[c].count(), data[c].isna().sum())
    assert found["zero"]["unique"] == 1 and len(found) == 300
    summary = profile.column_summary(df, ["k"])
    assert "Expand" not in summary._jdf.queryExecution().toString()
    shown = {r["column"]: r for r in summary.collect()}
    for c in list(data)[1:]:
        assert shown[c]["samples"] == ", ".join(data[c].dropna()[:3]) and shown[c]["unique"] == data[c].nunique()
    empty = schema.schema_profile(df.limit(0)).collect()
    assert len(empty) == 300 and all(r["unique"] == r["non_null"] == r["missing"] == 0 for r in empty)


def test_samples_with_ties_and_nulls_in_the_order(spark):
    rows_ = [(None, "z"), (1, None), (1, "d"), (1, "c"), (1, "b"), (1, "a"), (0, "y"), (2, "x")] * 3
    df = spark.createDataFrame(rows_, "o int, v string").repartition(3)
    assert profile.first_samples(df, ["v"], ["o"], 7).first()["samples"] == "z, z, z, y, y, y, a"
    assert profile.first_samples(df, ["v"], [], 4).first()["samples"] == "a, a, a, b"


@pytest.mark.parametrize("error", [1e-6, 0.4])
def test_ranks_outside_their_brackets_are_found(spark, monkeypatch, error):
    """Brackets that are too narrow miss their ranks, and wide ones are sketched again."""
    monkeypatch.setattr(quantiles, "rank_error", lambda k: error)
    monkeypatch.setattr(quantiles, "SIZES", (8, 8))
    values = [random.Random(i).gauss(0, 1) for i in range(3000)] + [0.5] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for exact_rows in (1, 10_000):
        found = quantiles.exact_quantiles(df, ["v"], [0.0, 0.1, 0.5, 0.77, 1.0], exact_rows)["v"]
        assert found == pytest.approx(list(np.percentile(values, [0, 10, 50, 77, 100])), abs=1e-12)


def test_order_of_day_and_month_is_decided_by_the_column(spark):
    rows_ = [("31/12/2024", "12/31/2024", "1/2/2024", "31.12.2024 7:05", "13-1-2024"), ("15/01/2025", "01/15/2025", "3/4/2025", "1.2.2025 23:59:58", "1-13-2024"),
             ("02/03/2025", "02/03/2025", "5/6/2025", "02.03.2025", "14-2-2024"), (None, None, None, None, "15-3-2024")]
    df = spark.createDataFrame(rows_, "european string, american string, open string, dotted string, both string")
    table, roles = schema.detect_roles(df)
    assert roles.datetime == df.columns
    found = [[r[c] for r in table.collect()] for c in df.columns]
    day = lambda *a: dt.datetime(*a)
    assert found[0] == [day(2024, 12, 31), day(2025, 1, 15), day(2025, 3, 2), None] and found[1] == [day(2024, 12, 31), day(2025, 1, 15), day(2025, 2, 3), None]
    assert found[2] == [day(2024, 1, 2), day(2025, 3, 4), day(2025, 5, 6), None] and found[3][:3] == [day(2024, 12, 31, 7, 5), day(2025, 2, 1, 23, 59, 58), day(2025, 3, 2)]
    assert found[4] == [day(2024, 1, 13), None, day(2024, 2, 14), day(2024, 3, 15)]


def test_a_cell_is_trimmed_once_for_all_timestamp_shapes(spark):
    plan = spark.createDataFrame([("2024-05-01T10:00:00Z",)], "t string").select(schema.parse_timestamp(F.col("t")).alias("t"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 25
    assert str(plan.first()["t"]) == "2024-05-01 10:00:00"
