"""Queries for table profiling, trends, outliers and chart data."""

from pyspark.sql import functions as F

from gleaner.catalog import query, table
from gleaner.functions.columns import finite, named
from gleaner.operators import anomalies, charts, correlation, groups, isolation, profile, schema, trends

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# The tables hold no nulls, so a zero discount and the smallest tax count as missing here.
LINEITEM_SQL = """
lines as (select * replace (nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax,
                            nullif(l_returnflag, 'R') as l_returnflag) from lineitem)
"""


def lineitem(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.withColumns({
        "l_discount": F.nullif("l_discount", F.lit(0.0)), "l_tax": F.nullif("l_tax", F.lit(0.0)),
        "l_returnflag": F.nullif("l_returnflag", F.lit("R"))})


def rounded(df, digits=4):
    """Doubles rounded, so that the order of additions cannot show."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def per_column(columns, template, source="lines"):
    """One SELECT per column, joined by UNION ALL; {c} is the column and {i} its position."""
    return " union all ".join(template.format(c=c, i=i, source=source) for i, c in enumerate(columns))


@query("numeric_stats", f"with {LINEITEM_SQL} " + per_column(MEASURES, """
select {i} as ordinal, '{c}' as "column", round(avg({c}), 4) as mean, round(median({c}), 4) as median,
 round(stddev_pop({c}), 4) as std, round(coalesce(skewness({c}), 0), 4) as skew, round(min({c}), 4) as min,
 round(max({c}), 4) as max, round(100.0 * (count(*) - count({c})) / count(*), 4) as missing_pct from {source}"""))
def numeric_stats(spark, folder):
    return rounded(profile.numeric_stats(lineitem(spark, folder), MEASURES))


DIRTY = ["Amt. USD", "No.", "Share `%`"]
DIRTY_SQL = """lines as (select event_id as id, case when event_type not in ('error', 'click', 'view') then value end as "Amt. USD",
 user_id::double as "No.", case when user_id % 7 > 0 then user_id % 7 end::double as "Share `%`" from events)"""


def dirty_events(spark, folder):
    """Events with infinities and NaN for some values, and column names of dots and backticks."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.when(kind == "error", float("inf")).when(kind == "click", float("nan")).when(kind == "view", float("-inf")).otherwise(F.col("value"))
        .alias("Amt. USD"), F.col("user_id").cast("double").alias("No."),
        F.when(F.col("user_id") % 7 > 0, (F.col("user_id") % 7).cast("double")).otherwise(float("nan")).alias("Share `%`"))


@query("dirty_table_stats", f"with {DIRTY_SQL} " + " union all ".join(f"""
select {i} as ordinal, '{c}' as "column", round(avg("{c}"), 4) as mean, round(median("{c}"), 4) as median,
 round(stddev_pop("{c}"), 4) as std, round(coalesce(skewness("{c}"), 0), 4) as skew, round(min("{c}"), 4) as min,
 round(max("{c}"), 4) as max, round(100.0 * (count(*) - count("{c}")) / count(*), 4) as missing_pct from lines"""
    for i, c in enumerate(DIRTY)))
def dirty_table_stats(spark, folder):
    return rounded(profile.numeric_stats(dirty_events(spark, folder), DIRTY))


@query("dirty_table_anomalies", f"with {DIRTY_SQL}, stats as (select " + ", ".join(
    f"""avg("{c}") as m{i}, stddev_pop("{c}") as s{i}""" for i, c in enumerate(DIRTY)) + """ from lines)
select id, """ + ", ".join(f'round("{c}", 4) as "{c}"' for c in DIRTY) + " from lines, stats where " + " or ".join(
    f"""coalesce(abs("{c}" - m{i}) / s{i} > 3, false)""" for i, c in enumerate(DIRTY)))
def dirty_table_anomalies(spark, folder):
    found = finite(anomalies.zscore_anomalies(dirty_events(spark, folder), DIRTY))
    return found.select("id", *[F.round(named(c), 4).alias(c) for c in DIRTY])


LINEITEM_TYPES = {
    "l_orderkey": ("bigint", "numerical"), "l_partkey": ("bigint", "numerical"), "l_suppkey": ("bigint", "numerical"),
    "l_linenumber": ("int", "numerical"), "l_quantity": ("double", "numerical"), "l_extendedprice": ("double", "numerical"),
    "l_discount": ("double", "numerical"), "l_tax": ("double", "numerical"), "l_returnflag": ("string", "categorical"),
    "l_linestatus": ("string", "categorical"), "l_shipdate": ("timestamp_ntz", "datetime")}


@query("schema_profile", f"with {LINEITEM_SQL} " + " union all ".join(
    f"""select {i} as ordinal, '{c}' as "column", '{t}' as dtype, '{r}' as role, count({c}) as non_null,
    count(*) - count({c}) as missing, count(distinct {c}) as "unique" from lines"""
    for i, (c, (t, r)) in enumerate(LINEITEM_TYPES.items())))
def schema_profile(spark, folder):
    return schema.schema_profile(lineitem(spark, folder))


@query("missing_values", f"with {LINEITEM_SQL} " + per_column(LINEITEM_TYPES, """
select {i} as ordinal, '{c}' as "column", count(*) - count({c}) as missing_count,
 round(100.0 * (count(*) - count({c})) / count(*), 4) as missing_pct from {source}"""))
def missing_values(spark, folder):
    return rounded(profile.missing_values(lineitem(spark, folder)))


@query("kpis", """select count(*) as rows, 11::bigint as columns, 8::bigint as numerical_columns,
 2::bigint as categorical_columns, 1::bigint as datetime_columns from lineitem""")
def kpis(spark, folder):
    return profile.kpis(lineitem(spark, folder))


ORDER_CATEGORIES = ["o_orderstatus", "o_orderpriority", "o_clerkband", "o_month"]
ORDERS_SQL = """
marked as (select o_orderkey, o_custkey, o_totalprice, o_orderdate,
  o_orderstatus, nullif(o_orderpriority, '5-LOW') as o_orderpriority,
  'band ' || (o_custkey // 100)::varchar as o_clerkband, strftime(o_orderdate, '%Y-%m') as o_month from orders)
"""


def orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.concat(F.lit("band "), F.floor(F.col("o_custkey") / 100).cast("string")).alias("o_clerkband"),
        F.date_format("o_orderdate", "yyyy-MM").alias("o_month"))


@query("category_profile", f"with {ORDERS_SQL}, counted as (" + " union all ".join(
    f"""select '{c}' as "column", {i} as source_ordinal, coalesce({c}, 'Missing') as value, count(*) as count,
    (select count(distinct {c}) from marked) as n from marked group by all""" for i, c in enumerate(ORDER_CATEGORIES)) + """
), ranked as (select *, dense_rank() over (order by n, source_ordinal) as ordinal,
  row_number() over (partition by "column" order by count desc, value) as rank from counted)
select (ordinal - 1)::int as ordinal, "column", value, count, rank::int as rank from ranked where ordinal <= 3 and rank <= 10""")
def category_profile(spark, folder):
    return profile.category_profile(orders(spark, folder), ORDER_CATEGORIES)


GROUP_CATEGORIES = ["l_returnflag", "l_linestatus", "l_year", "l_shipdate"]
GROUP_METRICS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("groupby_tables", f"with {LINEITEM_SQL}, yearly as (select *, year(l_shipdate)::varchar as l_year from lines), grouped as ("
       + " union all ".join(f"""select {i} as category_ordinal, {k} as metric_ordinal, '{c}' as category,
  coalesce({c}, 'Missing') as "group", '{m}' as metric, round(avg({m}), 4) as mean, round(coalesce(sum({m}), 0), 3) as sum,
  count({m}) as count from yearly group by {c}"""
       for i, c in enumerate(GROUP_CATEGORIES[:3]) for k, m in enumerate(GROUP_METRICS)) + """
) select * from (select *, row_number() over (partition by category, metric order by sum desc, "group")::int as rank from grouped)
where rank <= 10""")
def groupby_tables(spark, folder):
    df = lineitem(spark, folder).withColumn("l_year", F.year("l_shipdate").cast("string"))
    found = groups.groupby_tables(df, ["l_returnflag", "l_linestatus", "l_year"], GROUP_METRICS + ["l_tax"])
    return found.withColumns({"mean": F.round("mean", 4), "sum": F.round("sum", 3)})


def _pairs(columns):
    return [(i, j, a, b) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]


def _corr_sql(a, b):
    return f"nullif(round(corr({a}, {b}), 3), 'nan'::double)"


PAIRS_SQL = " union all ".join(
    f"select {i} as i, {j} as j, '{a}' as col_a, '{b}' as col_b, {_corr_sql(a, b)} as r from lines"
    for i, j, a, b in _pairs(MEASURES + ["l_constant"]))
CONSTANT_SQL = LINEITEM_SQL.replace("lines as (select", "lines as (select 1.0::double as l_constant,")


def with_constant(spark, folder):
    return lineitem(spark, folder).withColumn("l_constant", F.lit(1.0))


@query("correlation_matrix", f"""with {CONSTANT_SQL}, pairs as ({PAIRS_SQL}),
both_ways as (select col_a, col_b, r from pairs union all select col_b, col_a, r from pairs)
select * from both_ways union all """ + per_column(MEASURES + ["l_constant"], """
select '{c}', '{c}', case when stddev_pop({c}) > 0 then 1.0::double end from {source}"""))
def correlation_matrix(spark, folder):
    return correlation.correlation_matrix(with_constant(spark, folder), MEASURES + ["l_constant"])


@query("heatmap_cells", f"""with {CONSTANT_SQL}, pairs as ({PAIRS_SQL}),
both_ways as (select col_a, col_b, r from pairs union all select col_b, col_a, r from pairs)
select col_a, col_b, round(r, 2) as r from both_ways union all """ + per_column(MEASURES + ["l_constant"], """
select '{c}', '{c}', case when stddev_pop({c}) > 0 then 1.0::double end from {source}"""))
def heatmap_cells(spark, folder):
    return charts.heatmap_cells(correlation.correlation_matrix(with_constant(spark, folder), MEASURES + ["l_constant"]))


@query("top_correlation", f"""with {CONSTANT_SQL}, pairs as ({PAIRS_SQL})
select col_a, col_b, r, case when r > 0 then 'positively' else 'negatively' end as direction,
 case when abs(r) > 0.7 then 'strongly' when abs(r) > 0.4 then 'moderately' else 'weakly' end as strength
from pairs where r is not null order by abs(r) desc, i, j limit 1""")
def top_correlation(spark, folder):
    return correlation.top_correlation(with_constant(spark, folder), MEASURES + ["l_constant"])


@query("describe_all", f"with {LINEITEM_SQL} " + per_column([c for c, (_, role) in LINEITEM_TYPES.items() if role == "numerical"], """
select '{c}' as "column", count({c}) as count, null::bigint as "unique", null::varchar as top, null::bigint as freq,
 round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as std, round(min({c})::double, 2) as min,
 round(quantile_cont({c}::double, 0.25), 2) as q25, round(quantile_cont({c}::double, 0.5), 2) as q50,
 round(quantile_cont({c}::double, 0.75), 2) as q75, round(max({c})::double, 2) as max from {source}""") + " union all "
       + per_column(["l_returnflag", "l_linestatus"], """
select '{c}', sum(n)::bigint, count(*), arg_min(v, (-n, v)), max(n), null, null, null, null, null, null, null
 from (select {c} as v, count(*) as n from {source} where {c} is not null group by 1)"""))
def describe_all(spark, folder):
    return profile.describe_all(lineitem(spark, folder))


@query("column_summary", f"""with marked as (select event_id, date_trunc('second', ts) as ts, event_type, nullif(props, '{{"k": 69}}') as props, value, user_id from events)
select 0 as ordinal, 'event_id' as "column", 'numerical' as role, round(avg(event_id), 4) as mean, min(event_id)::double as min,
 max(event_id)::double as max, null::bigint as "unique", count(event_id) as non_null, null::varchar as samples from marked
union all select 4, 'ts', 'datetime', null, null, null, null, count(ts),
 (select string_agg(ts::varchar, ', ' order by event_id) from (select * from marked order by event_id limit 3)) from marked
union all select 5, 'user_id', 'numerical', round(avg(user_id), 4), min(user_id)::double, max(user_id)::double, null, count(user_id), null from marked
union all select 1, 'event_type', 'categorical', null, null, null, count(distinct event_type), count(event_type),
 (select string_agg(event_type, ', ' order by event_id) from (select * from marked order by event_id limit 3)) from marked
union all select 2, 'props', 'categorical', null, null, null, count(distinct props), count(props),
 (select string_agg(props, ', ' order by event_id) from (select * from marked where props is not null order by event_id limit 3)) from marked
union all select 3, 'value', 'numerical', round(avg(value), 4), min(value), max(value), null, count(value), null from marked""")
def column_summary(spark, folder):
    df = table(spark, folder, "events").select(
        "event_id", "event_type", F.nullif("props", F.lit('{"k": 69}')).alias("props"), "value",
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "user_id")
    return rounded(profile.column_summary(df, ["event_id"]))


def _frequency_sql(name, source, column):
    return f"""select '{name}' as date_column, (count(gap) + 1)::bigint as timestamps,
 case when median(gap) <= 2 then 'D' when median(gap) <= 14 then 'W' when median(gap) <= 45 then 'M' else 'Q' end as code,
 case when median(gap) <= 2 then 'day' when median(gap) <= 14 then 'week' when median(gap) <= 45 then 'month' else 'quarter' end as frequency
 from (select epoch_us({column}) / 86400e6 - lag(epoch_us({column}) / 86400e6) over (order by {column}) as gap
       from (select distinct {column} from {source}))"""


@query("infer_frequency", _frequency_sql("ts", "events", "ts") + " union all " + _frequency_sql("l_shipdate", "lineitem", "l_shipdate")
       + " union all " + _frequency_sql("o_week", "(select date_trunc('week', o_orderdate)::timestamp as o_week from orders)", "o_week")
       + " union all " + _frequency_sql("o_month", "(select date_trunc('month', o_orderdate)::timestamp as o_month from orders)", "o_month")
       + " union all " + _frequency_sql("o_quarter", "(select date_trunc('quarter', o_orderdate)::timestamp as o_quarter from orders)", "o_quarter"))
def infer_frequency(spark, folder):
    dated = table(spark, folder, "orders").select(*[
        F.trunc(F.col("o_orderdate").cast("date"), p).cast("timestamp_ntz").alias(f"o_{p}") for p in ("week", "month", "quarter")])
    found = trends.infer_frequency(table(spark, folder, "events"), "ts")
    found = found.unionByName(trends.infer_frequency(table(spark, folder, "lineitem"), "l_shipdate"))
    for p in ("week", "month", "quarter"):
        found = found.unionByName(trends.infer_frequency(dated, f"o_{p}"))
    return found


TREND_METRICS = ["o_totalprice", "o_custkey"]
TREND_SOURCE = """
dated as (select *, date_trunc('month', o_orderdate)::timestamp as o_month from orders),
series as (""" + " union all ".join(
    f"""select {d} as date_ordinal, '{c}' as date_column, {k} as metric_ordinal, '{m}' as metric, '{f}' as frequency,
 date_trunc('{f}', {c})::timestamp as x, sum({m})::double as y, count({m}) as n from dated group by all"""
    for d, (c, f) in enumerate([("o_orderdate", "day"), ("o_month", "month")]) for k, m in enumerate(TREND_METRICS)) + ")"


def dated_orders(spark, folder):
    return table(spark, folder, "orders").withColumn(
        "o_month", F.trunc(F.col("o_orderdate").cast("date"), "month").cast("timestamp_ntz"))


def _direction_sql():
    return """case when pct_change > 3 then 'rising' when pct_change < -3 then 'falling'
 when slope > 0 then 'rising' when slope < 0 then 'falling' else 'stable' end as direction"""


@query("datetime_trend", f"""with {TREND_SOURCE},
indexed as (select *, row_number() over (partition by date_column, metric order by x) - 1 as idx from series),
fitted as (select date_ordinal, date_column, metric_ordinal, metric, frequency, count(*) as periods, regr_slope(y, idx) as slope,
  100 * (arg_max(y, x) - arg_min(y, x)) / nullif(abs(arg_min(y, x)), 0) as pct_change from indexed group by all)
select date_ordinal, date_column, metric_ordinal, metric, frequency, periods, {_direction_sql()},
 round(pct_change, 4) as pct_change, round(slope, 4) as slope from fitted""")
def datetime_trend(spark, folder):
    return rounded(trends.datetime_trend(dated_orders(spark, folder), ["o_orderdate", "o_month"], TREND_METRICS))


@query("trend_series", f"""with {TREND_SOURCE}
select date_ordinal, date_column, frequency, x, metric_ordinal, metric, round(y, 3) as y, n from series""")
def trend_series(spark, folder):
    found = trends.trend_series(dated_orders(spark, folder), ["o_orderdate", "o_month"], TREND_METRICS)
    return found.withColumn("y", F.round("y", 3))


def _index_sql(k, metric):
    return f"""select {k} as metric_ordinal, '{metric}' as metric, count(*) as rows, regr_slope(y, idx) as slope,
 100 * (arg_max(y, idx) - arg_min(y, idx)) / nullif(abs(arg_min(y, idx)), 0) as pct_change
 from (select {metric}::double as y, row_number() over (order by event_id) - 1 as idx from marked where {metric} is not null)"""


@query("index_trend", f"""with marked as (select event_id, value, case when event_type <> 'error' then value end as accepted, user_id from events),
fitted as ({" union all ".join(_index_sql(k, m) for k, m in enumerate(["value", "accepted", "user_id"]))})
select metric_ordinal, metric, 'row order' as frequency, rows, {_direction_sql()}, round(pct_change, 4) as pct_change,
 round(slope, 6) as slope from fitted""")
def index_trend(spark, folder):
    df = table(spark, folder, "events").withColumn("accepted", F.when(F.col("event_type") != "error", F.col("value")))
    found = trends.index_trend(df, ["event_id"], ["value", "accepted", "user_id"])
    return found.withColumns({"pct_change": F.round("pct_change", 4), "slope": F.round("slope", 6)})


EVENT_MEASURES = ["value", "accepted", "user_id"]
EVENTS_SQL = """marked as (select event_id, ts, event_type, value, case when event_type <> 'error' then value end as accepted, user_id from events),
stats as (select avg(value) as m0, stddev_pop(value) as s0, avg(accepted) as m1, stddev_pop(accepted) as s1,
  avg(user_id) as m2, stddev_pop(user_id) as s2 from marked),
scored as (select marked.*, abs(value - m0) / nullif(s0, 0) as z_value, abs(accepted - m1) / nullif(s1, 0) as z_accepted,
  abs(user_id - m2) / nullif(s2, 0) as z_user_id from marked, stats)"""


def events(spark, folder):
    df = table(spark, folder, "events").select("event_id", "ts", "event_type", "value", "user_id")
    return df.withColumn("accepted", F.when(F.col("event_type") != "error", F.col("value")))


@query("zscore_matrix", f"""with {EVENTS_SQL} select event_id, round(z_value, 6) as z_value, round(z_accepted, 6) as z_accepted,
 round(z_user_id, 6) as z_user_id from scored""")
def zscore_matrix(spark, folder):
    return rounded(anomalies.zscore_matrix(events(spark, folder), ["event_id"], EVENT_MEASURES), 6)


@query("zscore_anomalies", f"""with {EVENTS_SQL} select event_id, ts, event_type, value, user_id, accepted from scored
 where coalesce(z_value > 3, false) or coalesce(z_accepted > 3, false) or coalesce(z_user_id > 3, false)""")
def zscore_anomalies(spark, folder):
    return anomalies.zscore_anomalies(events(spark, folder), EVENT_MEASURES)


@query("anomaly_summary", f"""with {EVENTS_SQL}, counted as (
 select -3 as ordinal, 'total' as scope, 'zscore_count' as name, count(*) filter (z_value > 3 or z_accepted > 3 or z_user_id > 3) as count from scored
 union all select -2, 'total', 'isolation_count', 0 from stats
 union all select -1, 'total', 'combined_count', count(*) filter (z_value > 3 or z_accepted > 3 or z_user_id > 3) from scored
 union all select 0, 'column', 'value', count(*) filter (z_value > 3) from scored
 union all select 1, 'column', 'accepted', count(*) filter (z_accepted > 3) from scored
 union all select 2, 'column', 'user_id', count(*) filter (z_user_id > 3) from scored)
select * from counted where scope = 'total' or count > 0""")
def anomaly_summary(spark, folder):
    return anomalies.anomaly_summary(events(spark, folder), EVENT_MEASURES)


# Fixed values of the forest: 200 trees on 256 rows each, of depth 8; the seed is 42.
FOREST_SQL = """forest_rows as (select event_id, value::double as x0, user_id::double as x1, md5('42:' || event_id) as d, count(*) over () as n from events),
trees as (select t, ('0x' || substr(md5('42:' || t), 1, 8))::bigint % 2147483646 + 1 as a, ('0x' || substr(md5('42:' || t), 9, 8))::bigint % 2147483647 as b from range(200) r(t)),
pool as (select event_id, x0, x1, ('0x' || substr(d, 9, 8))::bigint % 2147483647 as h from forest_rows
  where ('0x' || substr(d, 1, 8))::bigint < least(4294967296, ceil(1.2::double * least(n, 51200) / n * 4294967296))),
drawn as (select t, event_id, x0, x1 from pool, trees qualify row_number() over (partition by t order by (h * a + b) % 2147483647, event_id) <= 256),
grown(t, node, depth, x0, x1) as (
 select t, 1::bigint, 0, x0, x1 from drawn
 union all select t, case when case when f = 0 then x0 else x1 end <= case when f = 0 then l0 + (h0 - l0) * u else l1 + (h1 - l1) * u end then 2 * node else 2 * node + 1 end,
  depth + 1, x0, x1 from (
   select *, case when h0 > l0 and h1 > l1 then ('0x' || substr(m, 1, 8))::bigint % 2 when h0 > l0 then 0 else 1 end as f, ('0x' || substr(m, 9, 8))::bigint / 4294967296.0::double as u
   from (select *, md5('42:' || t || ':' || node) as m, min(x0) over w as l0, max(x0) over w as h0, min(x1) over w as l1, max(x1) over w as h1
         from grown where depth < 8 window w as (partition by t, node)) where h0 > l0 or h1 > l1)),
sized as (select t, node, depth, count(*) as n, min(x0) as l0, max(x0) as h0, min(x1) as l1, max(x1) as h1, md5('42:' || t || ':' || node) as m from grown group by t, node, depth),
chosen as (select *, depth < 8 and (h0 > l0 or h1 > l1) as inner_node, case when h0 > l0 and h1 > l1 then ('0x' || substr(m, 1, 8))::bigint % 2 when h0 > l0 then 0 else 1 end as f,
  ('0x' || substr(m, 9, 8))::bigint / 4294967296.0::double as u from sized),
nodes as materialized (select t, node, inner_node, f, case when f = 0 then l0 + (h0 - l0) * u else l1 + (h1 - l1) * u end as split,
  depth * 1000000 + case when n <= 1 then 0 when n = 2 then 1000000 else round(1000000 * (2 * (ln(n - 1.0::double) + 0.5772156649015329::double) - 2 * (n - 1.0::double) / n))::bigint end as path
  from chosen),
walk(event_id, t, node, x0, x1) as (
 select event_id, t, 1::bigint, x0, x1 from forest_rows, trees
 union all select w.event_id, w.t, case when case when f = 0 then w.x0 else w.x1 end <= split then 2 * w.node else 2 * w.node + 1 end, w.x0, w.x1
  from walk w join nodes using (t, node) where inner_node),
totals as (select event_id, sum(path)::double as total from walk join nodes using (t, node) where not inner_node group by event_id),
forest_scores as (select event_id, round(-pow(2::double, -total / (200 * round(1000000 * (2 * (ln(255.0::double) + 0.5772156649015329::double) - 2 * 255.0::double / 256)))), 12) as s from totals),
cut as (select quantile_cont(s, 0.05) as c from forest_scores),
judged as (select e.event_id, ts, event_type, value, case when event_type <> 'error' then value end as accepted, user_id, s - c < 0 as _isolation_anomaly, s - c as a
  from events e join forest_scores using (event_id), cut)"""


@query("iforest_anomalies", f"with recursive {FOREST_SQL} select * exclude (a), round(a, 9) as _anomaly_score from judged")
def iforest_anomalies(spark, folder):
    return isolation.flag_isolation(events(spark, folder), ["event_id"], ["value", "user_id"]).withColumn("_anomaly_score", F.round("_anomaly_score", 9))


REPORT_SQL = f"""{EVENTS_SQL}, {FOREST_SQL},
reported as (select j.*, coalesce(z_value > 3, false) or coalesce(z_user_id > 3, false) as _zscore_anomaly from judged j join (select event_id, z_value, z_user_id from scored) using (event_id)
  where _isolation_anomaly or _zscore_anomaly order by _isolation_anomaly desc, a, event_id limit 100)"""


def reported(spark, folder):
    return isolation.anomaly_rows(events(spark, folder), ["event_id"], ["value", "user_id"])


@query("anomaly_rows", f"with recursive {REPORT_SQL} select * exclude (a), round(a, 9) as _anomaly_score from reported")
def anomaly_rows(spark, folder):
    return reported(spark, folder).withColumn("_anomaly_score", F.round("_anomaly_score", 9))


@query("anomaly_points", f"with recursive {REPORT_SQL} select event_id, value as x, user_id as y, _isolation_anomaly as flagged, round(abs(a), 9) as size from reported")
def anomaly_points(spark, folder):
    return charts.anomaly_points(reported(spark, folder), ["event_id"], "value", "user_id").withColumn("size", F.round("size", 9))


HISTOGRAM_SQL = """with edges as (select min({c}) as lo, (max({c}) - min({c})) / {n} as w from {t}),
counted as (select least(floor(({c} - lo) / w), {n} - 1)::int as bin, count(*) as count from {t}, edges where {c} is not null group by 1)
select r.range::int as bin, round(lo + r.range * w, 4) as bin_start, round(lo + (r.range + 1) * w, 4) as bin_end, coalesce(count, 0) as count
from range({n}) r cross join edges left join counted on bin = r.range"""


@query("histogram_bins", HISTOGRAM_SQL.format(c="l_extendedprice", t="lineitem", n=20))
def histogram_bins(spark, folder):
    return rounded(charts.histogram_bins(table(spark, folder, "lineitem"), "l_extendedprice", 20))


@query("histogram_bins_30", HISTOGRAM_SQL.format(c="value", t="events", n=30))
def histogram_bins_30(spark, folder):
    return rounded(charts.histogram_bins(table(spark, folder, "events"), "value", 30))


@query("category_share", f"with {ORDERS_SQL}, counted as (" + " union all ".join(
    f"""select '{c}' as "column", coalesce({c}, 'Missing') as value, count(*) as count from marked group by all"""
    for c in ORDER_CATEGORIES[:2]) + """
), shown as (select *, row_number() over (partition by "column" order by count desc, value)::int as rank from counted qualify rank <= 6)
select *, round(count / sum(count) over (partition by "column"), 4) as share from shown""")
def category_share(spark, folder):
    return rounded(charts.category_share(orders(spark, folder), ORDER_CATEGORIES[:2]))


@query("box_stats", "with " + LINEITEM_SQL + ", long as (" + " union all ".join(
    f"select '{c}' as c, {c} as v from {t}" for c, t in [(m, "lines") for m in MEASURES] ) + """
), q as (select c, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as q2, quantile_cont(v, 0.75) as q3 from long group by c)
select c as "column", round(any_value(q1), 4) as q1, round(any_value(q2), 4) as median, round(any_value(q3), 4) as q3,
 round(min(v) filter (v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) as whisker_low,
 round(max(v) filter (v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) as whisker_high,
 count(*) filter (v not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as outliers
from long join q using (c) group by c""")
def box_stats(spark, folder):
    return rounded(charts.box_stats(lineitem(spark, folder), MEASURES))


@query("outlier_points", """with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)
select event_id, value from events, q where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""")
def outlier_points(spark, folder):
    return charts.outlier_points(table(spark, folder, "events"), ["event_id"], "value")


@query("ols_fit", """select regr_count(l_extendedprice, l_quantity)::bigint as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
 round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem""")
def ols_fit(spark, folder):
    fit = charts.ols_fit(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    return fit.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 4), "r2": F.round("r2", 6)})


@query("scatter_points", """select event_id, value, user_id from events order by event_id limit 2000""")
def scatter_points(spark, folder):
    return charts.scatter_points(table(spark, folder, "events"), ["event_id"], "value", "user_id")


@query("line_points", "select o_orderdate, o_totalprice from orders where o_orderdate is not null and o_totalprice is not null")
def line_points(spark, folder):
    return charts.line_points(table(spark, folder, "orders"), "o_orderdate", "o_totalprice")


@query("loose_coerce", """select event_id, case when event_type <> 'error' then value end as mostly_number,
 case when event_type in ('error', 'click', 'view') then ts::date::timestamp end as mostly_date, event_type as words from events""")
def loose_coerce(spark, folder):
    kind = F.col("event_type")
    raw = table(spark, folder, "events").select(
        "event_id",
        F.when(kind != "error", F.col("value").cast("string")).otherwise("5d").alias("mostly_number"),
        F.when(kind.isin("error", "click", "view"), F.date_format("ts", "yyyy/MM/dd")).otherwise("unknown").alias("mostly_date"),
        kind.alias("words"))
    return schema.loose_coerce(raw)


@query("describe_datetimes", " union all ".join(f"""select '{c}' as "column", count({c}) as count,
 date_trunc('second', make_timestamp(avg(epoch_us({c}::timestamp))::bigint)) as mean, {", ".join(
    f"date_trunc('second', quantile_cont({c}::timestamp, {p})) as {n}" for n, p in (("min", 0.0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("max", 1.0)))}
 from {t}""" for c, t in (("o_orderdate", "orders"), ("ts", "events"))))
def describe_datetimes(spark, folder):
    found = [profile.describe_datetimes(table(spark, folder, t), [c]) for c, t in (("o_orderdate", "orders"), ("ts", "events"))]
    times = [F.date_trunc("second", c).cast("timestamp_ntz").alias(c) for c in ("mean", "min", "q25", "q50", "q75", "max")]
    return found[0].unionByName(found[1]).select("column", "count", *times)


@query("offset_times", """select event_id, date_trunc('second', ts) as ts, date_trunc('day', ts) as day, date_trunc('month', ts) as month from events""")
def offset_times(spark, folder):
    """Times told in three zones, days without separators, and months, read back in UTC."""
    ts, k = F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 3
    told = lambda hours, tail: F.concat(F.date_format(ts + F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(tail))
    raw = table(spark, folder, "events").select(
        "event_id", F.when(k == 0, told(0, "Z")).when(k == 1, told(2, "+02:00")).otherwise(told(-5, ".0-0500")).alias("ts"),
        F.date_format(ts, "yyyyMMdd").alias("day"), F.date_format(ts, "yyyy-MM").alias("month"))
    return schema.coerce_datetimes(raw)


@query("datetime_coercion", """select o_orderkey, case when o_orderstatus <> 'F' or o_orderpriority <> '1-URGENT' then o_orderdate end as mostly_date,
 case when o_orderstatus = 'O' then strftime(o_orderdate, '%Y-%m-%d') else o_orderstatus end as some_dates from orders""")
def datetime_coercion(spark, folder):
    status, day = F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when((status == "F") & (F.col("o_orderpriority") == "1-URGENT"), "pending")
        .when(status == "O", F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(day).alias("mostly_date"),
        F.when(status == "O", day).otherwise(status).alias("some_dates"))
    return schema.coerce_datetimes(raw)


@query("day_first_dates", """select o_orderkey, o_orderdate as european, o_orderdate as dotted, o_orderdate as american, date_trunc('minute', o_orderdate) as timed,
 case when day(o_orderdate) <= 12 then strftime(o_orderdate, '%m/%d/%Y') else 'no date' end as doubtful from orders""")
def day_first_dates(spark, folder):
    """Dates told day first, with slashes, dots and times of day, and month first; the days above twelve decide for a whole column."""
    day = F.col("o_orderdate")
    raw = table(spark, folder, "orders").select(
        "o_orderkey", F.date_format(day, "dd/MM/yyyy").alias("european"), F.date_format(day, "d.M.yyyy").alias("dotted"), F.date_format(day, "M/d/yyyy").alias("american"),
        F.date_format(day, "d/M/yyyy H:mm").alias("timed"),
        F.when(F.dayofmonth(day) <= 12, F.date_format(day, "MM/dd/yyyy")).otherwise("no date").alias("doubtful"))
    return schema.coerce_datetimes(raw)
