"""Queries for readers and table preparation. Files are written by Spark from the given tables first."""

from pyspark.sql import functions as F

from gleaner.catalog import query, table
from gleaner.functions.storage import fresh_path
from gleaner.sources import cells, files, prepare


@query("csv_scan", """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, user_id, case when event_type <> 'view' then event_type end as event_type,
 case when event_type = 'click' then 'inf'::double when event_type <> 'error' then value end as value, props,
 case when event_type <> 'error' then user_id::double end as user_or_gap, event_type = 'error' as failed from events""")
def csv_scan(spark, folder):
    path = fresh_path(spark, "csv")
    kind = F.col("event_type")
    table(spark, folder, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "user_id", F.when(kind != "view", kind).otherwise("NULL").alias("event_type"),
        F.when(kind == "click", "inf").when(kind == "error", "N/A").otherwise(F.col("value").cast("string")).alias("value"), "props",
        F.when(kind != "error", F.col("user_id").cast("string")).otherwise("nan").alias("user_or_gap"),
        F.when(kind == "error", "True").otherwise("False").alias("failed"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return files.scan_csv(spark, path)


@query("csv_mixed_folder", """select event_id, 1000000000000000000 + event_id as long_id, 'caf' || chr(233) || ' ' || event_type as label,
 case when event_id % 3 <> 1 then value end as value from events""")
def csv_mixed_folder(spark, folder):
    """Files with a byte-order mark, in Latin-1 without one of the columns, and in UTF-8 with the columns in another order."""
    path = fresh_path(spark, "mixed")
    events = table(spark, folder, "events").select(
        "event_id", (F.col("event_id") + 1_000_000_000_000_000_000).alias("long_id"),
        F.concat(F.lit("caf\u00e9 "), "event_type").alias("label"), "value")
    part = lambda k: events.where(F.col("event_id") % 3 == k)
    part(0).withColumnRenamed("event_id", files.BYTE_ORDER_MARK + "event_id").write.option("header", True).csv(path)
    part(1).drop("value").write.mode("append").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    part(2).select("value", "label", "event_id", "long_id").write.mode("append").option("header", True).csv(path)
    return files.scan_csv(spark, path)


@query("text_scan", r"""select item_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\A\s+|\s+\z', '', 'g') as text from benchmark""")
def text_scan(spark, folder):
    path = fresh_path(spark, "texts")
    table(spark, folder, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    return files.scan_texts(spark, path).select(F.col("item_id").cast("bigint").alias("item_id"), "text")


@query("file_inventory", """select item_id, 'txt' as kind, (octet_length(encode(text)) + 1)::bigint as bytes, null::varchar as error from benchmark""")
def file_inventory(spark, folder):
    path = fresh_path(spark, "listing")
    table(spark, folder, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    found = files.file_inventory(spark, path)
    return found.select(
        F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), "kind", "bytes", "error")


@query("prepare_table", """select event_id as column_1, event_type as x, case when event_type not in ('error', 'click') then value end as x_3, user_id as x_2 from events""")
def prepare_table(spark, folder):
    kind, value = F.col("event_type"), F.col("value")
    messy = table(spark, folder, "events").select(
        F.col("event_id").alias(" "), kind.alias("x"),
        F.when(kind == "error", float("inf")).when(kind == "click", float("nan")).otherwise(value).alias("x "),
        F.col("user_id").alias("x_2"), F.lit(None).cast("string").alias("nothing"))
    return prepare.prepare_table(messy)[0]


def event_cells(spark, folder):
    """Events as extracted tables: a file per user, a page per event type, a header row and one row per event."""
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("file"), F.col("event_type").alias("page"), F.col("event_id").alias("row"), "value", "props")
    body = events.select("file", "page", "row", F.inline(F.array(
        F.struct(F.lit(0).alias("col"), F.concat(F.lit(" "), F.col("row").cast("string")).alias("cell")),
        F.struct(F.lit(1).alias("col"), F.when(F.col("value") >= 1, F.col("value").cast("string")).otherwise(" ").alias("cell")),
        F.struct(F.lit(2).alias("col"), F.col("props").alias("cell")))))
    heads = events.select("file", "page").distinct().select("file", "page", F.lit(-1).cast("bigint").alias("row"), F.inline(F.array(
        F.struct(F.lit(0).alias("col"), F.lit("id").alias("cell")), F.struct(F.lit(1).alias("col"), F.lit(" ").alias("cell")),
        F.struct(F.lit(2).alias("col"), F.lit("id").alias("cell")))))
    return heads.unionByName(body)


CELLS_SQL = """rows_of as (select user_id as file, event_type as page, event_id as "row", event_id::varchar as id,
 case when value >= 1 then value::varchar end as col_1, props as id_2 from events)"""


@query("cells_to_table", f"with {CELLS_SQL} select * from rows_of")
def cells_to_table(spark, folder):
    return cells.to_table(cells.cells_to_rows(event_cells(spark, folder)), ["id", "col_1", "id_2"])


@query("largest_table", f"""with {CELLS_SQL}, sizes as (select file, page, count(*) as n from rows_of group by file, page),
best as (select file, page from sizes qualify row_number() over (partition by file order by n desc, page) = 1)
select rows_of.* from rows_of join best using (file, page)""")
def largest_table(spark, folder):
    rows = cells.largest_table(cells.cells_to_rows(event_cells(spark, folder)))
    return cells.to_table(rows, ["id", "col_1", "id_2"])


@query("load_report", """with held as (
 select 'csv/source=' || coalesce(source, 'none') as folder, 'csv' as kind, count(*) as rows, 4::int as columns, null::bigint as characters, null::varchar as error
 from documents group by source
 union all select 'txt/item_id=' || item_id, 'txt', null, null, length(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\A\\s+|\\s+\\z', '', 'g')), null from benchmark
 union all select 'other', 'unknown', null, null, null, 'Unsupported file type. Please upload CSV, Excel, PDF, or TXT.' from (select 1)
 union all select 'gaps', 'csv', count(*), 2, null, 'The CSV file contains no usable rows.' from labels
 union all select 'empty', 'txt', null, null, null, 'The uploaded file is empty.' from (select 1)
 union all select 'blank', 'txt', null, null, 0, 'The text file is empty after decoding.' from (select 1))
select * from held""")
def load_report(spark, folder):
    """Tables of documents by source, benchmark texts, labels in a format that isn't read and as cells that are all missing, an empty and a blank file."""
    path = fresh_path(spark, "load")
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    named = documents.select("doc_id", "lang", "n_chars", F.concat(F.lit('a "b", c'), "source").alias("label"), F.coalesce("source", F.lit("none")).alias("source"))
    named.repartition("source").write.option("header", True).option("escape", '"').partitionBy("source").csv(f"{path}/csv")
    table(spark, folder, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(f"{path}/txt")
    labels.coalesce(1).write.json(f"{path}/other")
    labels.select(F.lit("NA").alias("doc_id"), F.lit("null").alias("quality")).coalesce(1).write.option("header", True).csv(f"{path}/gaps")
    labels.limit(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{path}/empty")
    labels.limit(1).select(F.lit(" \t ").alias("value")).coalesce(1).write.text(f"{path}/blank")
    found = files.folder_report(spark, path)
    return found.select(F.regexp_extract(F.url_decode("path"), r"/load-[0-9a-f]+/(.*)/[^/]+$", 1).alias("folder"), "kind", "rows", "columns", "characters", "error")
