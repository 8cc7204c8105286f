"""Tables from extracted cells (file, page, row, col, cell)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """One row per table row below the header, its cells as a map from header to trimmed text.

    The lowest row of a (file, page) is its header; blank headers become col_{i}, repeated ones get a number. Blank cells
    are left out, rows without any cell are dropped, and a page needs at least one row below its header.
    """
    text = F.nullif(F.trim("cell"), F.lit(""))
    rows = cells.groupBy("file", "page", "row").agg(
        F.array_sort(F.collect_list(F.struct("col", text.alias("cell")))).alias("cells"))
    headers = rows.groupBy("file", "page").agg(F.min_by("cells", "row").alias("header"), F.min("row").alias("header_row")) \
        .withColumn("names", F.transform("header", lambda h: F.coalesce(h["cell"], F.concat(F.lit("col_"), h["col"].cast("string"))))) \
        .select("file", "page", "header_row", F.map_from_arrays(
            F.transform("header", lambda h: h["col"]),
            F.transform("names", lambda name, i: F.when(
                F.array_position("names", name) < i + 1,
                F.concat(name, F.lit("_"), F.size(F.filter(F.slice("names", F.lit(1), i + 1), lambda n: n == name)).cast("string"))).otherwise(name))
        ).alias("names"))
    # One header row per page: a page with very many rows is split by the skew handling of this join.
    body = rows.join(headers, ["file", "page"]).where(F.col("row") > F.col("header_row"))
    filled = F.filter("cells", lambda c: c["cell"].isNotNull() & F.map_contains_key("names", c["col"]))
    named = F.transform(filled, lambda c: F.struct(F.element_at("names", c["col"]).alias("key"), c["cell"].alias("value")))
    return body.select("file", "page", "row", F.map_from_entries(named).alias("cells")).where(F.size("cells") > 0)


def largest_table(rows: DataFrame) -> DataFrame:
    """The rows of each file's page with the most rows, the first page on a tie."""
    sizes = rows.groupBy("file", "page").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("file").agg(F.min_by("page", F.struct((-F.col("n")).alias("order"), "page")).alias("page"))
    return rows.join(best, ["file", "page"], "left_semi")


def to_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Map rows as a table with the given columns."""
    return rows.select("file", "page", "row", *[F.try_element_at(F.col("cells"), F.lit(c)).alias(c) for c in columns])
