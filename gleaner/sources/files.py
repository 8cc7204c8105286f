"""File inventory, CSV and text readers."""

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.fixed import FILE_KINDS, MISSING_CELLS, NUMBER_SHAPE, REJECT_EMPTY, REJECT_KIND, REJECT_ROWS, REJECT_SIZE, REJECT_TEXT
from gleaner.functions.text import compact_text

BYTE_ORDER_MARK = "\ufeff"
# The same three bytes of UTF-8 read as Latin-1.
LATIN_ORDER_MARK = "\u00ef\u00bb\u00bf"
GLOB_MARKS = "*?[{"
WHOLE_NUMBER = r"^[+-]?[0-9]{1,38}$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"


def file_kind(path: Column) -> Column:
    """csv, excel, pdf, txt or unknown by extension."""
    kinds = F.create_map(*[F.lit(x) for pair in FILE_KINDS.items() for x in pair])
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(kinds, extension), F.lit("unknown"))


def file_inventory(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Every file below ``path`` with kind, size and, when it cannot be used, the reason. Contents are not read.

    Files may have any size unless ``max_bytes`` sets a limit."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # Scans skip empty files, but the file index lists them.
    names = [(unquote(name).replace("file:///", "file:/", 1),) for name in found.inputFiles()]
    listing = spark.createDataFrame(names, "path string").join(found.select("path", "length"), "path", "left") \
        .withColumn("length", F.coalesce("length", F.lit(0)))
    kind = file_kind(F.col("path"))
    error = F.when(F.col("length") == 0, REJECT_EMPTY)
    if max_bytes is not None:
        error = error.when(F.col("length") > max_bytes, REJECT_SIZE)
    return listing.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), kind.alias("kind"), F.col("length").alias("bytes"),
        error.when(kind == "unknown", REJECT_KIND).alias("error"))


def scan_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV with a header: missing-value cells as null, columns numeric where every value is.

    Each file is UTF-8 or else Latin-1 and has a header of its own: files that agree in both are read together, and the
    groups are stacked by column name, so that columns may come in any order or be absent (null) from some files.
    All cells are read as text once to decide types, in one aggregate, and again for the typed result.
    ``multiline`` accepts line breaks inside quotes, at the price of one task per file.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    found = file_formats(spark, path)
    kinds = found.groupBy("latin", "header").agg(F.min("file").alias("first")).orderBy("first").collect()
    tables = []
    for kind in kinds:
        # One kind of file is read by the path itself; the files of several kinds are told apart by name.
        files, source = path, reader.option("encoding", "ISO-8859-1" if kind["latin"] else "UTF-8")
        if len(kinds) > 1:
            same = found.where((F.col("latin") == F.lit(kind["latin"])) & (F.col("header") == F.lit(kind["header"])))
            files = [unquote(r["file"]) for r in same.select("file").orderBy("file").collect()]
            source = source if set(path) & set(GLOB_MARKS) else source.option("basePath", path)
        cells = source.csv(files)
        # A byte-order mark belongs to no column name; Latin-1 shows its three bytes as letters.
        tables.append(cells.toDF(*[c.removeprefix(BYTE_ORDER_MARK).removeprefix(LATIN_ORDER_MARK) for c in cells.columns]))
    return infer_types(union_tables(tables) if tables else reader.csv(path))


def file_formats(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``latin`` (it isn't valid UTF-8) and ``header`` (its first line that isn't blank) of every text file, in one scan.

    Lines of a file's first block come in order, so the least row id among them is the first line's."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    text = F.trim(F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), f"^{LATIN_ORDER_MARK}|\\r$", ""))
    at = F.when((F.col("block") == 0) & (text != ""), F.monotonically_increasing_id())
    return lines.select("file", (~F.is_valid_utf8("value")).alias("bad"), F.when(at.isNotNull(), text).alias("line"), at.alias("at")) \
        .groupBy("file").agg(F.bool_or("bad").alias("latin"), F.min_by("line", "at").alias("header")).where("header is not null")


def infer_types(cells: DataFrame) -> DataFrame:
    """Missing-value cells to null, then whole numbers, numbers or booleans where every remaining cell is one."""
    names = cells.columns
    held = cells.toDF(*[f"c{i}" for i in range(len(names))])
    # A blank cell is missing, and so is a cell that is one of the fixed texts, without blanks around it.
    held = held.select([F.when(~F.col(c).isin(MISSING_CELLS), F.col(c)).alias(c) for c in held.columns])
    checks = []
    for c in held.columns:
        cell = F.trim(c)
        checks += [
            F.count(c).alias(f"n_{c}"), F.count_if(cell.rlike(WHOLE_NUMBER)).alias(f"w_{c}"),
            F.count_if(cell.rlike(WHOLE_NUMBER) & cell.try_cast("bigint").isNull()).alias(f"l_{c}"),
            F.max(F.abs(cell.try_cast("decimal(38,0)"))).alias(f"m_{c}"),
            F.count_if(cell.rlike(NUMBER_SHAPE) | cell.rlike(INFINITE)).alias(f"d_{c}"),
            F.count_if(F.lower(cell).isin("true", "false")).alias(f"b_{c}")]
    row = held.agg(F.count(F.lit(1)).alias("rows"), *checks).first()
    typed = []
    for c, name in zip(held.columns, names):
        n, cell = row[f"n_{c}"], F.trim(c)
        if n and row[f"w_{c}"] == n:
            # Whole numbers with gaps become doubles, as missing values are not whole numbers, unless a double would lose digits; longer
            # ones keep all digits.
            if row[f"l_{c}"]:
                value = cell.cast("decimal(38,0)")
            else:
                value = cell.cast("bigint")
                if n < row["rows"] and row[f"m_{c}"] <= 1 << 53:
                    value = value.cast("double")
        elif n and row[f"d_{c}"] == n:
            value = F.when(cell.rlike(INFINITE), F.when(cell.startswith("-"), float("-inf")).otherwise(float("inf"))) \
                .otherwise(cell.try_cast("double"))
        elif n and row[f"b_{c}"] == n and n == row["rows"]:
            value = F.lower(cell) == "true"
        else:
            value = F.col(c)
        typed.append(value.alias(name))
    return held.select(typed)


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: path and compacted text, UTF-8 or else Latin-1. Folder partition columns are kept."""
    files = spark.read.format("binaryFile").load(path)
    partitions = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select("path", *partitions, _decoded(F.col("content")).alias("text"))


def folder_report(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """The inventory of ``path`` with what each file holds: ``rows`` and ``columns`` of tables, ``characters`` of texts, and the reason in ``error``
    where a file holds nothing that can be used.

    Each format is read once, whatever the number of its files, and counted by the file that a line came from. A row is a line with any
    cell that isn't missing; Excel and PDF files are listed only."""
    listing = file_inventory(spark, path, max_bytes)
    reader = lambda ending: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*." + "".join(f"[{c}{c.upper()}]" for c in ending))
    key = F.col("_metadata.file_path").alias("from")
    lines = reader("csv").text(path).select(key, F.trim(F.regexp_replace("value", f"^{BYTE_ORDER_MARK}|\\r$", "")).alias("line"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where("line <> ''").withColumn("at", F.when(F.col("block") == 0, F.monotonically_increasing_id()))
    missing = "|".join(re.escape(c) for c in MISSING_CELLS if c)
    usable = ~F.col("line").rlike(rf"^(?:(?:{missing})?,)*(?:{missing})?$")
    tables = lines.groupBy("from").agg(
        F.min_by("line", "at").alias("header"), F.count(F.lit(1)).alias("lines"), F.count_if(usable).alias("usable"), F.min_by(usable, "at").alias("told")).select(
            "from", (F.col("lines") - 1).alias("rows"), F.regexp_count("header", F.lit(r'(?:^|,)(?:"(?:[^"]|"")*"|[^,"]*)')).alias("columns"),
            (F.col("usable") - F.col("told").cast("int") < 1).alias("useless"))
    texts = reader("txt").format("binaryFile").load(path).select(F.col("path").alias("from"), F.char_length(_decoded(F.col("content"))).cast("long").alias("characters"))
    # The scan of lines tells its files as addresses, the others as plain paths.
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    decoded = F.url_decode(F.regexp_replace("from", r"\+", "%2B"))
    found = listing.withColumn("name", plain("path")).join(tables.withColumn("name", plain(decoded)).drop("from"), "name", "left").join(
        texts.withColumn("name", plain("from")).drop("from"), "name", "left")
    error = F.coalesce("error", F.when((F.col("kind") == "csv") & F.coalesce("useless", F.lit(True)), REJECT_ROWS).when(
        (F.col("kind") == "txt") & (F.coalesce("characters", F.lit(0)) == 0), REJECT_TEXT))
    return found.withColumn("error", error).select("path", "file", "kind", "bytes", "rows", F.col("columns").cast("int").alias("columns"), "characters", "error")


def _decoded(content: Column) -> Column:
    """Bytes of a text file as compacted text, UTF-8 or else Latin-1."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return compact_text(F.regexp_replace(text, f"^{BYTE_ORDER_MARK}", ""))


def load_report(inventory: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """An inventory with row and column counts of tables that a caller has read itself, by file name."""
    spark = inventory.sparkSession
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("columns", T.IntegerType())])
    # One row per file that was opened as a table.
    counted = spark.createDataFrame([(name, df.count(), len(df.columns)) for name, df in tables.items()], schema)
    return inventory.join(F.broadcast(counted), "file", "left")


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Like tables stacked by column name; columns missing from one become null."""
    result = tables[0]
    for other in tables[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result
