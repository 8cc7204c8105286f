"""Queries of this subpackage over the test tables and, where SQL can say the same, the equivalent DuckDB text."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.storage import fresh_path
from gleaner.llm import (chat_format, cross_polytope, fill_in_middle, guess_cost, hd_language, ordinal_quality, product_codes, set_sketch, source_mix,
                         suffix_ranges, template_decontam, warc_salvage, window_repeats)
from gleaner.llm.oracles import CHAT_SQL, CODES_SQL, MIDDLE_SQL, NEAR_SQL, REPEATS_SQL, WARC_SQL, WINDOWS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_ordinal_quality")
def op1(spark, folder):
    return ordinal_quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_source_mix")
def op2(spark, folder):
    return source_mix.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op3_warc_salvage", WARC_SQL)
def op3(spark, folder):
    path = fresh_path(spark, "warc")
    warc_salvage.write_archives(table(spark, folder, "pages"), path)
    # These archives are whole, so a gap in them is an error and not a row to leave out.
    page = F.when(F.col("kind") == "gap", F.raise_error(F.lit("a gap in archives just written")).cast("long")).otherwise(F.col("page_id"))
    return warc_salvage.read_archives(spark, path).select(
        page.alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


@query("op4_suffix_ranges", REPEATS_SQL)
def op4(spark, folder):
    found = suffix_ranges.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_cross_polytope")
def op5(spark, folder):
    return cross_polytope.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_hd_language")
def op6(spark, folder):
    return hd_language.identify(table(spark, folder, "documents"))


@query("op7_guess_cost")
def op7(spark, folder):
    return guess_cost.digest_columns(table(spark, folder, "documents"))


@query("op8_set_sketch", NEAR_SQL)
def op8(spark, folder):
    return set_sketch.near_duplicates(table(spark, folder, "documents"))


@query("op9_template_decontam")
def op9(spark, folder):
    return template_decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_chat_format", CHAT_SQL)
def op10(spark, folder):
    sample = spark.createDataFrame([(-7, t, role, "</s>[INST] ok [/INST]") for t, role in enumerate(("user", "assistant"))],
                                   "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(sample)
    laid = chat_format.format_conversations(turns)
    read, loss = chat_format.read_turns(F.col("formatted")), chat_format.loss_text(F.col("segments"))
    return laid.select("conv_id", read.alias("turns"), loss.alias("loss"), "formatted").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op11_slice_codes", CODES_SQL)
def op11(spark, folder):
    return product_codes.digest_columns(table(spark, folder, "embeddings"))


@query("op12_fill_in_middle", MIDDLE_SQL)
def op12(spark, folder):
    return fill_in_middle.digest_columns(table(spark, folder, "documents"))


@query("op13_window_repeats", WINDOWS_SQL)
def op13(spark, folder):
    found = window_repeats.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
