"""A pipeline over ``documents``: quality, near-duplicates, benchmark leaks, secrets, and the mix of sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise
from gleaner.llm import guess_cost, ordinal_quality, set_sketch, source_mix, template_decontam


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return ordinal_quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return set_sketch.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return template_decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; ``n_chars`` follows the text where it changed."""
    changed = guess_cost.redact(docs.withColumn("__chars_before", F.char_length("text")))
    after = F.char_length("text")
    n = F.when(after == F.col("__chars_before"), F.col("n_chars")).otherwise(after.cast("long")) if "n_chars" in docs.columns else None
    return (changed if n is None else changed.withColumn("n_chars", F.coalesce(n, F.col("n_chars")))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often it takes them (``copies``)."""
    return source_mix.with_copies(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mixed", mixed)]

#: The quality and near-duplicate stages fit a model and estimate sketches, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
