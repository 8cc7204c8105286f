"""Helpers shared by the operators of this subpackage."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise

#: Low bits of a place in a bit field that one row of its making holds.
CHUNK_BITS = 15


def bounded_batches(spark: SparkSession, rows: int = 2_000, size: int = 8 << 20) -> None:
    """Texts are long, so Python workers get at most so many rows and bytes of them at a time. Smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


class Screen:
    """A bit field of fixed size over 64-bit keys: it lets through every key it was made of, and few others.

    What passes is joined exactly afterwards, so the field only spares shuffled rows; it is broadcast, and its size doesn't
    depend on the data."""

    def __init__(self, keys: DataFrame, bits: int = 24):
        """``keys``: one column of longs."""
        size = 1 << CHUNK_BITS

        def places(frames):
            for frame in frames:
                yield pd.DataFrame({"place": np.unique(_place(frame.iloc[:, 0].to_numpy(np.int64), bits))})

        chunks = keys.dropna().mapInPandas(places, "place long").distinct().groupBy(F.shiftright("place", CHUNK_BITS).alias("chunk")).agg(
            F.collect_list((F.col("place") % size).cast("int")).alias("low"))

        def packed(frames):
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"chunk": frame["chunk"], "field": [
                        np.packbits(np.bincount(np.asarray(low), minlength=size) > 0, bitorder="little").tobytes() for low in frame["low"]]})

        field = bytearray(1 << bits - 3)
        for row in chunks.mapInPandas(packed, "chunk long, field binary").collect():  # at most one field's bytes in all
            field[row["chunk"] * (size >> 3):(row["chunk"] + 1) * (size >> 3)] = row["field"]
        self.bits, self.sent = bits, keys.sparkSession.sparkContext.broadcast(bytes(field))

    def passes(self, keys: np.ndarray) -> np.ndarray:
        field = np.frombuffer(self.sent.value, dtype=np.uint8)
        place = _place(keys, self.bits)
        return field[place >> 3] >> (place & 7).astype(np.uint8) & 1 != 0


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.int64).view(np.uint64) * np.uint64(11400714819323198485) >> np.uint64(64 - bits)).astype(np.int64)


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (the smallest id reachable) for every id in ``links`` (a, b).

    Alternates large-star and small-star steps: each id hands its neighbours to its smallest neighbour until only stars are
    left, in a number of rounds that grows with the logarithm of the longest path. Minima are found by aggregation and joined
    back, so one id may have any number of links."""

    def stars(edges: DataFrame, both: bool) -> DataFrame:
        """Edges go from the larger id a to the smaller b."""
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = around.join(least, "a")
        if both:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        edges = materialise(stars(stars(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
