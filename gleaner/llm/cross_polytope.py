"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-rotation: three rounds of random signs and a fast Hadamard transform, over the width raised to a power of two."""
    width = 1 << max(x.shape[1] - 1, 0).bit_length()
    out = np.zeros((len(x), width))
    out[:, :x.shape[1]] = x
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        out *= s
        half = 1
        while half < width:
            pair = out.reshape(len(x), -1, 2, half)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), width)
            half *= 2
    return out


def axes(x: np.ndarray, table: int, seed: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first."""
    turned = rotate(x, table, seed)
    return np.argsort(-np.hstack([turned, -turned]), axis=1, kind="stable")[:, :probes]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _buckets(vectors: DataFrame, tables: int, probes: int | None, seed: int) -> DataFrame:
    """A row for each vector, table and probed axis; all axes of the first table where ``probes`` is None."""

    def rows(frames):
        for frame in frames:
            for width, part in frame.groupby(frame["vec"].str.len()):
                x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                # Scaled first, so that very small and very large vectors keep their direction.
                x = x / np.abs(x).max(axis=1, keepdims=True)
                most = 2 << max(width - 1, 0).bit_length()
                near = [axes(x, t, seed, min(probes or most, most)) for t in range(tables)]
                table = np.repeat(np.arange(tables), [a.shape[1] for a in near])
                yield pd.DataFrame({
                    "vec_id": part["vec_id"], "vec": part["vec"], "width": width, "places": list(
                        np.stack([np.tile(table, (len(x), 1)), np.hstack(near)], axis=2).reshape(len(x), -1).astype(np.int32))})

    spread = vectors.mapInPandas(rows, "vec_id long, vec array<double>, width int, places array<int>")
    pairs = F.transform(F.sequence(F.lit(0), F.size("places") - 2, F.lit(2)), lambda i: F.struct(
        F.get("places", i).alias("table"), F.get("places", i + 1).alias("axis")))
    return spread.select("vec_id", "vec", "width", F.explode(pairs).alias("b")).select("vec_id", "vec", "width", "b.table", "b.axis")


KEY = ["width", "table", "axis"]


def _search(vectors: DataFrame, queries: DataFrame, k: int, tables: int, probes: int | None, block: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score): for each query and probed bucket block the ``k`` best ids, each by its best vector."""
    stored, asked = _buckets(vectors, tables, 1, seed), _buckets(queries, tables, probes, seed)
    parts = lambda df, name: df.groupBy(KEY).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    # Buckets number 2 x width x tables, so these counts may be broadcast; a full bucket is dealt to blocks on both sides.
    counts = F.broadcast(parts(stored, "stored_parts").join(parts(asked, "asked_parts"), KEY))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id", "vec"), F.col(n)).cast("int")
    cut = ["vec_id", "vec", *KEY, "stored_part", "asked_part"]
    left = stored.join(counts, KEY).withColumn("stored_part", own("stored_parts")).withColumn("asked_part", every("asked_parts")).select(*cut)
    right = asked.join(counts, KEY).withColumn("asked_part", own("asked_parts")).withColumn("stored_part", every("stored_parts")).select(*cut)

    def best(data: pa.Table, ask: pa.Table) -> pa.Table:
        ids, named = data["vec_id"].to_numpy(), ask["vec_id"].to_numpy()
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(ids) and len(named):
            by_id = np.argsort(ids, kind="stable")
            ids, x, q = ids[by_id], _matrix(data["vec"])[by_id], _matrix(ask["vec"])
            rough = q @ x.T
            rough[named[:, None] == ids[None]] = -np.inf
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            each = np.cumsum(np.append(True, ids[1:] != ids[:-1])) - 1
            most = np.maximum.reduceat(rough, first, axis=1)
            at = min(k, len(first)) - 1
            bar = -np.partition(-most, at, axis=1)[:, at]
            # Equal vectors must score equally, so what is near the bar and the best of its id is summed again in one fixed order.
            slack = lambda v: v - 1e-9 * (1 + np.abs(v))
            with np.errstate(invalid="ignore"):
                near = np.isfinite(rough) & (rough >= slack(most)[:, each]) & ((rough >= slack(bar)[:, None]) | ~np.isfinite(bar)[:, None])
            qi, xi = np.nonzero(near)
            score = (q[qi] * x[xi]).sum(axis=1)
            order = np.lexsort((-score, ids[xi], qi))
            qi, xi, score = qi[order], xi[order], score[order]
            once = np.append(True, (qi[1:] != qi[:-1]) | (ids[xi[1:]] != ids[xi[:-1]]))[:len(qi)]
            qi, xi, score = qi[once], xi[once], score[once]
            order = np.lexsort((ids[xi], -score, qi))
            qi, xi, score = qi[order], xi[order], score[order]
            place = np.arange(len(qi)) - np.searchsorted(qi, qi)
            keep = place < k
            out = [named[qi[keep]], ids[xi[keep]], score[keep]]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out)))

    keys = [*KEY, "stored_part", "asked_part"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(best, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, asked: Column, vec_id: str = "vec_id", vec: str = "embedding", k: int = 20, tables: int = 5,
            probes: int = 32, block: int = 4096, seed: int = 3) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` rows of largest inner product found for each row where ``asked``.

    Every vector is stored under its nearest signed axis in each of ``tables`` pseudo-rotations; a query looks under its
    ``probes`` nearest axes in each, and candidates are reranked by their double-precision inner product, ties to the smaller id.
    A query that finds fewer than ``k`` looks under all axes of one table, so it gets all candidates there are.

    Null ids, and vectors that are null, empty, zero, or hold null or non-finite components, take no part; vectors meet those of
    their own width only; rows that repeat a query's id are not its candidates, and repeated rows count once; an empty table gives
    no rows; further columns are ignored."""
    usable = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(
        "vec", lambda v: v != 0)
    base = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vec}`").cast("array<double>").alias("vec"), asked.alias("asked"))
    base = base.where(F.col("vec_id").isNotNull() & usable)
    base = materialise(base.groupBy("vec_id", "vec").agg(F.max("asked").alias("asked")), "vectors")
    stored, queries = base.select("vec_id", "vec"), base.where("asked").select("vec_id", "vec")
    once = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = materialise(top(once(_search(stored, queries, k, tables, probes, block, seed))), "found")
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.join(counts, queries["vec_id"] == counts["query_id"], "left").where(F.coalesce("n", F.lit(0)) < k).select("vec_id", "vec")
    rest = _search(stored, materialise(short, "short"), k, 1, None, block, seed)
    return top(once(found.select("query_id", "vec_id", "score").unionByName(rest))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
