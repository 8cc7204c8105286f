"""Mixes sources to target sizes by subset-sum budget fitting on counts of documents by length."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise

#: Words in which the last part of a budget is fitted exactly.
FIT_WIDTH = 1 << 16
#: Sub-groups of each (source, length) group, so that many documents of one length are ranked by several tasks.
SLOTS = 64
#: Parts, by hash, in which rows without an id are ranked.
PARTS = 1024


def count_words(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``target`` per source of ``sizes`` (source, size).

    Sources in code point order, null last, have the weights in turn and share ``share`` times all sizes. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight until none is above. That is a water level: of the
    sources ordered by limit over weight, the first ones stop at their limit, and the others get level times weight. The windows
    run over one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    limited = by_source.withColumn("place", place).select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
        .cast("double").alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("limit"))
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    found = limited.withColumn("level", level).withColumn(
        "final", F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("limit") / F.col("weight"))).over(everything))
    at = F.max(F.when(F.col("limit") / F.col("weight") == F.col("final"), F.col("level"))).over(everything)
    return found.withColumn("at", at).select(
        "source", "source_size",
        F.when(F.col("at").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("at") * F.col("weight"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, width: int = FIT_WIDTH) -> np.ndarray:
    """How many documents of each length to take so that their sum comes as near to ``budget`` as the fit finds.

    An even share of each length leaves a rest; longer documents first bring it within ``width``; bounded-knapsack dynamic
    programming over the documents left closes it."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left, rest = counts - taken, budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= width // 2:
            break
        if lengths[i]:
            k = min(int(left[i]), (rest - width // 2) // int(lengths[i]))
            taken[i], left[i], rest = taken[i] + k, left[i] - k, rest - k * int(lengths[i])
    top = rest + width // 2
    reached, via = np.zeros(top + 1, dtype=bool), np.full(top + 1, -1, dtype=np.int64)
    reached[0] = True
    items = []  # (index of the length, number of documents), by binary parts
    for i in np.argsort(-lengths, kind="stable"):
        n, k = int(left[i]), 1
        while lengths[i] and n > 0 and lengths[i] * min(k, n) <= top and not reached[rest]:
            part = min(k, n)
            step = int(lengths[i]) * part
            new = np.flatnonzero(reached[:-step] & ~reached[step:]) + step
            via[new] = len(items)
            reached[new] = True
            items.append((i, part))
            n, k = n - part, k * 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - rest).argmin()])
    while at:
        i, part = items[via[at]]
        taken[i] += part
        at -= int(lengths[i]) * part
    return taken


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    """Whole passes over a source and, by length, the number of documents taken once more."""
    frame = frame.sort_values("size").reset_index(drop=True)
    lengths, counts = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
    size, target = int(frame["source_size"][0]), float(frame["target"][0])
    passes = int(target // size) if size else 0
    extra = fit(lengths, counts, round(target - passes * size)) if size else np.zeros(len(frame), np.int64)
    return pd.DataFrame({"source": frame["source"], "size": lengths, "passes": passes, "extra": extra})


def mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights=(3, 1, 2), share: float = 1.5,
        most: float = 2.0, seed: int = 17) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` for every row of ``docs``.

    Each source is read in whole passes as often as its target holds it, then documents are added by length; which ones of a
    length is drawn by a seeded hash of the id. ``copies`` is how often the mix takes a document, ``taken`` its words times that.

    Null texts have size 0 and are never needed (taken 0); null sources form the last source; null ids and repeated rows are
    documents of their own, and which of several equal rows is taken makes no difference; an empty table gives no rows; further
    columns are ignored."""
    sized = materialise(docs.select(
        F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        count_words(F.col(f"`{text}`")).alias("size")), "sizes").withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    slotted = sized.withColumn("slot", F.pmod("draw", F.lit(SLOTS)).cast("int"))
    cells = slotted.groupBy("source", "size", "slot").agg(F.count("*").alias("n"))
    goals = targets(sized.select("source", "size"), weights, share, most)
    # A source without a name is told from one that is named "" by the flag; the key is never null, so plain joins hold.
    keyed = lambda df: df.withColumn("named", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    goals = materialise(keyed(goals), "targets")
    cells = materialise(keyed(cells), "cells")
    lengths = cells.groupBy("source", "named", "size").agg(F.sum("n").alias("n")).join(goals, ["source", "named"])
    planned = lengths.groupBy("source", "named").applyInPandas(
        lambda key, frame: _plan(frame).assign(named=key[1]), "source string, size long, passes int, extra long, named boolean")
    earlier = W.partitionBy("source", "named", "size").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    allotted = cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(planned, ["source", "named", "size"]).select(
        "source", "named", "size", "slot", "passes", F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("n")).alias("extra"))
    ranked = keyed(slotted).join(allotted, ["source", "named", "size", "slot"]).join(goals, ["source", "named"]).withColumn(
        "place", F.row_number().over(W.partitionBy("source", "named", "size", "slot").orderBy("draw", "doc_id")))
    copies = F.col("passes") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)
    return ranked.select(
        "doc_id", F.when(F.col("named"), F.col("source")).alias("source"), "size", "source_size", "target",
        copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def with_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``copies``, how often it takes them.

    Of rows that repeat an id, a source and a size, those with the least hash of text and further columns come first, so reruns
    keep the same ones however the rows are dealt; rows without an id are ranked in parts of that hash, as they may be many. Null
    texts and texts without a word can't fill a target, but stay with one copy, as they cost nothing. A column named ``copies``
    gives way to the result's; an empty table gives no rows."""
    key = ["mix_id", "mix_source", "mix_size"]
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name != text and "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumns({
        "mix_id": F.col(f"`{doc}`"), "mix_source": F.col(f"`{source}`").cast("string"), "mix_size": count_words(F.col(f"`{text}`")),
        "mix_draw": F.xxhash64(F.col(f"`{text}`"), *others)})
    keyed = keyed.withColumn("mix_slot", F.when(F.col("mix_id").isNull(), F.pmod("mix_draw", F.lit(PARTS)).cast("int")).otherwise(0))
    base = F.min("copies")
    plan = materialise(mix(docs, doc, text, source, **options).select(
        F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), "copies").groupBy(*key).agg(
        base.alias("mix_base"), (F.sum("copies") - base * F.count("*")).alias("mix_extra")), "plan")

    def same(names):
        found = F.lit(True)
        for c in names:
            found &= F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}"))
        return found

    earlier = W.partitionBy(*key).orderBy("mix_slot").rowsBetween(W.unboundedPreceding, -1)
    slots = keyed.where("mix_id is null").groupBy(*key, "mix_slot").agg(F.count("*").alias("mix_n")).withColumn(
        "mix_before", F.coalesce(F.sum("mix_n").over(earlier), F.lit(0))).alias("d")
    unnamed = slots.join(plan.where("mix_id is null").alias("p"), same(key[1:])).select(
        *[F.col(f"d.{c}") for c in (*key, "mix_slot")], "mix_base",
        F.least(F.greatest(F.col("mix_extra") - F.col("mix_before"), F.lit(0)), F.col("mix_n")).alias("mix_extra"))
    plan = plan.where("mix_id is not null").withColumn("mix_slot", F.lit(0)).unionByName(unnamed).alias("p")
    placed = keyed.withColumn("mix_place", F.row_number().over(W.partitionBy(*key, "mix_slot").orderBy("mix_draw"))).alias("d")
    copies = F.when(F.col("d.mix_size") == 0, 1).otherwise(F.col("mix_base") + F.when(F.col("mix_place") <= F.col("mix_extra"), 1).otherwise(0))
    columns = [F.col(f"d.`{c}`") for c in docs.columns if c != "copies"]
    return placed.join(plan, same([*key, "mix_slot"])).select(*columns, copies.cast("int").alias("copies")).where("copies > 0")
