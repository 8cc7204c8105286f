"""Ids, shingles and rows without an id that hold a third of all rows."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gleaner.llm import ordinal_quality, set_sketch, source_mix


def test_mix_keeps_the_same_rows_however_they_are_dealt(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(1 + i % 4)), "xy"[i % 2]) for i in range(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = lambda df, **o: sorted((tuple(r) for r in source_mix.with_copies(df, **o).collect()), key=repr)
    for options in ({}, {"share": 0.4}):
        once = kept(frame.repartition(2), **options)
        assert once == kept(frame.orderBy("text", "source").repartition(7, "text"), **options)
        planned = source_mix.mix(frame, **options).agg(F.sum("taken")).first()[0]
        assert sum(len(r[1].split()) * r[3] for r in once) == planned


def test_an_id_on_many_rows_is_rated_once(spark, monkeypatch):
    rows = [(1, f"scum fool {i}") for i in range(400)] + [(i, "sun moon tree") for i in range(2, 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    grades = spark.createDataFrame([(i, 0 if i == 1 else 2) for i in range(1, 60)], "doc_id long, grade int")
    seen = []
    regress = ordinal_quality.regress
    monkeypatch.setattr(ordinal_quality, "regress", lambda found, known, *a, **k: seen.append(len(known)) or regress(found, known, *a, **k))
    ordinal_quality.fit(frame, grades)
    assert seen == [59]


def test_large_shingle_groups_meet_by_cells(spark):
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = {i: np.unique(np.concatenate([rng.permutation(common)[:36], rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)])) for i in range(60)}
    bodies = spark.createDataFrame(pd.DataFrame({"id": list(sets), "n": [len(s) for s in sets.values()], "grams": [s.tobytes() for s in sets.values()]}))
    component = {i: 0 if i < 25 else i for i in sets}
    groups = spark.createDataFrame(list(component.items()), "id long, component long")
    pairs = lambda block: {tuple(r) for r in set_sketch._across(bodies, groups, 80, block).collect()}
    whole = pairs(4096)
    assert whole == pairs(3) == pairs(7)
    similar = {(i, j) for i in sets for j in sets if i < j and component[i] != component[j]
               and len(np.intersect1d(sets[i], sets[j])) * 100 >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert similar and similar <= whole
