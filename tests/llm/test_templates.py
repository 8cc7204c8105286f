"""Template windows in batches, numbers in other shapes, and windows that most texts hold."""

import random

import numpy as np

from gleaner.llm import template_decontam as td


def found(spark, docs, items, **options):
    frame = lambda rows, i: spark.createDataFrame(rows, f"{i} long, text string").repartition(3)
    return sorted((r["doc_id"], r["item_id"], r["changed_slots"]) for r in td.leaks(frame(docs, "doc_id"), frame(items, "item_id"), **options).collect())


def test_windows_of_a_batch_are_those_of_its_texts():
    rng = random.Random(4)
    pool = ["Ann", "Bo", "NASA", "met", "the", "old", "fox.", "12", "7kg", "kg", "seven", "--", "a", "Then", "went", "home,", "3.5km", "Lee!"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 6, 15, 40]))) for _ in range(300)]
    tokens, sizes = td.Tokens(), (5, 3)
    together, alone = [], []
    for most in (1 << 20, 50):
        rows = []
        for places, words, bounds, windows in td._batches(texts, tokens, sizes, most):
            for reading, hashed, first, kind in windows:
                at = np.flatnonzero(hashed)
                owner = np.searchsorted(bounds, first[at], "right") - 1
                rows += [(places[o], reading, int(hashed[a]), int(first[a] - bounds[o])) for a, o in zip(at, owner)]
        together.append(sorted(rows))
    for k, text in enumerate(texts):
        words, codes = td.words_of(text, tokens)
        if len(codes):
            for reading, hashed, first, kind in td.windows(codes, np.array([0, len(codes)]), sizes, len(codes) < 5):
                alone += [(k, reading, int(hashed[a]), int(first[a])) for a in np.flatnonzero(hashed)]
    assert together[0] == together[1] == sorted(alone)


def test_numbers_in_words_or_joined_with_units_and_names_in_capitals(spark):
    item = "yesterday {} bought {} of white rice and {} more of it for the long trip over the hills"
    fill = lambda *slots: item.format(*slots)
    docs = [(1, fill("Omar", "twelve kg", "seven kg")), (2, fill("Sarah", "18kg", "7kg")), (3, fill("NASA", "15 kg", "3 kg")), (4, fill("Mia", "twenty-one kg", "4kg")),
            (5, fill("Sarah", "some kg", "few kg").replace("white rice", "old bread").replace("long trip", "short walk"))]
    assert [(d, i) for d, i, _ in found(spark, docs, [(1, fill("Sarah", "15 kg", "3 kg"))])] == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert [(d, i) for d, i, _ in found(spark, docs[:4], [(1, fill("ESA", "nine kg", "2kg"))])] == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_a_window_of_most_items_and_documents_brings_no_pairs_together(spark):
    head = "please answer the following short question about the passage above in one word"
    own = lambda k: " ".join(f"q{chr(97 + k // 26)}{chr(97 + k % 26)}{j}x" for j in range(8))
    items = [(k, f"{head} {own(k)}") for k in range(120)]
    docs = [(k, f"{head} nothing else here but plain filler words number {own(500 + k % 100)}") for k in range(400)] + [(1000 + k, f"so {head} {own(k)} end") for k in range(0, 120, 7)]
    assert found(spark, docs, items) == [(1000 + k, k, 0) for k in range(0, 120, 7)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    asked = td._windows(frame(items), (5,), None).withColumnsRenamed({"id": "item_id", "at": "item_at", "slots": "item_slots"})
    seen = td._windows(frame(docs), (5,), td.Screen(asked.select("hash"))).withColumnRenamed("id", "doc_id")
    sizes = asked.groupBy("item_id").agg(td.F.count_distinct("unit").alias("n_windows"))
    assert td._candidates(seen, asked, sizes, 0.8).count() < 100
