"""Near-duplicate texts against the plain greedy rule."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import similarity


def greedy(rows, overlap=0.55):
    """rows: (id, text, score); walked through from the best down, as the rule is stated."""
    kept, out = [], []
    for i, text, score in sorted(rows, key=lambda r: (-(r[2] if r[2] is not None else float("-inf")), r[0])):
        words = frozenset((text or "").lower().split())
        repeats = any(words and k and len(words & k) > overlap * max(len(words), len(k)) for k in kept)
        if not repeats:
            kept.append(words)
        out.append((i, len(words), not repeats))
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double").selectExpr("*", "1 as node", "2 as best", "3 as n").repartition(4)
    return sorted((r["doc_id"], r["n_words"], r["kept"]) for r in similarity.near_duplicates(frame, score="score", **options).collect())


def corpus(seed, n):
    """Families of texts that differ in some words, copies, and texts that share a passage only."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    passage = [f"common{i}" for i in range(12)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 and rows:
            words = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randrange(0, max(len(words) // 2, 1))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.75:
            words = passage + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
        rng.shuffle(words)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.3 else w for w in words), rng.choice([None, 1.0, 2.0, 3.5])))
    return rows


@pytest.mark.parametrize("seed, lead", [(1, 64), (2, 1), (3, 3)])
def test_same_as_the_greedy_rule(spark, seed, lead):
    """With a small lead most words are common, so texts are decided over several rounds."""
    rows = corpus(seed, 220)
    assert found(spark, rows, lead=lead) == greedy(rows)


def test_chain_of_texts_like_the_next_only(spark):
    """Each text is like its neighbours, so every second one stays, one round after the other."""
    rows = [(k, " ".join(f"c{j}" for j in range(12 * k, 12 * k + 40)), float(-k)) for k in range(9)]
    assert found(spark, rows) == greedy(rows)
    assert [kept for _, _, kept in found(spark, rows)] == [True, False] * 4 + [True]


def test_odd_texts(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, " \t\n ", None), (4, "Same same", 1.0), (5, "same", 1.0), (6, "SAME", 9.0), (7, "a b", 1.0), (8, "b a c", 1.0)]
    assert found(spark, rows) == [(1, 0, True), (2, 0, True), (3, 0, True), (4, 1, False), (5, 1, False), (6, 1, True), (7, 2, True), (8, 3, False)]
    assert similarity.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_passage_in_a_third_of_all_texts_is_not_compared_pair_by_pair(spark):
    """Candidates grow with the lead and not with the square of the texts, and no task gets all texts of a word."""
    rows = [(i, " ".join([f"p{j}" for j in range(20)] + [f"own{i}_{j}" for j in range(5)]) if i % 3 == 0 else f"other{i} text{i}", float(i % 7)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double")
    nodes = frame.select(F.unhex(F.md5("text")).alias("node"), F.struct("score", "doc_id").alias("best"),
                         F.transform(similarity.distinct_words(F.col("text")), lambda w: F.xxhash64(w)).alias("tokens"))
    prefixes = similarity._prefixes(nodes, 55)
    place = F.row_number().over(similarity.Window.partitionBy("token").orderBy("best"))
    probes = prefixes.withColumn("place", place).where("place <= 8")
    assert similarity._candidates(probes, prefixes, 55).count() <= 8 * 20 * 1000
    assert "WindowGroupLimit" in probes._jdf.queryExecution().toString()
    assert found(spark, rows, lead=8) == greedy(rows)


def test_whole_sets_are_joined_to_promising_pairs_only(spark):
    """Texts of one small vocabulary are all candidates of each other; signatures refuse most of them and none that is linked."""
    rng = random.Random(5)
    sets = [rng.sample(range(3000), rng.randrange(100, 400)) for _ in range(60)] + [rng.sample(range(3000), 3) for _ in range(20)]
    sets += [rng.sample(s, len(s) * 9 // 10) for s in sets[:30]]
    rows = [(i, [hash((w, "word")) for w in s]) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, tokens array<long>").withColumn("bits", similarity._signature("tokens"))
    pairs = spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))], "better long, worse long")
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len({*sets[i]} & {*sets[j]}) > 55 * max(len(sets[i]), len(sets[j]))}
    promising = {(r[0], r[1]) for r in similarity._promising(pairs, nodes.select("node", F.size("tokens").alias("n"), "bits"), 55).collect()}
    assert linked <= promising and len(promising) < len(linked) + 600
    assert {(r[0], r[1]) for r in similarity._links(pairs, nodes, 55).collect()} == linked


def test_blocks_meet_without_a_shuffle_of_pairs_or_sets(spark, monkeypatch):
    """Many small blocks give the links of the plain form, and neither pairs nor sets are dealt out by a key."""
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", 16)
    monkeypatch.setattr(similarity, "BLOCK_WORDS", 300)
    rows = corpus(4, 150)
    assert found(spark, rows, lead=2) == greedy(rows)
    nodes = spark.createDataFrame(rows, "doc_id long, text string, score double").select(
        F.col("doc_id").alias("node"), F.col("doc_id").alias("best"), F.transform(similarity.distinct_words(F.col("text")), lambda w: F.xxhash64(w)).alias("tokens")) \
        .withColumn("bits", similarity._signature("tokens")).localCheckpoint()
    wanted = similarity._field(nodes, 150)
    blocks = similarity.materialise(similarity._packed(nodes, spark.sparkContext.broadcast(similarity._rarity(nodes)), 55, wanted), "blocks")
    assert blocks.count() > 9
    linked = similarity._pairs(blocks, blocks, F.col("one_block") <= F.col("two_block"), 55, (wanted, wanted))
    assert "hashpartitioning" not in linked._jdf.queryExecution().executedPlan().toString()
    prefixes = similarity._prefixes(nodes, 55)
    plain = {(r[0], r[1]) for r in similarity._links(similarity._candidates(prefixes, prefixes, 55), nodes, 55).collect()}
    assert plain and {tuple(sorted(r)) for r in linked.collect()} == plain


def test_hits_of_common_words_are_taken_piece_by_piece(monkeypatch):
    rng = random.Random(9)
    sets = [similarity.np.array(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(70)]
    rarity = type("Sent", (), {"value": similarity.np.bincount(similarity.np.concatenate(sets), minlength=similarity.COUNTERS)})
    made = {}

    class Sets:
        def select(self, *_):
            return self

        def mapInPandas(self, f, _):
            made["row"] = next(iter(f([similarity.pd.DataFrame({"node": range(70), "tokens": sets})]))).to_dict("records")[0]

    similarity._packed(Sets(), rarity, 55, type("Sent", (), {"value": b"\xff" * 9}))
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if 100 * len({*sets[i]} & {*sets[j]}) > 55 * max(len(sets[i]), len(sets[j]))}
    for hits in (1, 7, 1_000_000):
        monkeypatch.setattr(similarity, "HITS", hits)
        block = similarity._Block(made["row"], 55, b"\xff" * 9)
        assert {*zip(*(x.tolist() for x in similarity._linked(block, block, 55)))} == want
    # Texts that are gone take no part.
    block = similarity._Block(made["row"], 55, b"\x0f" + bytes(8))
    assert {*zip(*(x.tolist() for x in similarity._linked(block, block, 55)))} == {(i, j) for i, j in want if j < 4}
