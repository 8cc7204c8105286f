"""Text operators, readers, matching and ranking on small inputs, against plain Python."""

import random
import re
import time
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import labels
from gleaner.functions import text as text_functions
from gleaner.operators import documents, fusion, joined, keywords, matching, ranking, summaries
from gleaner.plans.links import global_ranking, link_findings
from gleaner.plans.tables import analyse_table
from gleaner.plans.texts import analyse_corpus, analyse_documents
from gleaner.sources import files


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_compaction_and_sentences(spark):
    raw = "  First one.\r\n\r\n\r\n\r\nSecond one! ... 3.14 stays?  Yes  "
    t = F.col("t")
    found = one(spark, raw, text_functions.compact_text(t), text_functions.sentence_split(t))
    assert found[0] == "First one.\n\nSecond one! ... 3.14 stays?  Yes"
    assert found[1] == ["First one.", "Second one!", "3.14 stays?", "Yes"]
    assert one(spark, None, text_functions.compact_text(t))[0] == ""


def plain_chunks(sentences, size):
    chunks, current, length = [], [], 0
    for s in sentences:
        if current and length + len(s) > size:
            chunks.append(current)
            current, length = [], 0
        current.append(s)
        length += len(s)
    return chunks + ([current] if current else [])


def test_packing_keeps_every_sentence(spark):
    sentences = ["ab" * (i * 7 % 23 + 1) + "." for i in range(80)]
    df = spark.createDataFrame([(sentences,), ([],)], "s array<string>").select(text_functions.pack_sentences(F.col("s"), 60).alias("p"))
    packed = [r["p"] for r in df.collect()]
    assert packed[0] == plain_chunks(sentences, 60) and packed[1] == []
    text = " ".join(sentences)
    counted = one(spark, text, text_functions.chunk_count(F.col("t"), 60), text_functions.chunk_text(F.col("t"), 60))
    assert counted[0] == len(packed[0]) and counted[1] == [" ".join(c) for c in packed[0]]
    assert one(spark, "... !!!", text_functions.chunk_text(F.col("t"), 60))[0] == ["... !!!"]


def test_keyword_tokens_follow_word_boundaries(spark):
    raw = "Don't café abc- x-ray état l'eau re-entry ab1 abc_d 'quoted' the naive- end-"
    pattern = re.compile(r"(?u)\b[a-z][a-z\-']{2,}\b")
    found = one(spark, raw, text_functions.keyword_tokens(F.col("t"), ["the"]))[0]
    assert found == [w for w in pattern.findall(raw.lower()) if w != "the"]


@pytest.mark.parametrize("value,shown", [(None, "N/A"), (1234567.0, "1.2M"), (2_500.0, "2.5K"), (-2_500.0, "-2.5K"), (999.0, "999"),
                                         (0.125, "0.1"), (1.25, "1.2"), (1234567890.0, "1234.6M")])
def test_format_metric(spark, value, shown):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(labels.format_metric(F.col("v"))).first()[0] == shown


def test_labels(spark):
    t = F.col("t")
    assert one(spark, "unit_2x Price-EUR", labels.humanize_label(t))[0] == "Unit 2X Price Eur" == labels.column_label("unit_2x Price-EUR")
    assert one(spark, "***", labels.humanize_label(t))[0] == "***" == labels.column_label("***")


def test_text_direction(spark):
    texts = ["Sales increased.", "Sales fall.", "Up and down.", "Nothing."]
    df = spark.createDataFrame([([t],) for t in texts], "s array<string>")
    assert [r[0] for r in df.select(labels.text_direction(F.col("s"))).collect()] == ["rising", "falling", None, None]


def test_repeated_sentences_tie_to_the_earlier():
    sentences = ["alpha beta gamma delta", "alpha beta gamma delta", "alpha beta gamma delta", "other words stand here"]
    assert summaries.best_positions(sentences, 2) == [0, 1]
    assert summaries.best_positions(["one"], 2) == [0]
    ranks = summaries.sentence_ranks(["1 2 3", "4 5"])
    assert np.isfinite(ranks).all()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [a + b for a in ("sal", "cost", "ret", "pric", "mark") for b in ("es", "ing", "urn", "et", "ion")]
    return " ".join(" ".join(rng.choice(vocabulary, 12)).capitalize() + "." for _ in range(n))


def test_long_documents_are_summarised_whole(spark):
    df = spark.createDataFrame([(1, prose(900, 1)), (2, prose(10, 2)), (3, "tiny"), (4, prose(16_000, 4))], "id int, text string")
    found = {r["id"]: r for r in summaries.document_summary(df, "id", "text", 4).collect()}
    assert set(found) == {1, 2, 4}
    assert found[4]["chunks"] > 300 and len(re.findall(r"\.", found[4]["summary"])) == 4
    assert found[1]["chunks"] > 12 and len(re.findall(r"\.", found[1]["summary"])) == 4
    assert found[2]["chunks"] == 1 and len(re.findall(r"\.", found[2]["summary"])) == 2
    # Picks keep text order.
    body = df.where("id = 1").first()["text"]
    places = [body.index(s) for s in re.split(r"(?<=\.) ", found[1]["summary"])]
    assert places == sorted(places)


def test_corpus_summary_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, prose(12, i)) for i in range(80)], "id int, text string")
    found = {summaries.corpus_summary(df.repartition(n), "id", "text", 4, fan_in=6).first()["summary"] for n in (1, 6)}
    assert len(found) == 1 and len(re.findall(r"\.", found.pop())) == 4


def test_importance_is_relative_to_the_best(spark):
    df = spark.createDataFrame([(1, prose(30, 5)), (2, "word")], "id int, text string")
    found = keywords.tfidf_keywords(df, "id", "text", 10)
    best = found.where("id = 1 and rank = 1").first()
    assert best["importance"] == 1.0 and found.where("importance <= 0 or importance > 1").count() == 0
    assert [r["term"] for r in found.where("id = 2").collect()] == ["word"]


def test_prepared_documents_give_the_same(spark):
    df = spark.createDataFrame([(i, prose(20, i) + " Mail a@b.org on 2024-01-02 to Ada Lovelace.") for i in range(6)], "id int, text string")
    ready = documents.prepare_documents(df, "id", "text")
    for operator in (documents.text_stats, documents.sentence_table, keywords.tfidf_keywords, summaries.document_summary):
        assert sorted(map(tuple, operator(df, "id", "text").collect())) == sorted(map(tuple, operator(ready, "id", "text").collect()))


def test_custom_entity_extractor(spark):
    df = spark.createDataFrame([(1, "x y x")], "id int, text string")
    words = lambda t: F.transform(F.split(t, " "), lambda w: F.struct(F.concat(w, w).alias("text"), F.lit("W").alias("label")))
    found = documents.entity_counts(df, [], "text", extractor=words).orderBy("rank").collect()
    assert [(r["text"], r["count"]) for r in found] == [("xx", 2), ("yy", 1)]


def brute_match(term, columns):
    best = (None, -1.0)
    for c in columns:
        a, b = labels.column_key(term), labels.column_key(c)
        ta, tb = set(a.split()), set(b.split())
        score = 0.0
        if ta and tb:
            score = max(len(ta & tb) / max(len(ta), len(tb)), SequenceMatcher(None, a, b).ratio())
        if score > best[1]:
            best = (c, score)
    return best if best[1] >= 0.45 else None


def test_lexical_matches_equal_brute_force(spark):
    columns = ["unit_price", "Units Sold", "region", "order date", "returns", "***"]
    terms = ["price", "unit price", "sold units", "regional", "dates ordered", "return rate", "zebra", "", "ret-urns", "return rate"]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    found = {r["term"]: (r["column"], pytest.approx(r["score"])) for r in matching.lexical_matches(df, columns).collect()}
    assert found == {t: m for t in set(terms) if (m := brute_match(t, columns))}


def test_cosine_blocks_agree(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(30, 5))
    terms = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(99, [0.0] * 5)], "term int, vector array<double>")
    names = spark.createDataFrame([(i, f"c{i}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(11, 5)))],
                                  "position int, column string, vector array<double>")
    whole = sorted((r["term"], r["column"], round(r["score"], 9)) for r in matching.cosine_matches(terms, names, 0.3).collect())
    split = sorted((r["term"], r["column"], round(r["score"], 9)) for r in matching.cosine_matches(terms, names, 0.3, block=4).collect())
    assert whole == split and whole and 99 not in {t for t, _, _ in whole}


def shared_words(a, b):
    a, b = {w for w in a.lower().split(" ") if w}, {w for w in b.lower().split(" ") if w}
    return sum(w in b for w in a) / max(len(a), len(b), 1)


def brute_rank(insights, limit):
    top = max(i["score"] for i in insights) or 1.0
    ordered = sorted(insights, key=lambda i: (-round(i["score"] / top, 4), i["ordinal"]))
    kept = []
    for i in ordered:
        if len(kept) == limit:
            break
        if not any(SequenceMatcher(None, i["title"].lower(), k["title"].lower()).ratio() >= 0.72
                   and shared_words(i["description"], k["description"]) > 0.55 for k in kept):
            kept.append(i)
    return [k["ordinal"] for k in kept]


def insight_frame(spark, insights):
    data = [(i["ordinal"], i["title"], i["description"], i["score"], [str(i["ordinal"])], "data") for i in insights]
    return spark.createDataFrame(data, "ordinal long, title string, description string, score double, evidence array<string>, source string")


@pytest.mark.parametrize("seed", range(4))
def test_ranking_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    words = ["sales", "cost", "returns", "price", "trend", "leader", "north", "south"]
    insights = [
        {"ordinal": i, "title": " ".join(rng.choice(words, 2)), "description": " ".join(rng.choice(words, 6)), "score": float(rng.integers(1, 9)) / 10}
        for i in range(60)]
    insights += [dict(i, ordinal=100 + i["ordinal"]) for i in insights[:10]]
    found = ranking.rank_insights(insight_frame(spark, insights), [], 12).orderBy("rank").collect()
    assert [int(r["evidence"][0]) for r in found] == brute_rank(insights, 12)
    again = [{"ordinal": r["rank"], "title": r["title"], "description": r["description"], "score": r["score"]} for r in found]
    assert brute_rank(again, 12) == [r["rank"] for r in found]


def test_records(spark):
    frame = insight_frame(spark, [{"ordinal": 1, "title": "a", "description": "x", "score": 0.5}, {"ordinal": 2, "title": "b", "description": "y", "score": 0.4}])
    found = ranking.insight_records(ranking.rank_insights(frame, [])).orderBy("rank").collect()
    assert [(r["priority"], r["band"], r["raw_score"], r["text"]) for r in found] == [(100, "high", 0.5, "x"), (80, "medium", 0.4, "y")]


def fusion_inputs(spark):
    terms = spark.createDataFrame([(1, "unit price", 1.0), (2, "stock", 0.5), (3, "faults", 0.4), (4, "plain", 0.4), (5, "unit price", 0.4)],
                                  "ordinal int, term string, importance double")
    matches = spark.createDataFrame([("unit price", "unit_price", 0.9), ("stock", "stock", 1.0), ("faults", "faults", 1.0), ("plain", "plain", 1.0)],
                                    "term string, column string, score double").withColumn("match_method", F.lit("difflib"))
    contexts = spark.createDataFrame([("unit price", 1, "Prices fall again.")], "term string, mention int, sentence string")
    stats = spark.createDataFrame([("unit_price", 10.0, 1.0, 20.0, 2.0), ("stock", 1.0, 0.0, 2.0, -1.5), ("faults", 1.0, 0.0, 2.0, 0.1), ("plain", 1.0, 0.0, 2.0, 0.1)],
                                  "column string, mean double, min double, max double, skew double")
    trends = spark.createDataFrame([(0, "unit_price", "falling", -4.0, "day"), (1, "unit_price", "rising", 50.0, "month")],
                                   "date_ordinal int, metric string, direction string, pct_change double, frequency string")
    flags = spark.createDataFrame([("column", "faults", 30)], "scope string, name string, count long")
    return terms, matches, contexts, stats, trends, flags


def test_fusion_cases(spark):
    terms, matches, contexts, stats, trends, flags = fusion_inputs(spark)
    found = {r["ordinal"]: r for r in fusion.fusion_signals(terms, matches, contexts, stats, trends, flags, []).collect()}
    assert {k: r["case"] for k, r in found.items()} == {1: "trend", 2: "skew", 3: "anomaly"}
    # The later of two date columns gives the trend; the text says the opposite.
    assert "contradicts" in found[1]["description"] and "across month periods" in found[1]["description"]
    assert found[1]["score"] == pytest.approx(min(0.99, 0.65 + 0.15 + 0.09 + 0.1))
    assert found[2]["score"] == pytest.approx(0.55 + 0.075 + 0.075) and "left-skewed" in found[2]["description"]
    assert found[3]["score"] == pytest.approx(min(0.88, 0.60 + 0.06 + 0.20))
    listed = fusion.match_list(terms, matches, []).orderBy("rank").collect()
    assert [r["term"] for r in listed] == ["unit price", "stock", "faults", "plain"]


def test_whole_analysis(spark):
    table = spark.createDataFrame([(i, f"2024-{i % 12 + 1:02d}-01", float(i ** 2), "north" if i % 3 else "south") for i in range(60)],
                                  "id int, day string, sales double, region string")
    docs = spark.createDataFrame([(1, "The sales in the north region increased strongly this year. " + prose(30, 1)), (2, prose(20, 2))], "id int, text string")
    data, text = analyse_table(table, ["id"]), analyse_corpus(docs, "id", "text")
    links = link_findings(data, text)
    final = global_ranking([data.ranked, text.ranked, links.ranked]).orderBy("rank").collect()
    assert data.roles.datetime == ["day"] and [r["rank"] for r in final] == list(range(1, len(final) + 1))
    assert final[0]["score"] == 1.0 and {r["source"] for r in final} >= {"data", "text"}
    words_only = analyse_table(table, ["id"], columns=["region"])
    assert link_findings(words_only, text).ranked.count() == 0
    each = analyse_documents(docs, "id", "text")
    assert each.ranked.where("title = 'Document Summary'").count() == 2


def test_csv_files_differ_in_encoding_and_header(spark, tmp_path):
    folder = tmp_path / "mixed folder"
    folder.mkdir()
    (folder / "a 1.csv").write_bytes("\ufeffid,name\n1,caf\u00e9\n".encode())
    (folder / "b%.csv").write_bytes("\nname,id\r\nth\u00e9,2\r\n".encode())
    (folder / "c.csv").write_bytes("id,name,more\n3,na\u00efve,x\n".encode("latin-1"))
    (folder / "d.csv").write_bytes(b"")
    df = files.scan_csv(spark, str(folder))
    assert df.columns == ["id", "name", "more"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "caf\u00e9", None), (2, "th\u00e9", None), (3, "na\u00efve", "x")]


def test_csv_latin1_marks_and_missing(spark, tmp_path):
    plain = tmp_path / "plain.csv"
    plain.write_bytes("﻿date,reg,v,w,k\n2024-01-01,A,1,inf,1\n2024-01-02,NA,2.5,,2\n2024-01-03,\"x, \"\"y\"\"\",n/a,3,3\n".encode("utf-8"))
    df = files.scan_csv(spark, str(plain))
    assert df.dtypes == [("date", "string"), ("reg", "string"), ("v", "double"), ("w", "double"), ("k", "bigint")]
    assert [tuple(r)[1:] for r in df.orderBy("k").collect()] == [("A", 1.0, float("inf"), 1), (None, 2.5, None, 2), ('x, "y"', None, 3.0, 3)]
    latin = tmp_path / "latin.csv"
    latin.write_bytes("name,n\ncafé,1\n".encode("latin-1"))
    assert [tuple(r) for r in files.scan_csv(spark, str(latin)).collect()] == [("café", 1)]


def test_texts_and_inventory(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿café\r\n".encode("utf-8"))
    (tmp_path / "b.TXT").write_bytes("café".encode("latin-1"))
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.scan_texts(spark, str(tmp_path)).collect()}
    assert texts == {"a.txt": "café", "b.TXT": "café"}
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "d.csv").write_bytes(b"")
    found = {r["file"]: (r["kind"], r["error"]) for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert found["b.TXT"] == ("txt", None) and found["c.bin"][0] == "unknown" and "Unsupported" in found["c.bin"][1]
    assert "empty" in found["d.csv"][1]
    assert "limit" in files.file_inventory(spark, str(tmp_path), 0).where("file = 'a.txt'").first()["error"]
    report = files.load_report(files.file_inventory(spark, str(tmp_path)), {"a.txt": spark.range(3)})
    assert {r["file"]: r["rows"] for r in report.collect()}["a.txt"] == 3


def test_folder_report(spark, tmp_path):
    """Files of all kinds, in folders and with odd names, each format read once."""
    (tmp_path / "deep er").mkdir()
    (tmp_path / "deep er" / "ta+ble %41.CSV").write_bytes(b'\xef\xbb\xbfa,"b, ""c""",d\r\n1,"x,y",\r\n\r\nNA,,\r\n2,3,4\r\n')
    (tmp_path / "holes.csv").write_text("a,b\nNA,\n,null\n")
    (tmp_path / "head.csv").write_text("a,b\n")
    (tmp_path / "t.TXT").write_bytes(" caf\u00e9 \r\n\r\n\r\n\r\nx".encode("latin-1"))
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "none.txt").write_text("")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "y").write_bytes(b"?")
    found = {r["file"]: (r["kind"], r["rows"], r["columns"], r["characters"], (r["error"] or "ok").split()[1:2]) for r in files.folder_report(spark, str(tmp_path)).collect()}
    assert found == {
        "ta+ble %41.CSV": ("csv", 3, 3, None, []), "holes.csv": ("csv", 2, 2, None, ["CSV"]), "head.csv": ("csv", 0, 2, None, ["CSV"]), "t.TXT": ("txt", None, None, 8, []),
        "blank.txt": ("txt", None, None, 0, ["text"]), "none.txt": ("txt", None, None, None, ["uploaded"]), "x.pdf": ("pdf", None, None, None, []),
        "y": ("unknown", None, None, None, ["file"])}


def test_missing_cells_and_long_numbers_with_gaps(spark):
    cells = spark.createDataFrame([(" NA ", "1234567890123456789", "7"), ("NA", None, None), ("x", "1234567890123456788", "8")], "a string, b string, c string")
    typed = files.infer_types(cells)
    assert typed.dtypes == [("a", "string"), ("b", "bigint"), ("c", "double")]
    assert [tuple(r) for r in typed.collect()] == [(" NA ", 1234567890123456789, 7.0), (None, None, None), ("x", 1234567890123456788, 8.0)]


def test_union_of_like_tables(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, "y")], "k int, b string")
    assert sorted(map(tuple, files.union_tables([a, b]).collect())) == [(1, "x", None), (2, None, "y")]


@pytest.mark.parametrize("chunks", [1, 12, 13, 24, 25])
def test_corpus_summary_has_the_wanted_sentences(spark, chunks):
    """The number of sentences does not depend on how many parts a body has."""
    rng = np.random.default_rng(chunks)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(200)]
    rows = [(i, " ".join(" ".join(rng.choice(words, 12)).capitalize() + "." for _ in range(30))) for i in range(chunks)]
    found = summaries.corpus_summary(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").first()["summary"]
    assert len([s for s in found.split(".") if s.strip()]) == (2 if chunks == 1 else 4)


def dense_ranks(sentences):
    """The ranks by the whole matrix."""
    bags = [Counter(summaries.WORD.findall(s.lower())) for s in sentences]
    index = {w: i for i, w in enumerate(dict.fromkeys(w for bag in bags for w in bag))}
    counts = np.zeros((len(bags), max(len(index), 1)))
    for i, bag in enumerate(bags):
        for w, n in bag.items():
            counts[i, index[w]] = n
    logs = np.log(np.maximum(counts.sum(axis=1), 1.0))
    scale = logs[:, None] + logs[None, :]
    shared = counts @ counts.T
    edges = np.where(np.isclose(scale, 0.0), shared, shared / np.where(scale == 0, 1, scale))
    step = 0.15 / len(bags) + 0.85 * edges / (edges.sum(axis=1, keepdims=True) + 1e-7)
    ranks, moved = np.full(len(bags), 1.0 / len(bags)), 1.0
    while moved > 1e-4:
        ranks, before = step.T @ ranks, ranks
        moved = np.linalg.norm(ranks - before)
    return ranks


@pytest.mark.parametrize("n, cells", [(1, 10), (7, 10), (60, 4_000_000), (400, 4_000_000), (400, 2)])
def test_ranks_without_the_matrix(monkeypatch, n, cells):
    rng = random.Random(n)
    sentences = [" ".join(rng.choice(["a", "sun", "moon", "tree", f"w{rng.randrange(40)}", f"x{i}", "12"]) for _ in range(rng.choice([0, 1, 1, 4, 9, 25]))) for i in range(n)]
    graph = summaries.SentenceGraph
    monkeypatch.setattr(summaries, "SentenceGraph", lambda s: (g := graph(s), setattr(g, "block", max(1, cells // max(len(g.row), 1))))[0])
    assert summaries.sentence_ranks(sentences) == pytest.approx(dense_ranks(sentences), abs=1e-12)


def test_long_documents_are_summarised_in_the_same_two_steps(spark):
    """Ninety chunks, far more than are ever condensed at once elsewhere, and 40,000 sentences in one ranking."""
    rng = random.Random(3)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    body = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6, 14))).capitalize() + "." for _ in range(6000)]
    found = summaries.document_summary(spark.createDataFrame([(1, " ".join(body))], "id int, text string"), "id", "text").first()
    chunks, picks = [], []
    for s in body:
        if chunks and sum(map(len, chunks[-1])) + len(s) <= 4500:
            chunks[-1].append(s)
        else:
            chunks.append([s])
    best = lambda some, k: [some[i] for i in sorted(np.lexsort((np.arange(len(some)), -np.round(dense_ranks(some), 9)))[:k])]
    for c in chunks:
        picks += best(c, 2)
    assert found["chunks"] == len(chunks) == 90 and found["summary"] == " ".join(best(picks, 4))
    assert len(summaries.sentence_ranks(body * 7)) == 42_000


def test_keywords_are_counted_in_tasks_of_bounded_texts(spark, monkeypatch):
    # One task for each TASK_CHARS characters, whatever the session's shuffle partitions are.
    docs = spark.createDataFrame([(i, f"Harbour cranes number {i} lift many heavy boxes. Old ships wait outside in long rows.") for i in range(64)], "doc_id long, text string")
    monkeypatch.setattr(keywords, "TASK_CHARS", 100, raising=False)
    for source in (docs, documents.prepare_documents(docs, "doc_id", "text")):
        assert keywords._passages(source, "doc_id", "text", F.size("clean") < 2).rdd.getNumPartitions() >= 40
    assert keywords.tfidf_keywords(docs, "doc_id", "text").where("rank = 1").count() == 64


def test_a_usual_chunk_is_ranked_by_a_matrix_as_without_one(spark, monkeypatch):
    rng = random.Random(3)
    sentences = [" ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + rng.choice(["", "x", "-y'z"]) for _ in range(rng.randrange(1, 25))) for _ in range(40)]
    small = summaries.sentence_ranks(sentences)
    assert summaries.SentenceGraph(sentences).matrix is not None
    monkeypatch.setattr(summaries, "SMALL", 0)
    assert summaries.SentenceGraph(sentences).matrix is None
    assert np.allclose(small, summaries.sentence_ranks(sentences), atol=1e-12)


def test_corpus_statistics_split_texts_once(spark):
    docs = spark.createDataFrame([(i, f"Text number {i} says   little.\nIt goes on") for i in range(20)], "doc_id long, text string")
    # What range bounds are drawn from is already split and written.
    assert "split(" not in joined._parts(docs, "doc_id", "text", 50)._jdf.queryExecution().optimizedPlan().toString()
    assert joined.corpus_stats(docs, "doc_id", "text").first()["word_count"] == 160


def test_terms_of_a_passage_are_not_compared_pair_by_pair_where_none_repeats(spark):
    letters = "bcdfghjklm"
    word = lambda i: "".join(letters[int(d)] for d in f"{i:06d}")
    passages = spark.createDataFrame([(1, [" ".join(map(word, range(20_000)))]), (2, ["blue ship blue ship sails"])], "doc_id long, passages array<string>")
    began = time.time()
    found = {r["doc_id"]: dict(r["terms"]) for r in keywords._passage_terms(passages, "doc_id", []).collect()}
    assert time.time() - began < 20
    assert len(found[1]) == 39_999 and set(found[1].values()) == {1}
    assert found[2] == {"blue": 2, "ship": 2, "sails": 1, "blue ship": 2, "ship blue": 1, "ship sails": 1}


@pytest.mark.parametrize("text", ["one two three four", "one two three four five", " one two three four", "one  two\t\nthree four five ", "1 2 3 4 5 6", "", None, "   a b c"])
def test_prose_needs_as_many_words_as_pieces(spark, text):
    t = F.col("t")
    pieces = F.size(F.split(t, f"{text_functions.SPACE}+"))
    letters = F.length(F.regexp_replace(t, r"\P{L}+", "")) / F.greatest(F.length(t), F.lit(1))
    found = one(spark, text, text_functions.is_prose(t), (t != "") & (pieces >= 5) & (letters >= 0.6))
    assert bool(found[0]) == bool(found[1])


def test_prepared_documents_write_each_text_once(spark):
    docs = spark.createDataFrame([(1, "Four words are here. Here are many more words than four! 1 2 3 4 5 6 7.\n\n\n\nAnd so it goes on. "), (2, ""), (3, None)], "doc_id long, text string")
    ready = documents.prepare_documents(docs, "doc_id", "text")
    written = spark.read.parquet(*ready.inputFiles())
    assert {t for _, t in written.dtypes} == {"bigint", "string", "array<boolean>"}
    plain = docs.select("doc_id", text_functions.compact_text(F.col("text")).alias("text"), text_functions.clean_sentences(F.col("text")).alias(documents.SENTENCES))
    assert sorted(map(tuple, ready.collect())) == sorted(map(tuple, plain.collect()))
    assert ready.where("doc_id = 1").first()[documents.SENTENCES] == ["Here are many more words than four!", "And so it goes on."]


def test_long_steps_of_an_analysis_are_queries_of_their_own(spark):
    """What reads all texts or runs Python is written before the last joins, and its shuffle files are gone by then."""
    shuffled = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    docs = spark.createDataFrame([(i, prose(12, i) + " The value is rising and the user id was higher for Ada Lovelace again.") for i in range(8)], "doc_id long, text string")
    events = spark.createDataFrame([(i, f"2024-01-{i % 28 + 1:02d}", float(i * i), i % 7) for i in range(60)], "event_id long, ts string, value double, user_id long")
    text = analyse_documents(docs, "doc_id", "text")
    links = link_findings(analyse_table(events, ["event_id"], forest=False), text)
    before = shuffled()
    frames = [text.insights, links.matches, links.signals]
    assert shuffled() <= before
    for frame in frames:
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan and "split(" not in plan
        assert frame.count() > 0
