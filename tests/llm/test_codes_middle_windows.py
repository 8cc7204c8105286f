"""Product codes, fill-in-the-middle and window repeats on small, difficult tables, against brute force in plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import fill_in_middle, product_codes, window_repeats
from tests.llm.conftest import BASE
from tests.llm.test_operators import plain, random_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def brute_codes(x: np.ndarray, parts=16, rounds=2):
    cut = x.reshape(len(x), parts, -1)
    books = [[list(map(int, v)) for v in cut[:64, p]] for p in range(parts)]
    near = lambda v, book: min((sum((int(a) - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            codes = [near(v, books[p])[1] for v in cut[:, p]]
            for k in set(codes):
                mine = [v for v, c in zip(cut[:, p], codes) if c == k]
                books[p][k] = [sum(map(int, column)) // len(mine) for column in zip(*mine)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return ["".join(f"{c:02x}" for _, c in f) for f in found], [sum(d for d, _ in f) for f in found], ",".join(str(c) for b in books for e in b for c in e)


@pytest.mark.parametrize("n, spread", [(300, 1.0), (40, 0.01), (150, 1000.0)])
def test_codes(spark, n, spread):
    """With ties and repeated vectors (a narrow spread), and with fewer vectors than entries."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 48)) * spread
    x[n // 2:n // 2 + 10] = x[3]
    labels = [None if i % 7 == 0 else 5 if i % 3 == 0 else i for i in range(n)]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels))]
    odd = [(900, None, 1), (901, [float("nan")] * 48, 1), (902, [1.0, None], None), (-5, [float("inf")] * 48, 2)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as code", "2 as error", "3 as n").repartition(5)
    codes, errors, books = brute_codes(np.floor(256 * x).astype(np.int64))
    total = {}
    for k, e in zip(labels, errors):
        total[k] = total.get(k, 0) + e
    found = {r["vec_id"]: tuple(r)[1:] for r in product_codes.digest_columns(frame).collect()}
    assert found == {i: (codes[i], errors[i], total[labels[i]], sha(books)) for i in range(n)}


def test_masks_hold_the_nearest_entry():
    rng = np.random.default_rng(1)
    for spread in (2, 50, 10_000):
        entries, x = rng.integers(-spread, spread, (64, 3)), rng.integers(-2 * spread, 2 * spread, (500, 3))
        code, distance = product_codes.Slices.of(entries).nearest(x)
        full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (distance == full.min(axis=1)).all() and (code == full.argmin(axis=1)).all()


def test_codes_of_odd_tables(spark):
    frame = spark.createDataFrame([(None, [0.5] * 5, None), (1, [], "a"), (1, [1e300, -1e300], "a"), (2, [0.25] * 20, "b")], "vec_id long, embedding array<double>, label string")
    found = product_codes.digest_columns(frame).collect()
    assert len(found) == 4 and all(len(r["code"]) == 32 and r["error"] == 0 for r in found)
    assert product_codes.digest_columns(frame.limit(0)).count() == 0


def test_common_labels_keep_their_sums(spark, monkeypatch):
    """Labels on both sides of the broadcast: one on a third of all rows, rare ones, and none."""
    monkeypatch.setattr(product_codes, "HEAVY", 10)
    codes = spark.range(300).selectExpr("id as vec_id", "case when id % 3 = 0 then null when id % 3 = 1 then -1 else id end as label", "id as error")
    found = {r["vec_id"]: r["label_error"] for r in product_codes.with_label_error(codes).collect()}
    assert found == {i: sum(range(i % 3, 300, 3)) if i % 3 < 2 else i for i in range(300)}


def brute_middle(i, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    digest, n = hashlib.sha256(f"7:{i}".encode()).hexdigest(), len(units)
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return i, n, "plain", None, None, sha(text or ""), sha(text or "")
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return i, n, form, len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("piece, batch", [(1 << 16, 4 << 20), (1, 100), (7, 500)])
def test_middle(spark, monkeypatch, piece, batch):
    """Small pieces split marks' neighbours, so the reader has to look over their bounds."""
    monkeypatch.setattr(fill_in_middle, "PIECE", piece)
    monkeypatch.setattr(fill_in_middle, "BATCH", batch)
    rng = random.Random(piece)
    parts = ["a", "<", "S>", "<S", "P>", "<M", ">", "é\U0001F600", "\n", "\n", "\r\n", "word ", "<<"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(150)] + [None, "", "\n", "x", "no\nmark <P> here", "y" * 300 + "\n" + "z" * 200]
    docs = [(k * 7 - 50, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in fill_in_middle.digest_columns(frame).collect()) == sorted(brute_middle(*d) for d in docs)


def test_middle_of_messy_tables(spark, messy, nothing):
    found = sorted((tuple(r) for r in fill_in_middle.digest_columns(messy).collect()), key=str)
    wanted = sorted((brute_middle("" if i is None else i, t)[1:] for i, t, _ in plain(messy)), key=str)
    assert sorted((r[1:] for r in found), key=str) == wanted and sum(r[0] is None for r in found) == 2
    assert fill_in_middle.digest_columns(nothing).count() == 0
    pieces = fill_in_middle.fill_in_middle(messy)
    assert sorted(r["text"] for r in fill_in_middle.assemble(fill_in_middle.restore(pieces)).collect()) == sorted(t or "" for _, t, _ in plain(messy))
    out = {(r["doc_id"], r["form"]): r["text"] for r in fill_in_middle.assemble(pieces).collect()}
    assert all(t.startswith(("<P>", "<S>")) == (f != "plain") for (_, f), t in out.items())


def test_middle_rate(spark):
    frame = spark.range(400).selectExpr("id as doc_id", "'a\nb\nc\n' as text")
    forms = [r["form"] for r in fill_in_middle.digest_columns(frame, share=30, spm_share=0).collect()]
    assert 80 < forms.count("psm") < 160 and forms.count("spm") == 0 and len(forms) == 400


def brute_windows(docs, width=50):
    first, out = {}, []
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        words, rank = WORD.findall(text or ""), float("inf") if i is None else i
        gone = set()
        for p in range(len(words) - width + 1):
            if first.setdefault(tuple(words[p:p + width]), rank) < rank:
                gone.update(range(p, p + width))
        out.append((i, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return sorted(out, key=str)


def windows_of(df, **options):
    found = window_repeats.remove_repeats(df, **options).collect()
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in found)
    assert all(a["end"] < b["start"] for r in found for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=str)


@pytest.mark.parametrize("width, most_bits", [(50, 28), (20, 28), (3, 28), (20, 4), (1, 16)])
def test_windows(spark, width, most_bits):
    """A sketch of sixteen counters lets nearly everything through, which must not show."""
    docs = random_docs(11, 250)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert windows_of(frame, width=width, most_bits=most_bits) == brute_windows(docs, width)


def test_windows_at_edges_of_passages(spark):
    """A passage in a third of all documents, cut at other places and surrounded by other words; and one of few different words."""
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(140)]
    docs = []
    for i in range(240):
        own = [f"d{i}_{k}" for k in range(rng.randrange(0, 30))]
        if i % 3 == 0:
            a = rng.randrange(0, 80)
            own += passage[a:a + rng.randrange(45, 70)] + own[:5]
        elif i % 3 == 1:
            own += [rng.choice("ab") for _ in range(3)] + ["x", "y"] * rng.randrange(20, 60)
        docs.append((rng.randrange(10 ** 6) * 1000 + i, "\t".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert windows_of(frame) == brute_windows(docs)


def test_windows_of_messy_tables(spark, messy, nothing):
    assert windows_of(messy) == brute_windows([d[:2] for d in plain(messy)])
    assert windows_of(messy, width=5) == brute_windows([d[:2] for d in plain(messy)], 5)
    assert window_repeats.remove_repeats(nothing).count() == 0
    # One id on a third of the rows, and rows repeated, with and without an id.
    docs = [(7, BASE + f" {i}") for i in range(30)] + [(3, BASE)] + [(None, BASE + " end")] * 30 + [(9, BASE)] * 30
    assert windows_of(spark.createDataFrame(docs, "doc_id long, text string"), width=10) == brute_windows(docs, 10)


def test_no_repeated_window_is_screened_out(spark):
    """Counters are never below the number of documents that hold a key, whatever the sketch's width."""
    docs = random_docs(2, 150)
    frame = spark.createDataFrame([(i, hash(t) % 1000, t.encode()) for i, t in docs], "doc long, text_key long, text binary")
    held = {}
    for i, t in docs:
        for least in window_repeats.Windows(t.encode(), window_repeats.Words(), 20).least.tolist():
            held.setdefault(least, set()).add(i)
    keys = np.array([k for k, d in held.items() if len(d) > 1], dtype=np.uint64)
    assert len(keys) > 20
    for bits in (6, 12, 24):
        assert window_repeats.Sketch(frame, 20, 2, bits).repeated(keys).all()


def test_sliding_and_rolling():
    x = np.random.default_rng(3).integers(0, 50, 200, dtype=np.uint64)
    for width in (1, 2, 3, 16, 35, 200):
        assert window_repeats.sliding_least(x, width).tolist() == [x[i:i + width].min() for i in range(201 - width)]
        hashed = window_repeats.rolling(x, width, 0x5851F42D4C957F2D)
        seen = {}
        for i in range(201 - width):
            assert seen.setdefault(tuple(x[i:i + width].tolist()), hashed[i]) == hashed[i]
        assert len(set(hashed.tolist())) == len(seen)
    assert F is not None
