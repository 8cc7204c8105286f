"""Archives with long heads, members of several records and foreign digests; guess costs against a program over all segments."""

import base64
import gzip
import hashlib
import random

import pytest

from gleaner.llm import guess_cost, warc_salvage

sha256 = lambda data: hashlib.sha256(data).hexdigest()


def own(i, body):
    return warc_salvage.record(i, "u", body, len(body), sha256(body), None, "d")


def test_heads_of_any_length_come_back(spark, tmp_path):
    """An escaped url of 90,000 bytes makes a head that is longer than any buffer."""
    rows = [(1, "http://x/" + "%" * 30_000, "<p>one</p>"), (2, "\r\n\r\n" * 20_000, None), (3, None, "<p>three</p>" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc_salvage.write_archives(pages, f"{tmp_path}/w")
    found = {r["page_id"]: (r["kind"], r["url"], r["payload_bytes"]) for r in warc_salvage.read_archives(spark, f"{tmp_path}/w").collect()}
    assert found == {i: ("response", url, len(html or "")) for i, url, html in rows}


def test_files_keep_to_their_bytes(spark, tmp_path):
    rows = [(i, "u", "x" * 5000 if i % 5 else "y" * 20_000) for i in range(60)]
    warc_salvage.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w", bytes_per_file=100_000)
    files = [r["n"] for r in warc_salvage.read_archives(spark, f"{tmp_path}/w").groupBy("file").agg(warc_salvage.F.sum("payload_bytes").alias("n")).collect()]
    assert len(files) > 5 and max(files) <= 100_000
    assert warc_salvage.read_archives(spark, f"{tmp_path}/w").count() == 60


def test_members_of_several_records():
    good = [own(i, b"body %d" % i * 30) for i in range(5)]
    bad = bytearray(good[1])
    bad[-20] ^= 1
    data = gzip.compress(good[0] + bytes(bad) + b"noise" + good[2]) + gzip.compress(b"no record at all") + gzip.compress(good[3]) + good[4]
    found = list(warc_salvage.salvage(data))
    assert [f["page_id"] for _, _, f in found if f and "kind" in f] == [0, 2, 3, 4]
    inner = [f["inner"] for _, _, f in found if f and "inner" in f]
    assert inner == [(0, len(good[0])), (len(good[0]), len(bad) + 5), (len(good[0]) + len(bad) + 5, len(good[2]))]
    spans = sorted({(a, n) for a, n, _ in found})
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) == len(data)


@pytest.mark.parametrize("told, holds", [
    ("sha1:{b32}", True), ("sha1:{hex}", True), ("SHA1:{b32}", True), ("md5:{md5}", True), ("blake9:what", True), ("", True), ("sha1:AAAA", False), ("sha256:00", False)])
def test_digests_of_other_writers(told, holds):
    body = "<html>é</html>".encode()
    sha1 = hashlib.sha1(body)
    told = told.format(b32=base64.b32encode(sha1.digest()).decode(), hex=sha1.hexdigest(), md5=hashlib.md5(body).hexdigest())
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    digest = f"WARC-Payload-Digest: {told}\r\n" if told else ""
    data = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:7b-1>\r\n{digest}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    for stored in (data, gzip.compress(data)):
        (start, length, fields), = warc_salvage.salvage(stored)
        assert (start, length) == (0, len(stored)) and (fields is not None) == holds
        if holds:
            assert fields["record_id"] == "<urn:uuid:7b-1>" and fields["page_id"] is None and fields["payload_digest"] == sha256(body)


def test_queries_fail_on_gaps_instead_of_leaving_them_out(spark, tmp_path, monkeypatch):
    from gleaner.llm import queries

    monkeypatch.setattr(warc_salvage, "write_archives", lambda pages, path: pages.sparkSession.createDataFrame([("junk",)], "value string").write.text(path))
    with pytest.raises(Exception, match="a gap in archives just written"):
        queries.op3(spark, "/root/testdata/sf0.001").collect()


def all_segments(value, rank):
    """Least cost over all segmentations, each segment a brute-force span or what segment_bits says."""
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + 1 + min(sum(map(guess_cost.char_bits, value[i:j])), guess_cost.segment_bits(value, i, j, rank)) for i in range(j)))
    return best[-1]


def test_guess_costs_are_least():
    rng = random.Random(9)
    rank = guess_cost.RANK | {"lantern": 300, "orange": 150}
    parts = ["secret", "lantern", "0range", "tuvw", "abc", "aaaa", "zz", "7777", "1998", "2024-01-31", "311299", "qwe", "qaz", "wsx", "1qaz2wsx", "poiu", "9", "K", "$!", "é", "X7", "passw0rd", "PASS"]
    for _ in range(1500):
        value = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
        assert guess_cost.guess_bits(value, rank) == pytest.approx(all_segments(value, rank), abs=1e-9), value
    for _ in range(500):
        value = "".join(rng.choice("aabc123qwz.-19") for _ in range(rng.randrange(1, 14)))
        assert guess_cost.guess_bits(value, rank) == pytest.approx(all_segments(value, rank), abs=1e-9), value
    assert guess_cost.guess_bits("mysecretstuvw") < 28 and guess_cost.guess_bits("qazwsxedc") < 28
    assert guess_cost.guess_bits("a" * 20_000) < 40


def test_words_of_the_texts_are_cheap(spark):
    docs = [(i, "the correct horse stands by the battery with a staple") for i in range(9)] + [(9, "pwd: correcthorsebatterystaple"), (10, "pwd: xkvjqpwzmrtgh"), (11, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in guess_cost.digest_columns(frame).collect()}
    assert spans[10] == "guess:5:18" and guess_cost.guess_bits("correcthorsebatterystaple") > 100
    rank = guess_cost.ranked_words(frame)
    assert guess_cost.guess_bits("correcthorsebatterystaple", rank) < 40 and "xkvjqpwzmrtgh" not in rank
    assert guess_cost.ranked_words(frame, most=2) == guess_cost.RANK | {w: r for w, r in guess_cost.ranked_words(frame, most=2).items() if w not in guess_cost.RANK}
