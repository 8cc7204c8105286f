"""Removes passages that stand in a document with a smaller id: a count-min sketch screens windows of words, exact grouping decides."""

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise
from gleaner.llm.common import Screen, bounded_batches

#: A key that no count-min row maps like another, and odd, so that products keep all bits.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Words of a gram; the least gram hash of a window stands for it in the sketch.
GRAM = 16
#: Documents without an id count as after all others.
LAST = (1 << 63) - 1
#: Low bits of a counter's place that one row of the merged sketch holds.
CHUNK_BITS = 15


class Words(dict):
    """64-bit hash of a word, remembered for the words seen lately."""

    def __missing__(self, word):
        if len(self) >= 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX[k])
    return x ^ (x >> np.uint64(29))


def rolling(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every ``width`` words in a row, the base odd. Cumulative, so its cost doesn't depend on the width."""
    n = len(codes)
    powers = np.full(n, base, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.add.accumulate(codes * powers[::-1], out=sums[1:])
    # A window that starts at i is scaled by base^(n - width - i); the inverse of that makes all alike.
    inverse = np.full(n - width + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    return (sums[width:] - sums[:-width]) * inverse[::-1]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


class Windows:
    """The windows of one text: word codes, and for each window the least hash of its grams, its representative.

    Equal windows have equal representatives, so a window stands in no more documents than its representative does."""

    def __init__(self, text: bytes, words: Words, width: int):
        parts = text.split()
        self.n, self.width = len(parts), width
        self.codes = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=self.n)
        gram = min(GRAM, width)
        self.least = sliding_least(mixed(rolling(self.codes, gram, 0x5851F42D4C957F2D), 0), width - gram + 1) if self.n >= width else np.zeros(0, np.uint64)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of windows of each run of one representative. Where a run ends depends on words alone."""
        starts = np.flatnonzero(np.append(True, self.least[1:] != self.least[:-1])) if len(self.least) else np.zeros(0, np.int64)
        return starts, np.diff(np.append(starts, len(self.least)))

    def content(self, start: int, length: int) -> bytes:
        """128 bits of the words that ``length`` windows from ``start`` cover."""
        return xxhash.xxh3_128_digest(self.codes[start:start + length + self.width - 1].tobytes())

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each window."""
        return tuple(mixed(rolling(mixed(self.codes, k), self.width, b), 0).view(np.int64) for k, b in ((1, 0x2545F4914F6CDD1D), (2, 0x9FB21C651E98DF25)))


def places(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Counters of the keys in one row of the sketch."""
    return (mixed(keys, row + 1) >> np.uint64(64 - bits)).astype(np.int64) | row << bits


class Sketch:
    """Count-min sketch of how many documents hold each representative, of which it keeps what is asked: whether all counters of a
    key have reached two.

    Each task counts its documents, and Spark adds the tasks' counters up; a counter is never below the count of a key that it stands for,
    so no key of two documents or more is lost. Width follows the texts' bytes up to ``most_bits``; above that, more keys pass and are
    settled by grouping."""

    def __init__(self, docs: DataFrame, width: int, rows: int, most_bits: int):
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # Texts hold about a key for 100 bytes, so there are two to four counters in a row for each.
        self.rows, self.bits = rows, min(max(int(size // 48).bit_length(), 16), most_bits)
        bits, chunk = self.bits, 1 << CHUNK_BITS

        def counted(frames):
            words = Words()
            for frame in frames:
                keys = [np.unique(w.least[w.runs()[0]]) for w in (Windows(t, words, width) for t in frame["text"]) if len(w.least)]
                if keys:
                    keys = np.concatenate(keys)
                    place, n = np.unique(np.concatenate([places(keys, r, bits) for r in range(rows)]), return_counts=True)
                    yield pd.DataFrame({"place": place, "n": n.astype(np.int64)})

        full = docs.select("text").mapInPandas(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).where("n > 1")
        packed = full.groupBy(F.shiftright("place", CHUNK_BITS).alias("chunk")).agg(F.collect_list((F.col("place") % chunk).cast("int")).alias("low"))

        def fields(frames):
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"chunk": frame["chunk"], "field": [
                        np.packbits(np.bincount(np.asarray(low), minlength=chunk) > 0, bitorder="little").tobytes() for low in frame["low"]]})

        field = bytearray(max(rows << bits, chunk) >> 3)
        for row in packed.mapInPandas(fields, "chunk long, field binary").toLocalIterator():  # at most the sketch's bits in all
            field[row["chunk"] * (chunk >> 3):(row["chunk"] + 1) * (chunk >> 3)] = row["field"]
        self.sent = docs.sparkSession.sparkContext.broadcast(bytes(field))

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is estimated to stand in two documents or more."""
        field = np.frombuffer(self.sent.value, dtype=np.uint8)
        found = np.ones(len(keys), dtype=bool)
        for r in range(self.rows):
            at = places(keys, r, self.bits)
            found &= field[at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0
        return found


def _key(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mixed(doc.astype(np.int64).view(np.uint64) ^ mixed(key.astype(np.int64).view(np.uint64), 1), 2).view(np.int64)


def removed_ranges(docs: DataFrame, width: int = 50, rows: int = 2, most_bits: int = 28) -> DataFrame:
    """``doc``, ``text_key``, ``start``, ``end``: ranges of words, overlapping or not, that windows in a smaller document cover.

    ``docs``: doc (long, null ids as LAST), text_key (tells texts of one id apart), text (binary). A run of windows of one representative is
    one row: its representative and 128 bits of its words. Runs of equal words share the smallest document that holds them, so in every
    other document all their windows go. Where one representative has runs of different words (at the edge of a passage), windows
    of one copy of each are grouped by 128 bits of their own words, and the smallest document of a run gives up those that are held by
    a smaller one yet."""
    sketch = Sketch(docs, width, rows, most_bits)

    def runs(frames):
        words = Words()
        for frame in frames:
            out = []
            for doc, key, text in zip(frame["doc"], frame["text_key"], frame["text"]):
                w = Windows(text, words, width)
                starts, lengths = w.runs()
                for k in np.flatnonzero(sketch.repeated(w.least[starts])).tolist():
                    out.append((int(w.least[starts[k]].view(np.int64)), w.content(starts[k], lengths[k]), doc, key, starts[k], lengths[k]))
            if out:
                yield pd.DataFrame(out, columns=["least", "content", "doc", "text_key", "start", "length"])

    found = materialise(docs.mapInPandas(runs, "least long, content binary, doc long, text_key long, start int, length int"), "runs")
    contents = materialise(found.groupBy("least", "content").agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "contents")
    several = contents.groupBy("least").agg(F.count("*").alias("n")).where("n > 1").select("least")
    held = materialise(contents.join(several, "least").select("least", "content", "first"), "open_runs")
    screen = Screen(held.select("first", "least").mapInPandas(
        lambda frames: (pd.DataFrame({"key": _key(f["first"].to_numpy(), f["least"].to_numpy())}) for f in frames), "key long"))

    def opened(frames):
        words = Words()
        for frame in frames:
            out = []
            for doc, key, text in zip(frame["doc"], frame["text_key"], frame["text"]):
                w = Windows(text, words, width)
                starts, lengths = w.runs()
                least = w.least[starts]
                chosen = screen.passes(_key(np.full(len(least), doc), least)) & sketch.repeated(least)
                if chosen.any():
                    at = np.flatnonzero(np.repeat(chosen, lengths))
                    one, two = w.digests()
                    out.append((np.full(len(at), doc), np.full(len(at), key), at.astype(np.int32), one[at], two[at]))
            if out:
                yield pd.DataFrame(dict(zip(("doc", "text_key", "start", "one", "two"), map(np.concatenate, zip(*out)))))

    # Windows of runs that passed the screens by chance are true windows too: they can only repeat what is removed anyway.
    windows = materialise(docs.mapInPandas(opened, "doc long, text_key long, start int, one long, two long"), "windows")
    shared = materialise(windows.groupBy("one", "two").agg(F.min("doc").alias("earliest"), F.max("doc").alias("latest")).where("earliest < latest"), "shared")
    whole = found.join(contents.where("first < last"), ["least", "content"]).where("doc > first").select(
        "doc", "text_key", "start", (F.col("start") + F.col("length") + (width - 1)).alias("end"))
    edges = windows.join(shared, ["one", "two"]).where("doc > earliest").select("doc", "text_key", "start", (F.col("start") + width).alias("end"))
    return whole.unionByName(edges)


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 50, **options) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``spans`` (start and end of maximal removed runs of words), ``kept`` for every row.

    A word goes if ``width`` words in a row that hold it also start in a document with a smaller id. Words are parted by ASCII
    white space and otherwise taken as they are; ``kept`` joins those that stay by one space.

    Null and empty texts have no words; a text of fewer than ``width`` words keeps all; documents without an id count as after all others and
    take nothing from each other; rows that share an id take nothing from each other either; repeated rows are returned as often as they
    come; an empty table gives no rows; further columns are ignored."""
    bounded_batches(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    plain = docs.select(F.coalesce(F.col(f"`{doc}`").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(body).alias("text_key"), body.cast("binary").alias("text"))
    ranges = removed_ranges(plain, width, **options).distinct().groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    named = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.coalesce(F.col(f"`{doc}`").cast("long"), F.lit(LAST)).alias("doc"),
                        F.xxhash64(body).alias("text_key"), body.cast("binary").alias("text"))
    cut = named.join(ranges, ["doc", "text_key"], "left").select("doc_id", "text", "ranges")
    kind = docs.schema[doc].dataType.simpleString()

    def rows(frames):
        for frame in frames:
            out = []
            for i, text, ranges in zip(frame["doc_id"], frame["text"], frame["ranges"]):
                words = text.split()
                spans, kept, at = [], [], 0
                for start, end in sorted((r["start"], r["end"]) for r in ranges) if ranges is not None else ():
                    if spans and start <= spans[-1]["end"]:
                        spans[-1]["end"] = max(end, spans[-1]["end"])
                    else:
                        spans.append({"start": start, "end": end})
                for span in spans:
                    kept += words[at:span["start"]]
                    at = span["end"]
                kept += words[at:]
                out.append((i, len(words), len(words) - len(kept), spans, b" ".join(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept"]).astype({"doc_id": object})

    return cut.mapInPandas(rows, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary").withColumn(
        "kept", F.col("kept").cast("string"))
