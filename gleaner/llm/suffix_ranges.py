"""Exact substring deduplication: sampled suffixes, range-partitioned, sorted in buckets, compared across their boundaries.

Of all suffixes those are kept that start at the window minima of a hash of the leading bytes: every string of ``LEAST`` bytes holds
``WINDOW`` leading strings of ``LEAD`` bytes, the least of which is its anchor, in whatever document the string stands. So equal strings
meet at equal anchors, and one suffix in sixteen is enough. The strings that share an anchor form a run."""

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise
from gleaner.llm.common import bounded_batches

LEAST, LEAD = 50, 20
WINDOW = LEAST - LEAD + 1
#: Bytes of a text that are taken at once; runs are cut there, which only moves work to the second level.
SEGMENT = 1 << 18
PLACE = np.uint64((1 << 20) - 1)
_rng = np.random.default_rng(23)
BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
ODD = _rng.integers(0, 1 << 64, 6, dtype=np.uint64) | np.uint64(1)


def _powers(base: int) -> np.ndarray:
    factors = np.full(SEGMENT + LEAST + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


POWERS, INVERSE = _powers(int(ODD[5])), _powers(pow(int(ODD[5]), -1, 1 << 64))
#: A second hash of contents, with values and a base of its own.
MORE_BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_base = int(_rng.integers(0, 1 << 64, dtype=np.uint64)) | 1
MORE_POWERS, MORE_INVERSE = _powers(_base), _powers(pow(_base, -1, 1 << 64))
NO_ID = (1 << 63) - 1


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return values ^ values >> np.uint64(29)


def _content(part: np.ndarray, first: np.ndarray, end: np.ndarray):
    """Two hashes (64 and 32 bits) of the bytes of ``part`` from ``first`` to ``end``."""
    out = []
    for values, powers, inverse in ((BYTES, POWERS, INVERSE), (MORE_BYTES, MORE_POWERS, MORE_INVERSE)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[part] * powers[:len(part)])])
        out.append(_mixed((sums[end] - sums[first]) * inverse[first]))
    return out[0], out[1] >> np.uint64(32)


def runs(data: bytes):
    """Of each run of a text: the anchor's key (40 bits), two hashes of all its bytes (96 bits), its first string and their number."""
    out = []
    whole = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(whole) - LEAST + 1, SEGMENT):
        part = whole[at:at + SEGMENT + LEAST - 1]
        lead, width = BYTES[part], 1
        while width < 16:
            lead = lead[:-width] * ODD[width.bit_length() - 1] + lead[width:]
            if width == 2:
                four = lead
            width *= 2
        lead = lead[:-4] * ODD[4] + four[16:]
        lead ^= lead >> np.uint64(31)
        lead *= np.uint64(0x9E3779B97F4A7C15)
        lead ^= lead >> np.uint64(29)
        least = lead & ~PLACE | np.arange(len(lead), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[:len(least) - (WINDOW - 16)], least[WINDOW - 16:])
        anchor = (least & PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        stop = np.append(first[1:], len(anchor))
        out.append((lead[anchor[first]] >> np.uint64(24), *_content(part, first, stop + LEAST - 1), first + at, stop - first))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(map(np.concatenate, zip(*out)))


def five(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def multikey_groups(words: np.ndarray) -> np.ndarray:
    """Group number of each row of ``words``, equal rows alike: sorted by the first word, and ties by the next ones only."""
    group, active = np.zeros(len(words), dtype=np.int64), np.arange(len(words))
    last = 0
    for c in range(words.shape[1]):
        order = active[np.lexsort((words[active, c], group[active]))]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (group[order[1:]] != group[order[:-1]]) | (words[order[1:], c] != words[order[:-1], c])
        found = np.cumsum(new)
        group[order] = last + found
        last += int(found[-1]) if len(found) else 0
        active = order[np.bincount(found)[found] > 1]
        if not len(active):
            break
    return group


def least_of(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the least value of its group."""
    _, at = np.unique(groups, return_inverse=True)
    least = np.full(at.max() + 1 if len(at) else 0, NO_ID, dtype=np.int64)
    np.minimum.at(least, at, values)
    return least[at]


class Ranges:
    """Buckets of anchor keys between sampled splitters. A key that the sample holds so often that it is several splitters is
    dealt to all buckets it spans, and what they find of it is compared across them."""

    def __init__(self, sample: np.ndarray, buckets: int):
        ordered = np.sort(sample)
        self.splitters = ordered[np.arange(1, buckets) * len(ordered) // buckets] if len(ordered) else ordered
        value, times = np.unique(self.splitters, return_counts=True)
        self.spanning = value[times > 1]

    def spans(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.spanning, keys), max(len(self.spanning) - 1, 0))
        return self.spanning[at] == keys if len(self.spanning) else np.zeros(len(keys), dtype=bool)

    def bucket(self, keys: np.ndarray, salt: np.ndarray) -> np.ndarray:
        left, right = np.searchsorted(self.splitters, keys, "left"), np.searchsorted(self.splitters, keys, "right")
        width = np.where(right - left > 1, right - left, 1)
        return np.where(width > 1, left + 1 + salt.astype(np.int64) % width, right)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _split(groups: np.ndarray):
    """(group, rows in it) in order."""
    order = np.argsort(groups, kind="stable")
    cut = np.flatnonzero(np.diff(groups[order])) + 1
    for rows in np.split(order, cut):
        if len(rows):
            yield groups[rows[0]], rows


RUNS = "bucket int, key binary, content binary, more binary, doc binary, uid binary, first binary, n binary"
#: What was found of runs, packed by share of the texts. Kinds: 0 covered strings, 1 runs to look into, 2 first of its content in
#: one bucket of several, the only ones whose content is compared further.
FOUND = "share int, kind int, key binary, content binary, more binary, doc binary, uid binary, first binary, n binary"
CONTEXTS = "bucket int, key binary, doc binary, uid binary, first binary, n binary, bytes binary"
EDGE = "key long, content long, more long, doc long, uid long, first long, n long"


def _deal_runs(texts: DataFrame, ranges: Ranges, flush: int = 1 << 23) -> DataFrame:
    """Packed runs by bucket, one row for each bucket and some MB of text."""

    def rows(held):
        out = []
        if held:
            key, content, more, doc, uid, first, n = map(np.concatenate, zip(*held))
            for bucket, at in _split(ranges.bucket(key, uid & 0x7FFFFFFF)):
                out.append((int(bucket), five(key[at]), content[at].astype("<u8").tobytes(), more[at].astype("<u4").tobytes(), doc[at].tobytes(),
                            uid[at].tobytes(), first[at].astype("<i4").tobytes(), n[at].astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=_names(RUNS))

    def packed(frames):
        held, size = [], 0
        for frame in frames:
            for uid, doc, text in zip(frame["uid"], frame["doc"], frame["text"]):
                key, content, more, first, n = runs(text)
                if len(key):
                    held.append((key, content, more, np.full(len(key), doc), np.full(len(key), uid), first, n))
                    size += len(text)
                if size >= flush:
                    yield rows(held)
                    held, size = [], 0
        yield rows(held)

    return texts.mapInPandas(packed, RUNS)


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).astype(np.int64)


def _pack_found(shares: int, kind: int, key, content, more, doc, uid, first, n) -> list[tuple]:
    hashed = lambda values, at, kept: values[at].astype(kept).tobytes() if kind == 2 else b""
    return [(int(share), kind, five(key[at]), hashed(content, at, "<i8"), hashed(more, at, "<u4"), doc[at].astype("<i8").tobytes(), uid[at].astype("<i8").tobytes(),
             first[at].astype("<i4").tobytes(), n[at].astype("<i4").tobytes()) for share, at in _split((uid & 0x7FFFFFFF) % shares)]


def _look_at_runs(dealt: DataFrame, ranges: Ranges, shares: int) -> DataFrame:
    """Runs whose whole content a smaller document has are covered; of the others, those that share an anchor with other content
    are to be looked into."""

    def looked(frame):
        key = from_five(b"".join(frame["key"]))
        content, more, doc, uid, first, n = (_joined(frame[c], k) for c, k in (
            ("content", "<i8"), ("more", "<u4"), ("doc", "<i8"), ("uid", "<i8"), ("first", "<i4"), ("n", "u1")))
        order = np.lexsort((doc, n, more, content, key))
        every = [x[order] for x in (key, content, more, doc, uid, first, n)]
        key, content, more, doc, n = *every[:4], every[6]
        new_key = np.append(True, key[1:] != key[:-1])
        new = np.append(True, new_key[1:] | (content[1:] != content[:-1]) | (more[1:] != more[:-1]) | (n[1:] != n[:-1]))
        covered = doc > doc[new][np.cumsum(new) - 1]
        several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1] > 1
        spans = ranges.spans(key)
        out = []
        for kind, chosen in enumerate((covered, ~covered & several & ~spans, ~covered & spans)):
            out += _pack_found(shares, kind, *(x[chosen] for x in every))
        return pd.DataFrame(out, columns=_names(FOUND))

    return dealt.groupBy("bucket").applyInPandas(looked, FOUND)


def _across(found: DataFrame, shares: int, rest: int | None) -> DataFrame:
    """Compares what several buckets found of a spanning key: kind 0 where a smaller document has the content, else ``rest``."""

    def opened(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame(dict(zip(_names(EDGE), (from_five(b"".join(frame["key"])).astype(np.int64), *(
                    _joined(frame[c], k) for c, k in (("content", "<i8"), ("more", "<u4"), ("doc", "<i8"), ("uid", "<i8"), ("first", "<i4"), ("n", "<i4")))))))

    def closed(frames):
        for frame in frames:
            for kind in (0, rest):
                part = frame[frame["covered"] == (kind == 0)] if kind is not None else frame[:0]
                if len(part):
                    columns = [part[c].to_numpy(np.int64) for c in _names(EDGE)]
                    yield pd.DataFrame(_pack_found(shares, kind, columns[0].astype(np.uint64), *columns[1:]), columns=_names(FOUND))

    edge = found.where("kind = 2").mapInPandas(opened, EDGE)
    same = ["key", "content", "more", "n"]
    least = edge.groupBy(same).agg(F.min("doc").alias("least"))
    return edge.join(least, same).withColumn("covered", F.col("doc") > F.col("least")).select(*_names(EDGE), "covered").mapInPandas(closed, FOUND)


def _with_texts(texts: DataFrame, found: DataFrame, kind: int, shares: int, user, schema: str) -> DataFrame:
    """Brings each text together with what was found of it. ``user()`` makes an object for a task, whose ``text(uid, doc, text, key,
    first, n)`` and ``end()`` return frames or None."""
    share = F.pmod(F.col("uid").bitwiseAND(0x7FFFFFFF), F.lit(shares)).cast("int").alias("share")
    both = "share int, kind int, row long, doc long, key binary, uid binary, first binary, n binary"

    def squeeze(frames):
        tool = zstandard.ZstdCompressor(level=1)
        for frame in frames:
            yield pd.DataFrame({"share": frame["share"], "kind": 9, "row": frame["uid"], "doc": frame["doc"],
                                "key": [tool.compress(t) for t in frame["text"]], "uid": None, "first": None, "n": None})

    zero = F.lit(0).cast("long")  # null would make the column one of doubles
    marks = found.where(F.col("kind") == kind).select("share", "kind", zero.alias("row"), zero.alias("doc"), "key", "uid", "first", "n")
    rows = texts.select(share, "uid", "doc", "text").mapInPandas(squeeze, both).unionByName(marks).repartition("share").sortWithinPartitions("share", "kind")

    def gathered(held):
        parts = [np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(4)]
        order = np.lexsort((parts[2], parts[1]))
        return [p[order] for p in parts]

    def used(frames):
        tool, now, share, held = zstandard.ZstdDecompressor(), user(), None, []
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.share != share:
                    share, held, marked = row.share, [], None
                if row.kind != 9:
                    held.append((from_five(row.key), np.frombuffer(row.uid, "<i8"), np.frombuffer(row.first, "<i4"), np.frombuffer(row.n, "<i4")))
                    continue
                if marked is None:
                    marked, held = gathered(held), []
                uid = int(row.row)
                a, b = np.searchsorted(marked[1], uid, "left"), np.searchsorted(marked[1], uid, "right")
                out = now.text(uid, int(row.doc), tool.decompress(row.key), marked[0][a:b], *(marked[i][a:b].astype(np.int64) for i in (2, 3)))
                if out is not None:
                    yield out
        out = now.end()
        if out is not None:
            yield out

    return rows.mapInPandas(used, schema)


class Contexts:
    """Cuts the bytes of runs to look into out of the texts and deals them to the anchors' buckets."""

    def __init__(self, ranges: Ranges, flush: int = 1 << 22):
        self.ranges, self.flush, self.held, self.size = ranges, flush, [], 0

    def text(self, uid, doc, text, key, first, n):
        self.held += [(k, doc, uid, f, m, text[f:f + m + LEAST - 1]) for k, f, m in zip(key.tolist(), first.tolist(), n.tolist())]
        self.size += int(n.sum()) + LEAST * len(n)
        return self.end() if self.size >= self.flush else None

    def end(self):
        if not self.held:
            return None
        key = np.array([h[0] for h in self.held], dtype=np.uint64)
        doc, uid, first, n = (np.array([h[i] for h in self.held], dtype=np.int64) for i in range(1, 5))
        out = [(int(bucket), five(key[at]), doc[at].tobytes(), uid[at].tobytes(), first[at].astype("<i4").tobytes(), n[at].astype(np.uint8).tobytes(),
                b"".join(self.held[i][5] for i in at)) for bucket, at in _split(self.ranges.bucket(key, uid & 0x7FFFFFFF))]
        self.held, self.size = [], 0
        return pd.DataFrame(out, columns=_names(CONTEXTS))


def _look_into(contexts: DataFrame, ranges: Ranges, shares: int, block: int = 1 << 16) -> DataFrame:
    """Sorts all strings of ``LEAST`` bytes of the runs of a bucket, anchor by anchor, and finds those a smaller document has."""

    def strings(data, key, at, doc, uid, first, n):
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        words = np.zeros((len(row), 56), dtype=np.uint8)
        words[:, :LEAST] = np.lib.stride_tricks.sliding_window_view(data, LEAST)[at[row] + step]
        words = words.view(np.uint64)
        least = least_of(multikey_groups(np.hstack([key[row, None], words])), doc[row])
        covered = doc[row] > least
        none = np.zeros(len(row), np.uint64)
        every = [key[row], none, none, doc[row], uid[row], first[row] + step, np.ones(len(row), np.int64)]
        edge = ~covered & ranges.spans(key)[row]
        # Strings in a row become one entry.
        joins = covered[1:] & covered[:-1] & (row[1:] == row[:-1])
        start = np.flatnonzero(covered & ~np.append(False, joins))
        stop = np.flatnonzero(covered & ~np.append(joins, False))
        spans = [x[start] for x in every]
        spans[6] = stop - start + 1
        edges = [x[edge] for x in every]
        flat = np.ascontiguousarray(words.view(np.uint8)[edge, :LEAST])
        powers, more = POWERS[:LEAST], MORE_POWERS[:LEAST]
        edges[1], edges[2] = _mixed((BYTES[flat] * powers).sum(axis=1)).view(np.int64), _mixed((MORE_BYTES[flat] * more).sum(axis=1)) >> np.uint64(32)
        return _pack_found(shares, 0, *spans) + _pack_found(shares, 2, *edges)

    def looked(frame):
        key = from_five(b"".join(frame["key"]))
        doc, uid, first, n = (_joined(frame[c], k) for c, k in (("doc", "<i8"), ("uid", "<i8"), ("first", "<i4"), ("n", "u1")))
        data = np.frombuffer(b"".join(frame["bytes"]), dtype=np.uint8)
        size = n + LEAST - 1
        at = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        key, at, doc, uid, first, n = (x[order] for x in (key, at, doc, uid, first, n))
        total = np.cumsum(n)
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        out, start = [], 0
        while start < len(key):
            fits = ends[np.searchsorted(total[ends - 1], (total[start] - n[start]) + block, "right") - 1]
            stop = fits if fits > start else ends[np.searchsorted(ends, start, "right")]
            out += strings(data, *(x[start:stop] for x in (key, at, doc, uid, first, n)))
            start = stop
        return pd.DataFrame(out, columns=_names(FOUND))

    return contexts.groupBy("bucket").applyInPandas(looked, FOUND)


RESULT = "doc_id long, n_bytes long, spans array<struct<start:int,length:int>>, kept binary"


class Cut:
    """Takes covered bytes out of texts, and returns some MB of them at a time."""

    def __init__(self, flush: int = 1 << 22):
        self.flush, self.held, self.size = flush, [], 0

    def text(self, uid, doc, text, key, first, n):
        spans, kept = [], text
        if len(first):
            change = np.zeros(len(text) + 1, dtype=np.int32)
            np.add.at(change, first, 1)
            np.add.at(change, first + n + LEAST - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            spans = [{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()]
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
        self.held.append((None if doc == NO_ID else doc, len(text), spans, kept))
        self.size += len(text) + 200
        return self.end() if self.size >= self.flush else None

    def end(self):
        if not self.held:
            return None
        out = pd.DataFrame(self.held, columns=["doc_id", "n_bytes", "spans", "kept"], dtype=object)
        self.held, self.size = [], 0
        return out.astype({"doc_id": "Int64", "n_bytes": "int64"})


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", bucket_bytes: int = 4 << 20, sample: int = 65_536, seed: int = 29) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (start, length of maximal removed runs) and ``kept`` (the bytes left) for every row.

    A byte goes if a string of ``LEAST`` bytes that covers it also starts in a document with a smaller id, by the texts as they came.
    Splitters come from at most ``sample`` anchors drawn from one in 64 documents, and decide only where work is done.

    Null texts are empty; a null id is larger than all others; rows that share an id don't remove each other's bytes; texts shorter
    than ``LEAST`` stay; an empty table gives no rows; further columns are ignored. Buckets and shares of texts number one for each
    ``bucket_bytes`` of text, which bounds what a task holds at once, next to a single text."""
    bounded_batches(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    texts = docs.select(F.xxhash64(F.lit(seed), F.col(f"`{doc}`"), body).alias("uid"), F.coalesce(F.col(f"`{doc}`").cast("long"), F.lit(NO_ID)).alias("doc"), body.alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // bucket_bytes))

    def some(frames):
        for frame in frames:
            keys = [runs(t)[0] for t in frame["text"]]
            keys = np.concatenate([*keys, np.zeros(0, np.uint64)]).astype(np.int64)
            yield pd.DataFrame({"key": keys, "draw": np.random.default_rng([seed, len(keys)]).random(len(keys))})

    drawn = texts.where(F.pmod("uid", F.lit(64)) == 0).mapInPandas(some, "key long, draw double").where("draw < 0.0625").orderBy("draw", "key").limit(sample)
    ranges = Ranges(np.array([r["key"] for r in drawn.collect()], dtype=np.uint64), parts)
    first = materialise(_look_at_runs(_deal_runs(texts, ranges), ranges, parts), "runs")
    first = first.where("kind < 2").unionByName(_across(first, parts, 1))
    second = materialise(_look_into(_with_texts(texts, first, 1, parts, lambda: Contexts(ranges), CONTEXTS), ranges, parts), "strings")
    found = first.where("kind = 0").unionByName(second.where("kind = 0")).unionByName(_across(second, parts, None))
    return _with_texts(texts, found, 0, parts, Cut, RESULT)

