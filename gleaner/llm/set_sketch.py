"""Near-duplicate documents by SetSketch registers, banded, estimated by likelihood, and verified on whole sets."""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise
from gleaner.llm.common import Screen, bounded_batches, components

#: Shingles whose register values are computed at once.
PART = 1024
#: Base, rate and largest value of the registers.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Counters that order shingles by rarity.
COUNTERS = 1 << 18


class Words(dict):
    """64-bit hash of a word, remembered for the words seen lately."""

    def __missing__(self, word):
        if len(self) >= 100_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str | None, words: Words, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; ASCII letters in lower case, words parted by ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    w = min(size, len(codes))
    hashed = np.full(len(codes) - w + 1, w, dtype=np.uint64)
    for i in range(w):
        hashed = (hashed ^ codes[i:len(codes) - w + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(32)
    return np.unique(hashed)


def multipliers(m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, m, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, m, dtype=np.uint64)


def registers(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Register i is floor(1 - log_base of the least of exponential values that the i-th hash gives the elements), truncated.

    Exponentials fall with their hash, so the least one comes from the least hash, and two sketches merge by maximum."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), PART):
        hashed = shingles[at:at + PART, None] * a
        hashed += b
        np.minimum(least, hashed.min(axis=0), out=least)
    least = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def likely_jaccard(n: np.ndarray, other: np.ndarray, above: np.ndarray, below: np.ndarray, m: int) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, given both sizes and how many registers are above and below the other's."""
    u = n / (n + other)
    v = 1 - u
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = chance(u - v * j), chance(v - u * j)
        return above * np.log(up) + below * np.log(down) + (m - above - below) * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(n)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one peak
        left, right = low + (high - low) / 3, high - (high - low) / 3
        rising = likelihood(left) < likelihood(right)
        low, high = np.where(rising, left, low), np.where(rising, high, right)
    return (low + high) / 2


def unpacked(data: bytes) -> np.ndarray:
    """The sorted hashes of a set."""
    return np.frombuffer(data, dtype="<u8")


def _verify(pairs: DataFrame, bodies: DataFrame, percent: int, margin: float, block: int = 512) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. ``bodies``: id, n, regs, grams.

    A document's set goes once to each block of up to ``block`` partners of its pair's first document; a pair whose estimate
    lies more than ``margin`` below isn't counted out."""
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = pairs.join(share, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "part", "b")
    body = ["n", "regs", "grams"]
    others = dealt.join(bodies.withColumnRenamed("id", "b"), "b").select("a", "part", "b", *body)
    firsts = dealt.select("a", "part").distinct().join(bodies.withColumnRenamed("id", "a"), "a").select(
        "a", "part", F.lit(None).cast("long").alias("b"), *body)
    rows = firsts.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def checked(frames):
        first = None
        for frame in frames:
            firsts, mates = [], []  # of each pair: its first document, and the row of its second
            for k, (a, b, n, reg, grams) in enumerate(zip(frame["a"], frame["b"], frame["n"], frame["regs"], frame["grams"])):
                if pd.isna(b):
                    first = (a, n, np.frombuffer(reg, dtype="<u2"), unpacked(grams))
                elif min(n, first[1]) * 100 >= percent * max(n, first[1]):
                    firsts.append(first)
                    mates.append(k)
            out = []
            if mates:
                some = frame.iloc[mates]
                regs, own = np.stack([np.frombuffer(r, dtype="<u2") for r in some["regs"]]), np.stack([f[2] for f in firsts])
                sizes, others = some["n"].to_numpy(np.float64), np.array([f[1] for f in firsts], dtype=np.float64)
                likely = likely_jaccard(sizes, others, (regs > own).sum(axis=1), (regs < own).sum(axis=1), regs.shape[1])
                for k in np.flatnonzero(likely >= percent / 100 - margin):
                    a, size, _, known = firsts[k]
                    mine = unpacked(some["grams"].iloc[k])
                    both = int(np.sum(known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine))
                    if both * 100 >= percent * (len(mine) + size - both):
                        out.append((a, int(some["b"].iloc[k])))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(checked, "a long, b long")


def _dealt(tokens: DataFrame, block: int) -> DataFrame:
    """Rows of grams that several components share, by the cells in which they meet: ``kind``, ``i``, ``j`` and ``side``.

    A gram of up to ``block`` rows is one cell (side -1). Rows of a larger one's main component are dealt to cells of that size,
    each of which all its other rows visit; those others meet each other by pairs of blocks. Sides differ for rows to be compared."""
    per = tokens.groupBy("gram", "component").agg(F.count("*").alias("rows"))
    shared = per.groupBy("gram").agg(
        F.sum("rows").alias("all"), F.max("rows").alias("mains"), F.max_by("component", F.struct("rows", "component")).alias("main"),
        F.count("*").alias("components")).where("components > 1")
    own = lambda parts: F.pmod(F.xxhash64("id"), parts).cast("int")
    blocks = lambda n: F.ceil(n / block).cast("int")
    mains, rest = blocks(F.col("mains")), blocks(F.col("all") - F.col("mains"))
    cell = lambda kind, i, j, side: F.struct(
        F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    nil = F.lit(0)
    visits = F.transform(F.sequence(nil, mains - 1), lambda i: cell(1, i, nil, F.lit(1)))
    among = F.transform(F.sequence(nil, rest - 1), lambda j: cell(
        2, F.least(own(rest), j), F.greatest(own(rest), j), F.when(own(rest) == j, -1).when(own(rest) < j, 0).otherwise(1)))
    cells = F.when(F.col("all") <= block, F.array(cell(0, nil, nil, F.lit(-1)))).when(
        F.col("component") == F.col("main"), F.array(cell(1, own(mains), nil, nil))).otherwise(F.concat(visits, among))
    return tokens.join(shared, "gram").select("gram", "id", "component", "n", "at", F.explode(cells).alias("cell")).select(
        "gram", "cell.*", "id", "component", "n", "at")


def _across(open_bodies: DataFrame, groups: DataFrame, percent: int, block: int = 4096) -> DataFrame:
    """Pairs (a, b) of different components that may reach the similarity, from documents of buckets that hold several components.

    Exact by prefix: with shingles ordered by rarity, two sets this similar share one among the first ones of each, with enough
    shingles left behind it. Any order will do, so rarity is counted in ``COUNTERS`` counters, whatever the number of shingles."""

    def counted(frames):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for frame in frames:
            for grams in frame["grams"]:
                total += np.bincount((unpacked(grams) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"place": at.astype(np.int32), "n": total[at]})

    rarity = np.zeros(COUNTERS, dtype=np.int64)
    totals = open_bodies.select("grams").mapInPandas(counted, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    rarity[totals["place"]] = totals["n"]  # one row per counter
    sent = open_bodies.sparkSession.sparkContext.broadcast(rarity)

    def prefixes(frames):
        for frame in frames:
            parts = []
            for i, component, grams in zip(frame["id"], frame["component"], frame["grams"]):
                all_grams = unpacked(grams)
                n = len(all_grams)
                reach = n - -(-percent * n // 100) + 1
                order = np.lexsort((all_grams, sent.value[(all_grams & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:reach]
                parts.append(pd.DataFrame({"gram": all_grams[order].view(np.int64), "id": i, "component": component, "n": n, "at": np.arange(len(order))}))
            if parts:
                yield pd.concat(parts)

    def crossing(ids, component, n, at, side):
        if side[0] < 0:
            main = np.unique(component, return_counts=True)
            looked = component != main[0][main[1].argmax()]
        else:
            looked = side == 1
        for i in np.flatnonzero(looked):
            left = 1 + np.minimum(n - at, n[i] - at[i]) - 1
            ok = (component != component[i]) & (left * (100 + percent) >= percent * (n + n[i])) & (
                np.minimum(n, n[i]) * 100 >= percent * np.maximum(n, n[i]))
            if side[0] >= 0:
                ok &= side == 0
            for j in np.flatnonzero(ok):
                yield min(ids[i], ids[j]), max(ids[i], ids[j])

    cell = ["gram", "kind", "i", "j"]

    def paired(frames):
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame])
            cut = np.flatnonzero(np.any(np.diff(frame[cell].to_numpy(np.int64), axis=0) != 0, axis=1)) + 1
            last = cut[-1] if len(cut) else 0
            held, frame = frame.iloc[last:], frame.iloc[:last]
            yield pairs_of(frame, cut[:-1])
        if held is not None:
            yield pairs_of(held, np.zeros(0, dtype=np.int64))

    def pairs_of(frame, cut):
        out = set()
        columns = [frame[c].to_numpy(np.int64) for c in ("id", "component", "n", "at", "side")]
        for start, end in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(frame)]])):
            if end - start > 1:
                out.update(crossing(*(c[start:end] for c in columns)))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    tokens = materialise(open_bodies.join(groups, "id").mapInPandas(
        prefixes, "gram long, id long, component long, n long, at long"), "prefixes")
    return _dealt(tokens, block).repartition(*cell).sortWithinPartitions(*cell).mapInPandas(paired, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80, bands: int = 32,
                    rows: int = 5, margin: float = 0.17, seed: int = 7) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` (doc_id = component_id) for every row.

    Links join documents whose sets of ``size``-word shingles share ``percent`` % of their union. Documents of equal sets collapse to
    the smallest id first. Registers in ``bands`` bands of ``rows`` deal the rest to buckets; a link of exactly 80 % is missed
    by all 32 bands of 5 with a chance of 3 in a million. Each document is verified against the smallest id it meets; then
    documents of buckets that still hold several components are compared across them, and found pairs are verified.

    Null and empty texts have the empty set and no link; a document without an id takes the component of the documents with its
    very set, else null, and is kept if null; rows that share an id are one document; repeated rows are returned as often as they come; an
    empty table gives no rows; further columns are ignored. Texts may have any length."""
    bounded_batches(docs.sparkSession)
    ids = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    m = bands * rows

    def sketches(frames):
        words, (a, b) = Words(), multipliers(m, seed)
        for frame in frames:
            out = []
            for i, value in zip(frame["doc_id"], frame["text"]):
                shingles = shingle_set(value, words, size)
                regs = registers(shingles, a, b) if len(shingles) else np.zeros(0, np.uint16)
                key = xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None
                banded = [xxhash.xxh3_64_intdigest(regs[k * rows:(k + 1) * rows].tobytes(), seed=k) - (1 << 63) for k in range(bands if len(regs) else 0)]
                out.append((i, len(shingles), key, banded))
            frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_key", "buckets"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    sketched = materialise(ids.mapInPandas(sketches, "doc_id long, n_shingles long, set_key binary, buckets array<long>"), "sketches")
    full = sketched.where("set_key is not null and doc_id is not null")
    first = materialise(full.groupBy("set_key").agg(F.min("doc_id").alias("first")), "sets")
    buckets = full.join(first, "set_key").where("doc_id = first").select(F.col("doc_id").alias("id"), F.explode("buckets").alias("bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("bucket", "least")
    members = materialise(buckets.join(shared, "bucket"), "members")

    screen = Screen(members.select("id").distinct(), 26)

    def bodies(frames):
        words, (a, b) = Words(), multipliers(m, seed)
        for frame in frames:
            frame = frame[screen.passes(frame["doc_id"].to_numpy(np.int64))]
            sets = [shingle_set(t, words, size) for t in frame["text"]]
            keep = [len(s) > 0 for s in sets]
            sets = [s for s in sets if len(s)]
            if sets:
                yield pd.DataFrame({"id": frame["doc_id"][keep], "n": [len(s) for s in sets], "regs": [registers(s, a, b).tobytes() for s in sets],
                                    "grams": [s.astype("<u8").tobytes() for s in sets]})

    body = materialise(ids.where("doc_id is not null").mapInPandas(bodies, "id long, n long, regs binary, grams binary"), "bodies")
    nearest = members.where("id <> least").groupBy("id").agg(F.min("least").alias("a")).select("a", F.col("id").alias("b"))
    links = materialise(_verify(nearest, body, percent, margin), "links")
    # Rows that share an id are one document, whatever their sets.
    twins = full.join(first, "set_key").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    groups = components(links)
    named = members.join(groups, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    open_ids = materialise(named.join(mixed, "bucket").select("id", "component").distinct(), "open")
    open_bodies = materialise(body.join(open_ids.select("id"), "id"), "open_bodies")
    more = _verify(materialise(_across(open_bodies, open_ids, percent), "pairs"), open_bodies, percent, margin)
    groups = materialise(components(links.unionByName(more).unionByName(_shared_ids(twins, full))), "components")
    found = sketched.join(first, "set_key", "left").join(groups.withColumnRenamed("id", "first"), "first", "left")
    component = F.coalesce("component", "first", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _shared_ids(twins: DataFrame, full: DataFrame) -> DataFrame:
    """Links through ids that stand with several sets: each such id with the first id of each of its sets."""
    several = full.groupBy("doc_id").agg(F.count_distinct("set_key").alias("n")).where("n > 1").select(F.col("doc_id").alias("b"))
    return twins.join(several, "b", "left_semi").select("a", "b")


def first_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 5, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns; of rows that share an id, one.

    Rows without an id stay."""
    found = near_duplicates(docs, doc, text, size, **options)
    dropped = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias(doc)).distinct()
    named = docs.where(F.col(f"`{doc}`").isNotNull()).join(dropped, doc, "left_anti").dropDuplicates([doc])
    return named.unionByName(docs.where(F.col(f"`{doc}`").isNull()))
