"""Near-duplicate texts of a corpus by overlap of their distinct words: the better one of two stays."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.columns import literal_rows, named
from gleaner.functions.fixed import DESCRIPTION_OVERLAP
from gleaner.functions.storage import materialise

#: Counters by which words are ordered from rare to common. Any order gives the same links; a good one gives few candidates.
COUNTERS = 1 << 18
#: Best texts that are compared with all others in the first round, and by how much later rounds have more.
LEAD, GROWTH = 512, 32
#: Words and texts of one block. Pairs are looked for between two blocks at a time, in memory; hits of so many shared words are held at once.
BLOCK_WORDS, BLOCK_TEXTS, HITS = 2_000_000, 16_384, 1_000_000


def distinct_words(text: Column) -> Column:
    """The distinct words of a text in lower case, parted by white space."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\s+")), lambda w: w != "")


def _rarity(nodes: DataFrame) -> np.ndarray:
    """How often the words of each counter stand in the sets."""
    def counted(frames):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for frame in frames:
            if len(frame):
                total += np.bincount(np.concatenate(frame["tokens"].to_numpy()) % COUNTERS, minlength=COUNTERS)
        place = np.flatnonzero(total)
        yield pd.DataFrame({"place": place, "count": total[place]})

    counts = nodes.select("tokens").mapInPandas(counted, "place long, count long").groupBy("place").agg(F.sum("count").alias("count")).toPandas()  # one row for each counter
    rarity = np.zeros(COUNTERS, dtype=np.int64)
    rarity[counts["place"]] = counts["count"]
    return rarity


def _prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """A row for each of the rarest words of each node (node, best, n, reach, token, at), ``reach`` of them.

    Two sets of which the larger one shares more than ``percent`` % have a word in common among these: had they none, at most
    ``percent`` % of either were left to share."""
    sent = nodes.sparkSession.sparkContext.broadcast(_rarity(nodes))

    @F.pandas_udf("array<long>")
    def rarest(tokens: pd.Series) -> pd.Series:
        out = []
        for t in tokens:
            t = np.asarray(t, dtype=np.int64)
            out.append(t[np.lexsort((t, sent.value[t % COUNTERS]))][:len(t) - percent * len(t) // 100])
        return pd.Series(out, dtype=object)

    first = nodes.select("node", "best", F.size("tokens").alias("n"), rarest("tokens").alias("prefix"))
    return first.select("node", "best", "n", F.size("prefix").alias("reach"), F.posexplode("prefix").alias("at", "token"))


def _candidates(probes: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Pairs of a probe and a worse node that share a word of their prefixes and could share enough after it.

    With ``_links`` the plain form, as joins, of what ``_pairs`` finds between blocks; tests hold one against the other."""
    p, d = probes.alias("p"), live.alias("d")
    larger = F.greatest("p.n", "d.n")
    left = F.least(F.col("p.n") - F.col("p.at"), F.col("d.n") - F.col("d.at"))
    return p.join(d, F.col("p.token") == F.col("d.token")).where(
        (F.col("p.best") < F.col("d.best")) & (100 * F.least("p.n", "d.n") > percent * larger) & (100 * left > percent * larger)).select(
            F.col("p.node").alias("better"), F.col("d.node").alias("worse")).distinct()


def _places(size: int) -> int:
    return max(64, 1 << (4 * size - 1).bit_length())


def _marks(tokens: np.ndarray, places: int) -> np.ndarray:
    """One bit for each place: whether an odd number of the tokens fall on it. Two sets differ in at least as many tokens as these in bits."""
    return np.packbits(np.bincount((tokens & (places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1, bitorder="little")


@F.pandas_udf(T.BinaryType())
def _signature(tokens: pd.Series) -> pd.Series:
    """``_marks`` of each set on the power of two places that is 4 to 8 times its size, 64 at least."""
    sets = [np.asarray(t, dtype=np.int64) for t in tokens]
    return pd.Series([_marks(t, _places(len(t))).tobytes() for t in sets], dtype=object)


class _Signatures:
    """The signatures of one side of a cell by node: a matrix for each length, which also holds the next longer ones folded in half."""

    def __init__(self, nodes: list[np.ndarray], sizes: list[np.ndarray], bits: list[bytes]):
        nodes, sizes = np.concatenate(nodes), np.concatenate(sizes)
        order = np.argsort(nodes)
        self.nodes, self.sizes = nodes[order], sizes[order]
        widths = np.array([len(b) for b in bits], dtype=np.int64)
        self.widths, self.at, self.rows = widths[order], {}, {}
        for w in np.unique(np.concatenate([widths, np.maximum(widths // 2, 8)])).tolist():
            own, longer = np.flatnonzero(widths == w), np.flatnonzero(widths == 2 * w)
            whole = lambda which, n: np.frombuffer(b"".join(bits[i] for i in which), dtype=np.uint64).reshape(len(which), n // 8)
            long = whole(longer, 2 * w)
            self.rows[w] = np.concatenate([whole(own, w), long[:, :w // 8] ^ long[:, w // 8:]])
            place = np.full(len(nodes), -1)
            place[own], place[longer] = np.arange(len(own)), len(own) + np.arange(len(longer))
            self.at[w] = place[order]


def _may_link(better: _Signatures, worse: _Signatures, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the signatures leave room for an overlap of more than ``percent`` % of the larger set: no linked pair is refused."""
    i, j = np.searchsorted(better.nodes, a), np.searchsorted(worse.nodes, b)
    width = np.minimum(better.widths[i], worse.widths[j])
    differing = np.zeros(len(a), dtype=np.int64)
    for w in np.unique(width).tolist():
        of = np.flatnonzero(width == w)
        # Sizes of candidates are too near for signatures of more than twice the length; where they are not, nothing is refused.
        of = of[(better.widths[i[of]] <= 2 * w) & (worse.widths[j[of]] <= 2 * w)]
        if len(of):
            x, y = better.rows[w][better.at[w][i[of]]], worse.rows[w][worse.at[w][j[of]]]
            differing[of] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    n, m = better.sizes[i], worse.sizes[j]
    return 50 * (n + m - differing) > percent * np.maximum(n, m)


#: Blocks that nodes are dealt to, and nodes in one block: a cell checks the pairs of two blocks and holds their signatures only.
BLOCKS, BLOCK = 8, 200_000


def _promising(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures leave room for enough overlap. A pair travels as two numbers to the cell of its blocks, where the
    signatures of both blocks are; a signature is a fortieth to an eightieth of its set in size and goes to the cells of its block."""
    blocks = max(BLOCKS, -(-signatures.count() // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    cells = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.array(
        F.struct((F.col("block") * blocks + k).alias("cell"), F.lit(0).alias("kind")), F.struct((k * blocks + F.col("block")).alias("cell"), F.lit(1).alias("kind"))))))
    sides = signatures.withColumn("block", block("node")).select(cells.alias("to"), F.col("node").alias("better"), F.col("n").cast("long").alias("worse"), "bits") \
        .select("to.cell", "to.kind", "better", "worse", "bits")
    asked = pairs.select((block("better") * blocks + block("worse")).alias("cell"), F.lit(2).alias("kind"), "better", "worse", F.lit(None).cast("binary").alias("bits"))
    cores = sides.sparkSession.sparkContext.defaultParallelism

    def checked(frames):
        cell, held, ready = None, None, None
        for frame in frames:
            for (at, kind), rows in frame.groupby(["cell", "kind"], sort=True):
                if at != cell:
                    cell, held, ready = at, {0: ([], [], []), 1: ([], [], [])}, None
                if kind < 2:
                    for to, c in zip(held[kind], ("better", "worse")):
                        to.append(rows[c].to_numpy(np.int64))
                    held[kind][2].extend(rows["bits"])
                else:
                    if ready is None:
                        ready, held = [_Signatures(*held[k]) for k in (0, 1)], None
                    a, b = rows["better"].to_numpy(np.int64), rows["worse"].to_numpy(np.int64)
                    stay = _may_link(*ready, a, b, percent)
                    yield pd.DataFrame({"better": a[stay], "worse": b[stay]})

    return sides.unionByName(asked).repartition(max(cores, blocks * blocks), "cell").sortWithinPartitions("cell", "kind").mapInPandas(checked, "better long, worse long")


def _links(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose overlap is more than ``percent`` % of the larger set. Whole sets are only joined to the promising ones."""
    pairs = materialise(_promising(pairs, nodes.select("node", F.size("tokens").alias("n"), "bits"), percent), "promising")
    sets = lambda side: nodes.select(F.col("node").alias(side), F.col("tokens").alias(f"{side}_tokens"))
    both = pairs.join(sets("better"), "better").join(sets("worse"), "worse")
    shared = F.size(F.array_intersect("better_tokens", "worse_tokens"))
    return both.where(100 * shared > percent * F.greatest(F.size("better_tokens"), F.size("worse_tokens"))).select("better", "worse")


#: Parquet settings by which each block is a row group: a reader holds whole groups, and tasks share out groups.
EACH_ROW = {"parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
BLOCK_ROW = "block long, nodes binary, sizes binary, tokens binary, sorted binary, bits binary"


def _packed(sets: DataFrame, rarity, percent: int, wanted) -> DataFrame:
    """Blocks of whole sets (node, tokens) of the ``wanted`` nodes: their words from rare to common, the order of their prefixes by word, and signatures.

    Rows stay in the tasks that read them, so no set is shuffled."""
    def block(nodes: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
        sizes, tokens = np.array([len(t) for t in sets]), np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), sizes)
        tokens = tokens[np.lexsort((tokens, rarity.value[tokens % COUNTERS], of))]
        bits = b"".join(_marks(t, _places(len(t))).tobytes() for t in sets)
        first = np.flatnonzero(np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(sizes - percent * sizes // 100, sizes))
        return pd.DataFrame({"block": [nodes[0]], "nodes": [np.array(nodes, np.int64).tobytes()], "sizes": [sizes.astype(np.int32).tobytes()], "tokens": [tokens.tobytes()],
                             "sorted": [first[np.argsort(tokens[first], kind="stable")].astype(np.int32).tobytes()], "bits": [bits]})

    def packed(frames):
        nodes, sets, words = [], [], 0
        for frame in frames:
            frame = frame[_in(wanted.value, frame["node"].to_numpy(np.int64))]
            for node, tokens in zip(frame["node"], frame["tokens"]):
                if words + len(tokens) > BLOCK_WORDS or len(nodes) == BLOCK_TEXTS:
                    if nodes:
                        yield block(nodes, sets)
                    nodes, sets, words = [], [], 0
                nodes.append(node)
                sets.append(np.array(tokens, dtype=np.int64))
                words += len(tokens)
        if nodes:
            yield block(nodes, sets)

    return sets.select("node", "tokens").mapInPandas(packed, BLOCK_ROW)


class _Block:
    """The wanted sets of a block."""

    def __init__(self, row, percent: int, wanted: bytes):
        self.nodes = np.frombuffer(row["nodes"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        self.tokens, order, bits = np.frombuffer(row["tokens"], np.int64), np.frombuffer(row["sorted"], np.int32), row["bits"]
        self.ends = np.cumsum(self.sizes)
        self.live = _in(wanted, self.nodes)
        of = np.repeat(np.arange(len(self.nodes), dtype=np.int32), self.sizes)
        order = order[self.live[of[order]]]
        self.of, words = of[order], self.tokens[order]
        # In hundredths: the words of the set from here on, and how many of them another set must share.
        self.left = (100 * (self.ends[self.of] - order)).astype(np.int32)
        self.needs = (percent * self.sizes[self.of]).astype(np.int32)
        self.starts = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
        self.words = words[self.starts]
        self.counts = np.diff(np.append(self.starts, len(words)))
        widths = [_places(n) // 8 for n in self.sizes.tolist()]
        at = np.append(0, np.cumsum(widths)).tolist()
        self.signatures = _Signatures([np.arange(len(self.nodes))], [self.sizes], [bits[i:j] for i, j in zip(at, at[1:])])

    def set(self, i: int) -> np.ndarray:
        return self.tokens[self.ends[i] - self.sizes[i]:self.ends[i]]


def _linked(one: _Block, two: _Block, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of both blocks whose overlap is more than ``percent`` % of the larger set. They share a word of their prefixes; signatures
    refuse most of those that do, and the rest is compared whole."""
    _, i, j = np.intersect1d(one.words, two.words, assume_unique=True, return_indices=True)
    # A row of ``one`` for each text that holds a shared word, and the rows of ``two`` that it meets there.
    n = one.counts[i]
    rows = np.repeat(one.starts[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
    starts, counts = np.repeat(two.starts[j], n), np.repeat(two.counts[j], n)
    met = np.zeros(len(one.nodes) * len(two.nodes), dtype=bool)
    upto = np.cumsum(counts)
    at = 0
    while at < len(rows):
        # So many rows as meet about HITS, or one.
        to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HITS, "right")), at + 1)
        x, c = rows[at:to], counts[at:to]
        y = np.repeat(starts[at:to] - np.cumsum(c) + c, c) + np.arange(c.sum())
        able = (np.repeat(one.left[x], c) > two.needs[y]) & (two.left[y] > np.repeat(one.needs[x], c))
        met[np.repeat(one.of[x].astype(np.int64) * len(two.nodes), c)[able] + two.of[y[able]]] = True
        at = to
    met = np.flatnonzero(met)
    found = []
    for lo in range(0, len(met), 100_000):
        p, q = np.divmod(met[lo:lo + 100_000], len(two.nodes))
        if one is two:
            p, q = p[p < q], q[p < q]
        near = _may_link(one.signatures, two.signatures, p, q, percent)
        found += [(p, q) for p, q in zip(p[near].tolist(), q[near].tolist())
                  if 100 * len(np.intersect1d(one.set(p), two.set(q), assume_unique=True)) > percent * max(one.sizes[p], two.sizes[q])]
    p, q = np.array(found, dtype=np.int64).reshape(-1, 2).T
    return one.nodes[p], two.nodes[q]


def _pairs(ones: DataFrame, twos: DataFrame, condition: Column, percent: int, wanted: tuple) -> DataFrame:
    """Linked nodes (a, b) of each pair of blocks. Blocks meet as they are read, so only links are shuffled later."""
    names = [f.split()[0] for f in BLOCK_ROW.split(", ")]

    def found(frames):
        held = None
        for frame in frames:
            for row in frame.to_dict("records"):
                if held is None or held[0] != row["one_block"]:
                    held = row["one_block"], _Block({c: row[f"one_{c}"] for c in names}, percent, wanted[0].value)
                one = held[1]
                same = row["one_block"] == row["two_block"] and row["one_nodes"] == row["two_nodes"]
                two = one if same else _Block({c: row[f"two_{c}"] for c in names}, percent, wanted[1].value)
                a, b = _linked(one, two, percent)
                yield pd.DataFrame({"a": a, "b": b})

    sides = [d.select([F.col(c).alias(f"{side}_{c}") for c in names]) for side, d in (("one", ones), ("two", twos))]
    return sides[0].join(sides[1], condition).mapInPandas(found, "a long, b long")


def _in(field: bytes, nodes: np.ndarray) -> np.ndarray:
    return np.frombuffer(field, np.uint8)[nodes >> 3] >> (nodes & 7).astype(np.uint8) & 1 != 0


#: Low bits of a node's number in one row of the making of a bit field.
FIELD_BITS = 18


def _field(nodes: DataFrame, size: int):
    """A bit for each number below ``size``: whether it is among the nodes. It is broadcast."""
    def packed(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"chunk": frame["chunk"], "field": [np.packbits(np.bincount(np.asarray(low), minlength=1 << FIELD_BITS) > 0, bitorder="little").tobytes() for low in frame["low"]]})

    chunks = nodes.groupBy(F.shiftright("node", FIELD_BITS).alias("chunk")).agg(F.collect_list((F.col("node") % (1 << FIELD_BITS)).cast("int")).alias("low"))
    width = 1 << FIELD_BITS - 3
    field = bytearray(-(-size // (1 << FIELD_BITS)) * width)
    for row in chunks.mapInPandas(packed, "chunk long, field binary").collect():  # a bit for each node
        field[row["chunk"] * width:(row["chunk"] + 1) * width] = row["field"]
    return nodes.sparkSession.sparkContext.broadcast(bytes(field))


def _dense(df: DataFrame, row: str, name: str) -> tuple[DataFrame, int]:
    """Rows with the numbers 0..n-1 for the ``monotonically_increasing_id`` they were written with, and n."""
    part = F.shiftright(row, 33)
    counts = df.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row for each task that wrote
    ends = np.cumsum([r["count"] for r in counts], dtype=np.int64)
    offsets = literal_rows(df.sparkSession, [{"part": r["part"], "offset": int(end) - r["count"]} for r, end in zip(counts, ends)], {"part": "bigint", "offset": "bigint"})
    numbered = df.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn(
        name, F.col("offset") + F.col(row).bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "offset", row)
    return numbered, int(ends[-1]) if len(ends) else 0


def _settle(nodes: DataFrame, links: DataFrame) -> list[DataFrame]:
    """Verdicts (node, stays) in rounds: a node whose better links are all known and gone stays, and what it links to goes."""
    verdicts = []
    while True:
        waiting = links.select(F.col("worse").alias("node")).distinct()
        stays = nodes.where("complete").join(waiting, "node", "left_anti").select("node")
        goes = links.join(stays.withColumnRenamed("node", "better"), "better").select(F.col("worse").alias("node")).distinct()
        verdict = materialise(stays.withColumn("stays", F.lit(True)).unionByName(goes.withColumn("stays", F.lit(False))), "verdict")
        if verdict.isEmpty():
            return verdicts
        verdicts.append(verdict)
        done = verdict.select("node")
        nodes = materialise(nodes.join(done, "node", "left_anti"), "open")
        links = materialise(links.join(done.withColumnRenamed("node", "better"), "better", "left_anti").join(
            done.withColumnRenamed("node", "worse"), "worse", "left_anti"), "links")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", score: str | None = None, overlap: float = DESCRIPTION_OVERLAP,
                    lead: int = LEAD) -> DataFrame:
    """``doc_id``, ``n_words`` (distinct) and ``kept`` for every row of ``docs``.

    Taken from the best score down (none: all alike), ties by id, a text is dropped if a text that is kept shares more than ``overlap``
    (in whole per cent) of the distinct words of the larger of the two with it. That order is never walked through: a text stays
    as soon as no better neighbour of it is undecided, so a round decides all texts at once that don't depend on each other.

    Texts of equal word sets are one node, which stands for its best text. Candidates share a word among the rarest ones of each,
    and are looked for between blocks of whole sets that meet in memory: pairs are never shuffled, and of sets only those of leading texts.
    In each round the ``lead`` best nodes that are left are compared with all others, so a common passage doesn't give all pairs of its
    texts: once one of them is kept, the others are gone. Each round has a greater lead, the last one all nodes.

    Null and empty texts are kept, as are all texts of one id and score if one is; null scores come last and null ids first among equals."""
    percent = round(overlap * 100)
    words = F.array_sort(distinct_words(F.coalesce(named(text).cast("string"), F.lit(""))))
    order = -F.coalesce(named(score).cast("double"), F.lit(float("-inf"))) if score else F.lit(0.0)
    # A generator, as each use of the words would split the text anew.
    told = F.inline(F.transform(F.array(words), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.unhex(F.md5(F.array_join(w, " "))).alias("same"), F.transform(w, lambda t: F.xxhash64(t)).alias("tokens"))))
    rows = docs.select(named(doc).alias("doc_id"), order.alias("order"), told).withColumn("row", F.monotonically_increasing_id())
    rows, size = _dense(materialise(rows, "sets", "zstd"), "row", "node")
    first = rows.where("n_words > 0").groupBy("same").agg(F.min(F.struct("order", "doc_id", "node")).alias("first"))
    placed = first.select("first.*", "same").repartitionByRange("order", "doc_id", "same").sortWithinPartitions("order", "doc_id", "same")
    nodes, count = _dense(materialise(placed.withColumn("row", F.monotonically_increasing_id()), "nodes"), "row", "place")
    live = nodes.select("node", "place")
    kept = live.select("node").limit(0)
    if count:
        sent = docs.sparkSession.sparkContext.broadcast(_rarity(rows.where("n_words > 0")))
        wanted = _field(live, size)
        blocks = materialise(_packed(rows.where("n_words > 0"), sent, percent, wanted), "blocks", "zstd", **EACH_ROW)
    while count:
        last = 4 * lead >= count
        best = live if last else live.where(F.col("place") < lead)
        if last:
            found = _pairs(blocks, blocks, F.col("one_block") <= F.col("two_block"), percent, (wanted, wanted))
        else:
            probe = _field(best, size)
            probes = materialise(_packed(_only(rows, probe).repartition(-(-lead // BLOCK_TEXTS)), sent, percent, probe), "probes", "zstd", **EACH_ROW)
            found = _pairs(probes, blocks, F.lit(True), percent, (probe, wanted))
        found = materialise(found.where("a <> b"), "found")
        placed = found.join(live.toDF("a", "a_place"), "a").join(live.toDF("b", "b_place"), "b")
        ahead = F.col("a_place") < F.col("b_place")
        links = materialise(placed.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("worse")).distinct(), "links")
        verdicts = _settle(best.select("node", F.lit(True).alias("complete")), links)
        for verdict in verdicts:
            kept = kept.unionByName(verdict.where("stays").select("node"))
        if last:
            break
        for verdict in verdicts:
            live = live.join(verdict.select("node"), "node", "left_anti")
        live = materialise(live, "live")
        wanted, lead = _field(live, size), lead * GROWTH
    best = nodes.join(kept, "node", "left_semi").select("same", F.col("order").alias("first_order"), F.col("doc_id").alias("first_id"), F.lit(True).alias("stays"))
    is_best = F.col("first_order").eqNullSafe(F.col("order")) & F.col("first_id").eqNullSafe(F.col("doc_id"))
    return rows.drop("tokens", "node").join(best, "same", "left").select(
        "doc_id", "n_words", ((F.col("n_words") == 0) | (F.col("stays").isNotNull() & is_best)).alias("kept"))


def _only(sets: DataFrame, wanted) -> DataFrame:
    """The sets of the wanted nodes."""
    def some(frames):
        for frame in frames:
            yield frame[_in(wanted.value, frame["node"].to_numpy(np.int64))]

    return sets.where("n_words > 0").select("node", "tokens").mapInPandas(some, "node long, tokens array<long>")
