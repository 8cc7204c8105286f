"""Benchmark decontamination by template windows: numbers, names and units become typed placeholders."""

import re
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise
from gleaner.llm.common import Screen, bounded_batches

PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”‘’…"
ENDS = (".", "!", "?", ":", ".\"", "!\"", "?\"")
NUMBER = re.compile(r"[$€£]?[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th|%)?")
# Names of units, which may change along with a number.
UNITS = frozenset((
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees mph kmh meter meters metre metres").split())
# Numbers told in words.
NUMBER_WORDS = frozenset((
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen").split())
#: A number with the unit written behind it without a space.
JOINED = re.compile(r"([$€£]?[+-]?\d+(?:[.,:/]\d+)*)([A-Za-z]{1,12})")
NAME, UNIT, DIGITS = 1, 2, 3
#: Code of a word that stands for two.
TWO = 2
SLOT_HASH = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
LOW = np.uint64((1 << 58) - 1)


class Tokens(dict):
    """Of a raw word: 58 bits of hash, whether a mark stands behind it, kind in two bits, whether it starts with a capital, whether
    a sentence ends behind it; 0 for a word without a letter or digit, and ``TWO`` for a number and unit in one; remembered for the words
    seen lately."""

    def __missing__(self, word):
        if len(self) >= 300_000:
            self.clear()
        # Most words are letters alone, or begin with a letter; only others can be numbers in figures.
        core = word if word.isalpha() else word.strip(PUNCTUATION)
        if not core:
            self[word] = 0
            return 0
        lower, first = core.lower(), core[0]
        kind = 0
        if lower in UNITS:
            kind = UNIT
        elif lower in NUMBER_WORDS:
            kind = DIGITS
        elif not first.isalpha():
            if NUMBER.fullmatch(core):
                kind = DIGITS
            elif (joined := JOINED.fullmatch(core)) and joined[2].lower() in UNITS:
                self[word] = TWO
                return TWO
        elif "-" in lower and NUMBER_WORDS.issuperset(lower.split("-")):
            kind = DIGITS
        hashed = xxhash.xxh3_64_intdigest(lower.encode("utf-8", "surrogatepass")) >> 6 | 1
        self[word] = found = hashed << 5 | (word[-1] in PUNCTUATION) << 4 | kind << 2 | first.isupper() << 1 | (core is not word and word.endswith(ENDS))
        return found


def _hashes(value: np.ndarray, w: int, seed: int) -> np.ndarray:
    hashed = np.full(len(value) - w + 1, seed, dtype=np.uint64)
    for i in range(w):
        hashed = (hashed ^ value[i:len(value) - w + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    return hashed


def words_of(text: str, tokens: Tokens) -> tuple[list[str], np.ndarray]:
    """Words and codes of a text; those without a letter or digit are left out, and a number joined with a unit becomes two."""
    words = text.split()
    codes = np.fromiter(map(tokens.__getitem__, words), dtype=np.uint64, count=len(words))
    if (codes == TWO).any():
        words = [part for w, k in zip(words, codes) for part in (_parted(w) if k == TWO else (w,))]
        codes = np.fromiter(map(tokens.__getitem__, words), dtype=np.uint64, count=len(words))
    if (codes == 0).any():
        keep = codes != 0
        words, codes = [w for w, k in zip(words, keep) if k], codes[keep]
    return words, codes


def _parted(word: str) -> tuple[str, str]:
    at = JOINED.search(word).end(1)
    return word[:at], word[at:]


def windows(codes: np.ndarray, bounds: np.ndarray, sizes: tuple[int, ...], short: bool = False):
    """For each reading and size of window (reading, hashes, first word of each token, kind of each token), over texts laid end to end:
    ``bounds`` has the start of each and the end of the last.

    A capital word is a name: in the first reading unless a sentence starts there, in the second everywhere, in the third nowhere.
    Names in a row, with no mark between them, are one token. A window needs two words that are no placeholder, as slots alone say nothing:
    else its hash is 0 in the first two readings, and that of its plain words in lower case in the third, so that copies always meet.
    Hashes of windows that reach over a bound are 0. ``short`` texts, of fewer words than the largest size, meet such texts only; a text of fewer
    tokens than a size is one window, and stands alone here."""
    bit = lambda i: codes >> np.uint64(i) & np.uint64(1) != 0
    base = (codes >> np.uint64(2) & np.uint64(3)).astype(np.int8)
    plain = codes >> np.uint64(5) & LOW
    starts, apart = np.append(True, bit(0)[:-1]), np.append(True, bit(4)[:-1])
    starts[bounds[:-1]] = apart[bounds[:-1]] = True
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    capital = (base == 0) & bit(1)
    out = []
    for reading, named in enumerate((capital & ~starts, capital, None)):
        if named is None:
            kind, at = base, np.arange(len(codes))
        else:
            at = np.flatnonzero(~named | apart | ~np.append(False, named[:-1]))
            kind = np.where(named, np.int8(NAME), base)[at]
        value = np.where(kind > 0, SLOT_HASH[kind], plain[at])
        told = np.append(0, np.cumsum(kind == 0))
        for w in {min(size, len(at)) for size in sizes}:
            seed = w | reading << 8 | short << 16
            hashed = _hashes(value, w, seed)
            few = told[w:] - told[:-w] < min(2, w)
            if named is not None:
                hashed[few] = 0
            elif few.any():
                hashed = np.where(few, _hashes(plain, w, seed | 1 << 24), hashed)
            hashed[owner[at[:len(hashed)]] != owner[at[w - 1:]]] = 0
            out.append((reading, hashed.view(np.int64), at, kind))
    return out


def _batches(texts: list[str], tokens: Tokens, sizes: tuple[int, ...], most: int = 1 << 18):
    """(places of texts, words, bounds, windows) for texts laid end to end, about ``most`` words at a time; a text that may have fewer tokens than a size is alone."""
    held, words, size = [], [], 0
    for k, text in enumerate(texts):
        held.append(k)
        words.append(text.split())
        size += len(words[-1])
        if size >= most or k == len(texts) - 1:
            yield from _laid(held, words, tokens, sizes)
            held, words, size = [], [], 0


def _laid(places: list[int], split: list[list[str]], tokens: Tokens, sizes: tuple[int, ...]):
    words = [w for own in split for w in own]
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    codes = np.fromiter(map(tokens.__getitem__, words), dtype=np.uint64, count=len(words))
    if (codes == TWO).any():
        owner = np.repeat(np.arange(len(split)), lengths)
        for k in np.unique(owner[codes == TWO]).tolist():  # few texts join a number and a unit
            split[k], _ = words_of(" ".join(split[k]), tokens)
        words = [w for own in split for w in own]
        lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        codes = np.fromiter(map(tokens.__getitem__, words), dtype=np.uint64, count=len(words))
    if (codes == 0).any():
        keep = codes != 0
        lengths = np.bincount(np.repeat(np.arange(len(split)), lengths)[keep], minlength=len(split))
        words, codes = list(compress(words, keep.tolist())), codes[keep]
    bounds = np.append(0, np.cumsum(lengths))
    # Only capital words merge with the one before, so there are at least as many tokens as there are other words.
    others = np.append(0, np.cumsum(codes >> np.uint64(1) & np.uint64(1) == 0))
    many = others[bounds[1:]] - others[bounds[:-1]] >= max(sizes)
    for k in np.flatnonzero(~many & (lengths > 0)).tolist():
        own = codes[bounds[k]:bounds[k + 1]]
        alone = np.array([0, len(own)])
        yield [places[k]], words[bounds[k]:bounds[k + 1]], alone, windows(own, alone, sizes, len(own) < max(sizes))
    if many.all():
        yield places, words, bounds, windows(codes, bounds, sizes)
    elif many.any():
        chosen = np.flatnonzero(many).tolist()
        yield ([places[k] for k in chosen], list(compress(words, np.repeat(many, lengths).tolist())), np.append(0, np.cumsum(lengths[many])),
               windows(codes[np.repeat(many, lengths)], np.append(0, np.cumsum(lengths[many])), sizes))


ROWS = "id long, at int, hash long, reading int, size int, unit long, slots array<string>"


def _units(found, n: int) -> list[np.ndarray]:
    """For each reading of an item, the unit that each of its windows stands for: the third reading's hash at the first word, or at the
    first word of the name that it lies in. Units without a template only count, as 0 otherwise, where no unit has one."""
    places = [at[:len(hashed)] for _, hashed, at, _ in found]
    second, last = found[1], places[1][-1]
    start = second[2][np.searchsorted(second[2], np.minimum(np.arange(n), last), "right") - 1]
    third = found[2][1]
    units = [third[np.minimum(start[p], len(third) - 1)] for p in places]
    told = np.concatenate([u[h != 0] for u, (_, h, _, _) in zip(units[:2], found)])
    return [np.where(np.isin(u, told), u, 0) if len(told) else u for u in units]


def _windows(texts: DataFrame, sizes: tuple[int, ...], screen: Screen | None) -> DataFrame:
    """A row for each template window of (id, text); those that miss the screen are left out. Without one, texts are items."""

    def rows(frames):
        tokens = Tokens()
        for frame in frames:
            out, ids = [], frame["id"].tolist()
            texts = ((k, [t]) for k, t in enumerate(frame["text"])) if screen is None else [(0, frame["text"].tolist())]
            for first_text, some in texts:  # items one by one, as their units need all their windows
                for places, words, bounds, found in _batches(some, tokens, sizes):
                    units = _units(found, len(words)) if screen is None else None
                    for k, (reading, hashed, first, kind) in enumerate(found):
                        keep = hashed != 0
                        keep &= units[k] != 0 if screen is None else screen.passes(hashed)
                        w = len(first) - len(hashed) + 1
                        kept = np.flatnonzero(keep)
                        owners = np.searchsorted(bounds, first[kept], "right") - 1
                        starts = np.searchsorted(first, bounds[:-1]).tolist()  # first token of each text
                        for a, owner in zip(kept.tolist(), owners.tolist()):
                            ends = np.append(first[a + 1:a + w], min(first[a + w], bounds[owner + 1]) if a + w < len(first) else bounds[owner + 1])
                            slots = [f"{kind[j]}" + " ".join(x.strip(PUNCTUATION).lower() for x in words[first[j]:ends[j - a]]) for j in range(a, a + w) if kind[j]]
                            out.append((ids[first_text + places[owner]], a - starts[owner], hashed[a], reading, w, units[k][a] if units else 0, slots))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    return texts.dropna().mapInPandas(rows, ROWS)


def _candidates(seen: DataFrame, asked: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Pairs (doc_id, item_id) that may share ``least`` of the item's units.

    A document that does holds one of any few units of the item, as many as it may lack and one more; the rarest ones among the documents'
    windows are taken, so a window that most documents and items hold brings no pairs together."""
    rarity = seen.groupBy("hash").agg(F.count("*").alias("n"))
    units = asked.select("item_id", "unit", "hash").distinct().join(rarity, "hash", "left").groupBy("item_id", "unit").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("n").asc_nulls_first(), "unit"))
    may_lack = F.col("n_windows") - F.ceil(F.col("n_windows") * least)
    rare = units.withColumn("place", place).join(sizes, "item_id").where(F.col("place") <= may_lack + 1).select("item_id", "unit")
    probes = asked.join(rare, ["item_id", "unit"]).select("item_id", "hash").distinct()
    return seen.select("doc_id", "hash").join(probes, "hash").select("doc_id", "item_id").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
          width: int = 5, least: float = 0.8) -> DataFrame:
    """``doc_id``, ``item_id``, ``coverage``, ``n_windows``, ``changed_slots``: items of which a document holds at least ``least`` of
    the template windows of ``width`` words, in any reading of its capital words, with slots filled consistently.

    Along one alignment of item and document, each value of the item must always stand for the same value of the document
    (the commonest one); windows that break this don't count. ``changed_slots`` counts the values that differ, so 0 is a copy and more is a
    re-parameterised question. Numbers may be in figures or words, with the unit behind them or joined. Windows of all documents meet those of
    all items by a hash join; a fixed bit field screens the documents' windows first, and an item's rarest windows choose the documents that
    its other windows are joined with.

    Null ids and texts and texts without words match nothing; a text or item of fewer than ``width`` words is one window, so short
    ones match only as a whole; repeated rows of a document give one row; repeated item ids are taken as one item; empty tables
    give no rows; further columns are ignored."""
    bounded_batches(docs.sparkSession)
    pick = lambda df, i, t: df.select(F.col(f"`{i}`").cast("long").alias("id"), F.col(f"`{t}`").cast("string").alias("text"))
    asked = materialise(_windows(pick(benchmark, item, item_text), (width,), None), "items").withColumnsRenamed(
        {"id": "item_id", "at": "item_at", "slots": "item_slots"})
    sizes = asked.groupBy("item_id").agg(F.count_distinct("unit").alias("n_windows"))
    # Where names in a row leave an item fewer tokens than `width`, its windows are smaller; there are at most `width` sizes.
    looked_for = tuple({width, *(r["size"] for r in asked.select("size").distinct().collect())})
    asked = asked.drop("size")
    seen = materialise(_windows(pick(docs, doc, text), looked_for, Screen(asked.select("hash"))).select(
        F.col("id").alias("doc_id"), "at", "hash", "slots"), "seen")
    hits = materialise(_candidates(seen, asked, sizes, least).join(asked, "item_id").join(seen, ["doc_id", "hash"]), "hits")
    # Documents that lack too many of an item's windows go before their slots are looked at.
    enough = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("unit").alias("found")).join(sizes, "item_id").where(
        F.col("found") >= F.col("n_windows") * least).select("doc_id", "item_id", "n_windows")
    passage = hits.join(enough, ["doc_id", "item_id"]).withColumn("shift", F.col("at") - F.col("item_at")).dropDuplicates(
        ["doc_id", "item_id", "reading", "shift", "at", "item_at", "unit"])
    alignment = ["doc_id", "item_id", "reading", "shift"]
    filled = passage.select(*alignment, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).groupBy(*alignment, "s").count()
    common = filled.groupBy(*alignment, F.col("s.item_slots").alias("value")).agg(
        F.max_by("s.slots", F.struct("count", "s.slots")).alias("fills")).groupBy(*alignment).agg(F.map_from_entries(
            F.collect_list(F.struct("value", "fills"))).alias("fills"))
    whole = passage.join(common, alignment, "left")
    agrees = F.forall(F.arrays_zip("item_slots", "slots"), lambda s: F.try_element_at("fills", s["item_slots"]) == s["slots"])
    changed = F.filter(F.arrays_zip("item_slots", "slots"), lambda s: s["item_slots"] != s["slots"])
    return whole.where(agrees).groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.count_distinct("unit").alias("found"),
        F.size(F.array_distinct(F.flatten(F.collect_set(changed)))).cast("long").alias("changed_slots")).where(
            F.col("found") >= F.col("n_windows") * least).select(
                "doc_id", "item_id", (F.col("found") / F.col("n_windows")).alias("coverage"), "n_windows", "changed_slots")


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, with all their columns; rows without an id stay."""
    found = leaks(docs, benchmark, doc=doc, **options).select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(found, doc, "left_anti")
