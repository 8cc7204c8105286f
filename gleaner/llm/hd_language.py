"""Language of texts by hyperdimensional profiles of letter trigrams."""

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches

SIZE, SYMBOLS, SEED = 512, 96, 11
#: Trigrams whose vectors are held at once.
PART = 8192


@functools.lru_cache(1)
def letter_symbols() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, 1 to 26 for a to z, and hashed ones for other letters."""
    table = np.zeros(0x110000, dtype=np.int32)
    letters = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), dtype=np.int64)
    table[letters] = 27 + (letters * 2654435761 >> 8) % (SYMBOLS - 27)
    table[ord("a"):ord("z") + 1] = np.arange(1, 27)
    return table


@functools.lru_cache(1)
def letter_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Random signs of the letters, and for each pair of letters the product of the first rotated twice and the second once."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.float32), (SYMBOLS, SIZE))
    pairs = (np.roll(letters, 2, axis=1)[:, None] * np.roll(letters, 1, axis=1)[None]).reshape(-1, SIZE)
    return letters, pairs


def trigrams(text: str) -> np.ndarray:
    """Codes of the letter trigrams of a whole text; anything between words counts as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    s = np.zeros(len(points) + 2, dtype=np.int32)
    s[1:-1] = letter_symbols()[points]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    keep[0] = True
    s = s[keep]
    return ((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[s[1:-1] != 0] if len(s) > 2 else s[:0]


def bundle(codes: np.ndarray) -> np.ndarray:
    """Sum of the vectors of all trigrams; a trigram's vector binds its permuted letter vectors."""
    letters, pairs = letter_vectors()
    found, counts = np.unique(codes, return_counts=True)
    total = np.zeros(SIZE, dtype=np.float64)
    for at in range(0, len(found), PART):
        part = found[at:at + PART]
        vectors = pairs[part // SYMBOLS]
        vectors *= letters[part % SYMBOLS]
        total += counts[at:at + PART].astype(np.float32) @ vectors
    return total


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language prototypes: the unit vectors of the bundles of all rows with a language and a text.

    Tasks send one bundle per language and batch; the driver gets ``SIZE`` numbers per language, whatever the input's size.
    Null texts and languages take no part; no rows give no prototype."""

    def sums(frames):
        for frame in frames:
            for name, texts in frame.groupby("lang")["text"]:
                codes = [c for t in texts if len(c := trigrams(t))]
                if codes:
                    yield pd.DataFrame({"lang": name, "place": np.arange(SIZE), "value": np.rint(bundle(np.concatenate(codes))).astype(np.int64)})

    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).dropna()
    summed = rows.mapInPandas(sums, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("bundle")).select("lang", "bundle.value")
    vectors = {r["lang"]: np.array(r["value"], dtype=np.float64) for r in found.collect()}
    return {name: v / norm for name, v in sorted(vectors.items()) if (norm := np.linalg.norm(v)) > 0}


def predict(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """Struct of ``lang_pred`` and ``score`` (cosine with the nearest prototype, 0 at least; ties go to the first name).

    ``und`` and 0 for null texts, texts without a letter, and where nothing was learned."""
    names = list(prototypes)
    table = np.array([prototypes[n] for n in names]) if names else np.zeros((0, SIZE))

    def one(t):
        codes = trigrams(t) if names and t else ()
        if not len(codes):
            return "und", 0.0
        own = bundle(codes)
        near = table @ own / max(np.linalg.norm(own), 1e-9)
        best = int(near.argmax())
        return names[best], float(min(max(near[best], 0.0), 1.0))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    return predicted(text)


def identify(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for every row.

    Rows whose crc32 of the id as text leaves 1 modulo 3 are held out; the prototypes are learned from all others. Null ids are
    not held out; repeated rows are kept; an empty table gives no rows; further columns are ignored."""
    bounded_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col(f"`{doc}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    prototypes = learn(docs.where(~held), text, lang)
    return docs.select(F.col(f"`{doc}`").alias("doc_id"), held.alias("held_out"), predict(F.col(f"`{text}`"), prototypes).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")
