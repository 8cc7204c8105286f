"""Text expressions: compaction, sentences, chunks and tokens, all inside one row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.fixed import PROSE_LETTERS, PROSE_WORDS, TOKEN_STOP_WORDS

# Unicode white space, spelled out so that every regular-expression dialect agrees on it.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def compact_text(text: Column) -> Column:
    """Unix line ends, at most one blank line in a row, no outer white space."""
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return strip(F.regexp_replace(unix, r"\n{3,}", "\n\n"))


def normalise_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda word: word != "")


def is_prose(text: Column) -> Column:
    """At least five words and 60 % letters; expects stripped text."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    # One run of white space less than words: looked for from the start, and no further than they reach.
    solid = f"[^{SPACE[1:]}++"
    enough_words = text.rlike(SPACE + f"{solid}{SPACE}++" * (PROSE_WORDS - 3) + solid + SPACE)
    return (text != "") & enough_words & (letters / F.greatest(F.length(text), F.lit(1)) >= PROSE_LETTERS)


def raw_sentences(text: Column, compacted: bool = False) -> Column:
    """Pieces after each full stop, exclamation or question mark followed by white space."""
    # The text is stripped and separators take whole runs of white space, so no piece needs stripping.
    return F.split(text if compacted else compact_text(text), rf"(?<=[.!?]){SPACE}+")


def sentence_split(text: Column, compacted: bool = False) -> Column:
    return F.filter(raw_sentences(text, compacted), lambda s: s.rlike(r"[\p{L}\p{N}_]"))


def clean_sentences(text: Column, compacted: bool = False) -> Column:
    return F.filter(raw_sentences(text, compacted), is_prose)


def pack_sentences(sentences: Column, size: int) -> Column:
    """Greedy chunks of whole sentences: array of sentence arrays of about ``size`` characters."""
    start = F.struct(
        F.array().cast("array<array<string>>").alias("done"),
        F.array().cast("array<string>").alias("current"),
        F.lit(0).alias("length"),
    )

    def step(state: Column, sentence: Column) -> Column:
        full = (F.size(state["current"]) > 0) & (state["length"] + F.length(sentence) > size)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["current"]))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(sentence)).otherwise(F.concat(state["current"], F.array(sentence))).alias("current"),
            (F.when(full, 0).otherwise(state["length"]) + F.length(sentence)).alias("length"),
        )

    def finish(state: Column) -> Column:
        last = F.when(F.size(state["current"]) > 0, F.array(state["current"]))
        return F.concat(state["done"], F.coalesce(last, F.array().cast("array<array<string>>")))

    return F.aggregate(sentences, start, step, finish)


def chunk_text(text: Column, size: int, compacted: bool = False) -> Column:
    """Chunk texts; a text without any sentence is one chunk, an empty text has none."""
    whole = text if compacted else compact_text(text)
    packed = F.transform(pack_sentences(sentence_split(whole, True), size), lambda chunk: F.array_join(chunk, " "))
    any_word = whole.rlike(r"[\p{L}\p{N}_]")
    return F.when(any_word, packed).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def chunk_count(text: Column, size: int, compacted: bool = False) -> Column:
    """Number of chunks, folded over sentence lengths only."""
    whole = text if compacted else compact_text(text)
    start = F.struct(F.lit(0).alias("chunks"), F.lit(0).alias("length"))

    def step(state: Column, sentence: Column) -> Column:
        full = (state["chunks"] == 0) | ((state["length"] + F.length(sentence)) > size)
        return F.struct(
            (state["chunks"] + F.when(full, 1).otherwise(0)).alias("chunks"),
            (F.when(full, 0).otherwise(state["length"]) + F.length(sentence)).alias("length"),
        )

    folded = F.aggregate(sentence_split(whole, True), start, step, lambda state: state["chunks"])
    return F.greatest(folded, (whole != "").cast("int"))


def tokenise(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_\-']*"), F.lit(0))


def filtered_tokens(text: Column, stop_words: list[str] = TOKEN_STOP_WORDS) -> Column:
    lowered = F.transform(tokenise(text), F.lower)
    return F.filter(lowered, lambda t: (F.length(t) > 2) & ~t.isin(stop_words))


def keyword_tokens(text: Column, stop_words: list[str]) -> Column:
    """Lower-case words of three or more letters, hyphens or apostrophes, without stop words."""
    word = r"[\p{L}\p{N}_]"
    boundary = rf"(?:(?<=[a-z])(?!{word})|(?<=[\-'])(?={word}))"
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!{word})[a-z][a-z\-']{{2,}}{boundary}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop_words))


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by each neighbouring pair."""
    pairs = F.when(
        F.size(tokens) > 1,
        F.zip_with(
            F.slice(tokens, F.lit(1), F.size(tokens) - 1),
            F.slice(tokens, F.lit(2), F.size(tokens) - 1),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, pairs)


def exploded(df: DataFrame, keys: list, array: Column, position: str, name: str) -> DataFrame:
    """One row per array element.

    The outer form keeps the optimizer from adding a "not empty" filter, which would evaluate the array's text
    expressions a second time, and before any shuffle that spreads them.
    """
    return df.select(*keys, F.posexplode_outer(array).alias(position, name)).where(F.col(position).isNotNull())


def inlined(df: DataFrame, keys: list, structs: Column, field: str) -> DataFrame:
    """One row per struct of an array; ``field`` is a struct field that is never null."""
    return df.select(*keys, F.inline_outer(structs)).where(F.col(field).isNotNull())
