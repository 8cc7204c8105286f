"""Document statistics, sentences, chunks, prose lines and entities."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.fixed import KEYWORD_CHUNK, SUMMARY_CHUNK
from gleaner.functions.storage import materialise, spread
from gleaner.functions.text import (
    LINE_BREAK, chunk_count, chunk_text, clean_sentences, compact_text, exploded, filtered_tokens, inlined, is_prose, raw_sentences, strip, tokenise, words,
)

# Patterns of the built-in entity extractor.
ENTITY_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "URL": r"https?://[^\x00-\x20<>\"']+",
    "MONEY": r"[$€£] ?[0-9][0-9,]*(?:\.[0-9]+)?",
    "PERCENT": r"[0-9]+(?:\.[0-9]+)? ?%",
    "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "NAME": r"[A-Z][a-z]+(?: [A-Z][a-z]+)+",
}


# Column of clean sentences that prepared documents carry, and what is written of it: a flag for each piece of the text.
SENTENCES, PROSE = "clean_sentences", "prose_pieces"


def prepare_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Compact text and clean sentences per document, so that several operators judge the pieces of a text only once.

    Written are the texts, and for each piece whether it is a clean sentence: the sentences themselves would take as much room again."""
    compacted = spread(docs.select(key, text), key).withColumn(text, compact_text(F.col(text)))
    pieces = raw_sentences(F.col(text), compacted=True)
    kept = materialise(compacted.withColumn(PROSE, F.transform(pieces, is_prose)), "documents", "zstd")
    return kept.withColumn(SENTENCES, F.filter(pieces, lambda _, i: F.get(F.col(PROSE), i))).drop(PROSE)


def sentences_of(docs: DataFrame, text: str) -> Column:
    return F.col(SENTENCES) if SENTENCES in docs.columns else clean_sentences(F.col(text))


def sentence_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per clean sentence, numbered within its document."""
    return exploded(docs, [key], sentences_of(docs, text), "pos", "sentence")


def text_chunks(docs: DataFrame, key: str, text: str, size: int = KEYWORD_CHUNK) -> DataFrame:
    compacted = docs.select(key, compact_text(F.col(text)).alias("body"))
    return exploded(compacted, [key], chunk_text(F.col("body"), size, compacted=True), "chunk", "body")


def clean_lines(docs: DataFrame, key: str, text: str, page: str | None = None) -> DataFrame:
    """Prose lines of each page joined by blanks, pages joined by a blank line; no row without any."""
    lines = F.filter(F.transform(F.split(F.col(text), LINE_BREAK), strip), is_prose)
    keys = [key] if page is None else [key, page]
    kept = docs.select(*keys, lines.alias("lines"))
    # A page without prose lines becomes no row at all; see ``exploded`` for why this is not a filter.
    pages = exploded(
        kept, keys, F.when(F.size("lines") > 0, F.array(F.array_join("lines", " "))), "at", "body").drop("at")
    if page is None:
        return pages.select(key, compact_text(F.col("body")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct(page, "body")))
    joined = F.array_join(F.transform(ordered, lambda p: p["body"]), "\n\n")
    return pages.groupBy(key).agg(compact_text(joined).alias("text"))


def text_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Word, sentence, token and chunk counts per document; ``readable`` is false without a clean sentence."""
    body = F.col("clean_text")
    carried = [SENTENCES] if SENTENCES in docs.columns else []
    compacted = docs.select(key, compact_text(F.col(text)).alias("clean_text"), *carried)
    clean = F.col(SENTENCES) if carried else clean_sentences(body, compacted=True)
    return compacted.select(
        key, F.length(body).alias("char_count"), F.size(words(body)).alias("word_count"),
        F.size(clean).alias("sentence_count"), F.size(tokenise(body)).alias("token_count"),
        F.size(filtered_tokens(body)).alias("filtered_token_count"),
        chunk_count(body, SUMMARY_CHUNK, compacted=True).alias("chunk_count"),
    ).withColumn("readable", F.col("sentence_count") > 0)


def pattern_entities(text: Column) -> Column:
    """Default extractor: every match of the entity patterns as an array of (text, label)."""
    def matches(label: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda t: F.struct(compact_text(t).alias("text"), F.lit(label).alias("label")))

    return F.flatten(F.array(*[matches(label, pattern) for label, pattern in ENTITY_PATTERNS.items()]))


def entity_counts(
    docs: DataFrame, keys: list[str], text: str, top: int = 20, extractor: Callable[[Column], Column] = pattern_entities
) -> DataFrame:
    """Most frequent entities per group of ``keys`` (none: the whole corpus).

    ``extractor`` maps a text column to an array of (text, label) structs and may wrap a language model.
    Mentions are counted before they are shuffled, and ranking keeps ``top`` rows per group in every task first.
    """
    mentions = inlined(docs, keys, extractor(F.col(text)), "label").where(F.length("text") >= 2)
    counted = mentions.groupBy(*keys, "text", "label").agg(F.count(F.lit(1)).alias("count"))
    ranking = Window.partitionBy(*keys).orderBy(F.desc("count"), "text", "label")
    return counted.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= top)
