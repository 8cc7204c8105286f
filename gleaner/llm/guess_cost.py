"""Secret scan: fixed patterns, and values in a credential context whose cheapest guess is dear."""

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise
from gleaner.llm.common import bounded_batches

# Patterns of the base scan, with letters of the keywords in either case.
KEYWORDS = "password", "passwd", "secret", "token", "apikey", "api_key"
ASSIGN = re.compile(
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
KINDS = "assign", "access", "hex", "guess"
# Names before a value that make it a credential, beyond those of the base scan.
CONTEXT_WORDS = ("pass", "pwd", "passphrase", "passcode", "credential", "credentials", "auth", "bearer", "login", "private_key", "access_key",
                 "secret_key", "client_secret", *KEYWORDS)
SIGN, SCHEME = r"[\"']?\x20*[:=]\x20*[\"']?", r"(?:bearer|basic)\x20+"
# A name and a sign, with or without a scheme; a header with a scheme; or "Bearer" before a value that is no plain word. Names of the base
# scan count behind other letters too, as they do there.
CONTEXT = re.compile(
    r"(?:(?:(?<![A-Za-z0-9])(?:" + "|".join(sorted(CONTEXT_WORDS, key=len, reverse=True)) + ")|" + "|".join(KEYWORDS) + f"){SIGN}(?:{SCHEME})?+"
    rf"|(?<![A-Za-z0-9])authorization{SIGN}{SCHEME}"
    r"|(?<![A-Za-z0-9])bearer\x20+(?=[\"']?[^\s\"'<>,;]*(?:\d|(?-i:[a-z][A-Z]))))[\"']?([^\s\"'<>,;]{6,})", re.I | re.A)

# Words that guessers try first, commonest first.
COMMON = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login football baseball princess sunshine shadow "
    "iloveyou abc123 passw0rd hello freedom whatever trustno1 secret changeme default example test user root guest token "
    "key pass demo sample your my the and summer winter spring autumn love god sex money house computer internet server "
    "database system network company office private public account access service manager super batman superman michael "
    "jordan harley ranger hunter killer george charlie thomas daniel andrew joshua jessica ashley nicole michelle amanda").split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
#: Longest word that a segment may be.
LONGEST = 24
# Rows of the keyboard from the top, each key with the one below it to the right, and sequences.
ROWS, SEQUENCES = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"), ("abcdefghijklmnopqrstuvwxyz", "0123456789")
LEET = str.maketrans("013457@$!", "oieastasi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
START_BITS = math.log2(47)


def _steps() -> dict[str, tuple[int, ...]]:
    """Directions in which the second key of a pair lies beside the first: along a row, to the keys above and below, along a sequence."""
    moves: dict[str, list[int]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            for way, (down, right) in enumerate(((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1))):
                if 0 <= r + down < len(ROWS) and 0 <= c + right < len(ROWS[r + down]):
                    moves.setdefault(key + ROWS[r + down][c + right], []).append(way)
    for line in SEQUENCES:
        for x, y in zip(line, line[1:]):
            moves.setdefault(x + y, []).append(6)
            moves.setdefault(y + x, []).append(7)
    return {pair: tuple(ways) for pair, ways in moves.items()}


STEPS = _steps()


def char_bits(c: str) -> float:
    return math.log2(10 if "0" <= c <= "9" else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def _forms(value: str) -> tuple[str, str]:
    """The value in lower case, and with letters for the digits and marks that stand for them."""
    lower = value.lower() if len(value.lower()) == len(value) else value
    return lower, lower.translate(LEET)


def _word_bits(raw: str, lower: str, plain: str, rank: dict[str, int]) -> float:
    """Of a segment that is a ranked word in some casing, with or without digits for letters; else infinite."""
    bits = min((math.log2(rank[word] + 1) + more for word, more in ((lower, 0), (plain, 1)) if word in rank), default=math.inf)
    return bits + (0 if raw == lower else 1 if raw in (raw.upper(), raw.capitalize()) else len(raw) / 2)


def _date_bits(length: int) -> float:
    return 7.0 if length == 4 else 11.0 if length <= 7 else 15.5


def segment_bits(value: str, i: int, j: int, rank: dict[str, int]) -> float:
    """Bits of ``value[i:j]`` as one segment that is no brute force: a word, a date, a repeat or a walk; infinite if it is none."""
    raw, (lower, plain) = value[i:j], (f[i:j] for f in _forms(value))
    bits = _word_bits(raw, lower, plain, rank) if 2 <= j - i <= LONGEST else math.inf
    if DATE.fullmatch(raw):
        bits = min(bits, _date_bits(j - i))
    if j - i >= 3:
        if len(set(raw)) == 1:
            bits = min(bits, char_bits(raw[0]) + math.log2(j - i))
        ways = [set(STEPS.get(lower[k:k + 2], ())) for k in range(j - i - 1)]
        if set.intersection(*ways):
            bits = min(bits, START_BITS + math.log2(j - i))
    return bits


def guess_bits(value: str, rank: dict[str, int] = RANK) -> float:
    """log2 of the guesses that the cheapest segmentation of ``value`` needs, the least over all segmentations.

    Segments are ranked words (with case and digits-for-letters variants), dates, repeats of a character, walks that go on in one
    direction over adjacent keys or along a sequence, and single characters by brute force; every segment but a further brute-force
    character costs a bit. A repeat or walk may start and end anywhere in its run."""
    n = len(value)
    lower, plain = _forms(value)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        for m in (DATE.fullmatch(value, i, i + size) for size in (4, 6, 7, 8, 10) if i + size <= n and value[i].isdigit()):
            if m:
                dates.setdefault(m.end(), []).append(m.start())
    best, brute = np.full(n + 1, np.inf), math.inf  # brute: the best that ends in brute force
    best[0] = 0.0
    logs = np.log2(np.arange(1, n + 2, dtype=np.float64))  # logs[k - 1]: of length k
    same, walks = 1, {}  # lengths of the repeat and, by direction, of the walks that end here
    for j in range(1, n + 1):
        brute = min(brute, float(best[j - 1]) + 1) + char_bits(value[j - 1])
        options = [brute]
        if j > 1:
            same = same + 1 if value[j - 1] == value[j - 2] else 1
            walks = {way: walks.get(way, 1) + 1 for way in STEPS.get(lower[j - 2:j], ())}
        longest = max(walks.values(), default=1)
        for length, bits in ((same, char_bits(value[j - 1])), (longest, START_BITS)):
            if length >= 3:
                options.append(float((best[j - length:j - 2][::-1] + logs[2:length]).min()) + 1 + bits)
        options += [float(best[i]) + 1 + _date_bits(j - i) for i in dates.get(j, ())]
        for size in range(2, min(LONGEST, j) + 1):
            i = j - size
            if lower[i:j] in rank or plain[i:j] in rank:
                options.append(float(best[i]) + 1 + _word_bits(value[i:j], lower[i:j], plain[i:j], rank))
        best[j] = min(options)
    return float(best[n])


def ranked_words(docs: DataFrame, text: str = "text", most: int = 10_000) -> dict[str, int]:
    """Ranks of the words that guessers try: the fixed ones, then the ``most`` commonest words of the texts, of three letters and more.

    Words are counted where they are read and summed. How many words have about which count tells from which count on they are wanted, so
    that only about ``most`` of them reach the driver, whatever the number of partitions."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text}`").cast("string")), F.lit(r"[a-z]{3,24}"), F.lit(0)))
    level = F.floor(F.log2("count") * 8).cast("int").alias("level")
    counted = materialise(docs.select(words.alias("word")).groupBy("word").count().where("count > 1").withColumn("level", level), "words")
    least, held = 0, 0
    for row in sorted(counted.groupBy("level").agg(F.count("*").alias("n")).collect(), reverse=True):  # at most eight levels for each bit of a count
        least, held = row["level"], held + row["n"]
        if held >= most:
            break
    rank = dict(RANK)
    for row in counted.where(F.col("level") >= least).orderBy(F.desc("count"), "word").limit(most).collect():
        rank.setdefault(row["word"], len(rank) + 1)
    return rank


def scan(text: str, least_bits: float, rank: dict[str, int] = RANK) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, bits) by start, then kind; bits is 0 for spans that a pattern alone finds."""
    spans = []
    lower = text.lower()
    if any(w in lower for w in KEYWORDS):
        spans += [(m.start(), m.end(), "assign", guess_bits(m[1], rank)) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access", 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex", 0.0) for m in HEX.finditer(text)]
    if any(w in lower for w in ("pass", "pwd", "credential", "auth", "bearer", "login", "_key", "secret", "token", "apikey")):
        known = sorted(x[:2] for x in spans)
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            end = start + len(m[1].rstrip(".)]}!?"))
            if end - start >= 6 and not any(a <= start and end <= b for a, b in known) and (bits := guess_bits(text[start:end], rank)) >= least_bits:
                spans.append((start, end, "guess", bits))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_bits: float = 28.0, most_words: int = 10_000) -> DataFrame:
    """``doc_id``, ``secrets`` (array of start, end, kind, bits) for every row, texts scanned whole.

    Offsets count code points. Base kinds are ``assign``, ``access`` and ``hex``; ``guess`` adds values in a credential context
    that no base span holds whole and whose guess cost is at least ``least_bits``, so that placeholders such as ``changeme`` stay. Guessers
    know a fixed list of words and the ``most_words`` commonest words of all the texts.

    Null and empty texts have no span; null ids and repeated rows are kept as they are; an empty table gives no rows; further
    columns are ignored."""
    bounded_batches(docs.sparkSession)
    rank = docs.sparkSession.sparkContext.broadcast(ranked_words(docs, text, most_words))
    spans = "array<struct<start:int,end:int,kind:string,bits:double>>"

    @F.pandas_udf(spans)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "kind", "bits"), s)) for s in scan(t or "", least_bits, rank.value)] for t in texts])

    return docs.select(F.col(f"`{doc}`").alias("doc_id"), found(F.col(f"`{text}`")).alias("secrets"))


def digest_columns(docs: DataFrame, **options) -> DataFrame:
    """Counts, base digest and span list of :func:`find_secrets`."""
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return find_secrets(docs, **options).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("secrets")).alias("spans"), F.array_max(F.transform("secrets", lambda s: s["bits"])).alias("most_bits"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", least_bits: float = 28.0, most_words: int = 10_000) -> DataFrame:
    """``docs`` with every secret of the text column (of assignments, the value) replaced by ``mark``; other texts and columns stay as they are."""

    bounded_batches(docs.sparkSession)
    rank = docs.sparkSession.sparkContext.broadcast(ranked_words(docs, text, most_words))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, least_bits, mark, rank.value) for t in texts], dtype=object)

    return docs.withColumn(text, cleaned(F.col(f"`{text}`")))


def _cut(text, least_bits: float, mark: str, rank: dict[str, int]):
    spans = scan(text, least_bits, rank) if text else []
    parts, at = [], 0
    # Of assignments the name stays; spans that overlap are cut as one.
    for start, end in sorted((ASSIGN.match(text, s[0]).start(1) if s[2] == "assign" else s[0], s[1]) for s in spans):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:] if spans else text

