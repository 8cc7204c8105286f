"""Word lists, thresholds and formats that decide results."""

# Words dropped from token lists.
TOKEN_STOP_WORDS = (
    "a an and are as at be by for from has in is it of on or that the to was were will with"
).split()

# Words that signal a direction in a sentence.
UP_WORDS = "increase increased increasing rise rising growth higher up surge surging gain gained".split()
DOWN_WORDS = "decrease decreased decline declining drop dropping lower down fall falling loss reduced".split()

# English stop words dropped before keyword n-grams (the list Spark ML ships).
KEYWORD_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now "
    "i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're "
    "they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't "
    "won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
).split()

# Cell texts that count as missing when a CSV is read.
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# File kinds by extension.
FILE_KINDS = {"csv": "csv", "xlsx": "excel", "xls": "excel", "pdf": "pdf", "txt": "txt"}

# Accepted timestamp shapes (regular expression, Spark pattern).
TIMESTAMP_SHAPES = [
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}", "yyyy-MM-dd HH:mm"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}", "yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,6}", "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}", "M/d/yyyy H:mm"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}", "M/d/yyyy H:mm:ss"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])", "yyyyMMdd"),
    (r"\d{4}-\d{2}", "yyyy-MM"),
]
# A date whose day and month may come in either order, with dots or dashes as well.
EITHER_ORDER = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?= |$)"
# The offset behind a time of day, Z or hours and minutes; such times are told in UTC.
OFFSET_SHAPE = r"(?<=:\d{2}|\.\d{1,6})\s?(Z|[+-]\d{2}:?\d{2})$"
NUMBER_SHAPE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"

# Limits and thresholds.
KEYWORD_CHUNK = 4_000
SUMMARY_CHUNK = 4_500
SUMMARY_CHUNKS = 12
KEYWORD_VOCABULARY = 500
DATETIME_SHARE = 0.70
LOOSE_SHARE = 0.50
PROSE_WORDS = 5
PROSE_LETTERS = 0.60
GROUP_CARDINALITY = 40
Z_LIMIT = 3.0
FOREST_TREES = 200
FOREST_SAMPLE = 256
FOREST_SHARE = 0.05
MATCH_THRESHOLD = 0.45
ENTITY_IMPORTANCE = 0.40
TITLE_SIMILARITY = 0.72
DESCRIPTION_OVERLAP = 0.55

# Messages where outliers can't be looked for.
NO_NUMBERS = "No numeric columns are available for anomaly detection."
FEW_NUMBERS = "Not enough numeric rows are available for anomaly detection."

# Messages for rejected files.
REJECT_EMPTY = "The uploaded file is empty."
REJECT_ROWS = "The CSV file contains no usable rows."
REJECT_TEXT = "The text file is empty after decoding."
REJECT_SIZE = "The uploaded file exceeds the 10MB size limit."
REJECT_KIND = "Unsupported file type. Please upload CSV, Excel, PDF, or TXT."


def depth_limits(depth: int) -> dict[str, int]:
    """List sizes for an insight depth of 1 to 5."""
    return {
        "keywords": max(8, 4 * depth),
        "summary_sentences": min(5, max(2, depth + 1)),
        "group_tables": max(1, depth),
        "data": max(4, 3 * depth),
        "data_ranked": max(6, 3 * depth),
        "topics": max(4, 2 * depth),
        "text": max(3, 2 * depth),
        "text_ranked": max(4, 2 * depth),
        "fusion": max(3, 2 * depth),
        "global": max(8, 3 * depth),
    }
