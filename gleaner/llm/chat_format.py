"""Relational chat formatting: collected turn structs, merged and concatenated with Spark expressions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>\n"

# Control strings of common chat templates, and the opening of this template's own marks.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" else "\\" + c for c in text)


def escape(text: Column, controls=CONTROLS) -> Column:
    r"""Doubles backslashes and puts one behind the first character of each control string."""
    starts = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({starts})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", train_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``n_blocks``, ``segments``, ``formatted``.

    Turns are sorted by (turn, role, text); adjacent turns of one role share a block, in which ``NEXT`` parts the texts, so that
    every turn can be read back. ``segments`` holds (text, loss) in order, ``loss`` being true for the texts of ``train_role``
    alone; ``formatted`` is their concatenation.

    Null texts and roles count as empty; a null turn comes first; rows with a null conversation id form one conversation;
    repeated rows are turns of their own; an empty table gives no rows; further columns are ignored. A conversation becomes
    one row, so its own length is the bound of what a task gathers."""
    turn = F.struct(
        F.col(f"`{order}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    gathered = turns.select(F.col(f"`{conv}`").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    # 1-based positions at which a block of one role starts; a block reaches to the next start.
    starts = F.filter(
        F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]))
    marked = gathered.withColumn("starts", starts)
    blocks = F.transform("starts", lambda s, k: F.struct(
        F.element_at("ts", s)["role"].alias("role"),
        F.transform(
            F.slice("ts", s, F.coalesce(F.try_element_at("starts", k + 2), n + 1) - s), lambda t: escape(t["text"])).alias("texts")))
    segment = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))

    def laid_out(block: Column) -> Column:
        loss = block["role"] == train_role
        texts = F.flatten(F.transform(block["texts"], lambda t, k: F.when(
            k == 0, F.array(segment(t, loss))).otherwise(F.array(segment(F.lit(NEXT), F.lit(False)), segment(t, loss)))))
        head = F.array(segment(F.concat(F.lit(START), escape(block["role"]), F.lit(MESSAGE)), F.lit(False)))
        return F.concat(head, texts, F.array(segment(F.lit(END), F.lit(False))))

    laid = marked.select("conv_id", n.cast("long").alias("n_turns"), blocks.alias("blocks")).select(
        "conv_id", "n_turns", F.size("blocks").cast("long").alias("n_blocks"),
        F.flatten(F.transform("blocks", laid_out)).alias("segments"))
    return laid.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted conversation."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, MESSAGE, 1)
        body = F.substring(block, F.char_length(head) + len(MESSAGE) + 1, F.char_length(block) - F.char_length(head) - len(MESSAGE) - len(END))
        return F.transform(F.split(body, _quoted(NEXT)), lambda t: F.struct(unescape(head).alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, _quoted(START)), lambda b: b != "")
    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
