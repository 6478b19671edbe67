"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context, only that reply is
trainable. The examples of a conversation therefore grow with the square of its turns; they are made one
after the other, so that a task holds the conversation and one example of it.

A turn is rendered as ``<s>role``, a line end, the text and ``</s>``. Inside roles and texts the escape
sign and the opening bracket are replaced, so no text can hold a control string:
``\\`` becomes ``\\s``, ``<`` becomes ``\\l`` and, in roles only, a line end becomes ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, BREAK = "<s>", "</s>", "\n"


def swap(value: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escape(value: Column) -> Column:
    """Text without control strings."""
    return swap(value, ("\\", "\\s"), ("<", "\\l"))


def unescape(value: Column) -> Column:
    """Inverse of :func:`escape`."""
    return swap(value, ("\\l", "<"), ("\\s", "\\"))


def prefix_examples(conversations: DataFrame, identity: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv_id, example (from 0), context, reply.

    ``context`` holds all turns before the reply and the opening of the reply's turn;
    ``reply`` is the escaped trainable text; ``</s>`` follows it. Turns after the last reply give a last
    row with the whole conversation as context and a null reply. Null role and text count as empty; a null identity is a
    conversation of its own; turns with equal numbers (null first) go by role and text, repeated rows stay repeated; an
    empty table gives no rows; other columns are not read. One conversation is put together in one row, as its
    text is one string by definition.
    """
    said = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = conversations.select(F.col(identity).cast("long").alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["role"] == "assistant")
    # A last entry after the end of the turns stands for those that no reply follows.
    open_end = F.when(F.coalesce(F.element_at("turns", -1)["role"] == "assistant", F.lit(False)), F.array().cast("array<int>")).otherwise(F.array(n + 1))

    def opened(t):
        return F.concat(F.lit(OPEN), swap(escape(t["role"]), (BREAK, "\\n")), F.lit(BREAK))

    def closed(t):
        return F.concat(opened(t), escape(t["text"]), F.lit(CLOSE))

    at = grouped.select("conv_id", "turns", F.posexplode(F.concat(ends, open_end)).alias("example", "at"))
    replied = F.col("at") <= n
    last = F.get("turns", F.col("at") - 1)
    context = F.concat(F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("at") - 1), closed), ""), F.when(replied, opened(last)).otherwise(""))
    return at.select("conv_id", F.col("example").cast("long").alias("example"), context.alias("context"), F.when(replied, escape(last["text"])).alias("reply"))


def rendered(part: Column | None = None) -> Column:
    """Formatted text of one example row (or of a struct with its columns)."""
    get = (lambda c: part[c]) if part is not None else F.col
    return F.concat(get("context"), F.when(get("reply").isNotNull(), F.concat(get("reply"), F.lit(CLOSE))).otherwise(""))


def read_back(examples: DataFrame) -> DataFrame:
    """Turns and trainable text of every conversation, parsed from the formatted examples: the last one holds all turns,
    and each reply is trainable in the example of its own."""
    whole = F.max_by(F.struct("context", "reply"), "example").alias("last")
    spoken = F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply"))))
    parts = examples.groupBy("conv_id").agg(whole, spoken.alias("replies")).withColumn("last", rendered(F.col("last"))).withColumnRenamed("last", "formatted")
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda piece: piece != "")

    def turn(piece):
        # Line ends of roles go back first: a backslash of the role itself is still written as "\\s".
        role = unescape(swap(F.regexp_extract(piece, r"^<s>([^\n]*)\n", 1), ("\\n", BREAK)))
        return F.struct(role.alias("role"), unescape(F.regexp_extract(piece, r"(?s)^<s>[^\n]*\n(.*)$", 1)).alias("text"))

    replies = F.transform("replies", lambda p: unescape(p["reply"]))
    return parts.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(replies, "").alias("loss"))


def chat_digest(examples: DataFrame) -> DataFrame:
    """Counts and digests of what can be read back from the examples, per conversation."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(examples).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
