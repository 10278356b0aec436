"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks. Texts and roles hold none of them once escaped, as they then hold no < or > at all.
OPEN, BODY, CLOSE = "<turn ", ">\n", "</turn>\n"


def escaped(text: Column) -> Column:
    """Reversible: a backslash becomes \\b, < becomes \\l and > becomes \\g."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    """The inverse: in an escaped text each backslash has one letter after it, so the marks are restored first and the backslashes last."""
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def chat_examples(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One example for each turn of `trained_role`: all turns before it as context and that reply, of which alone the text is trainable.

    Columns: the conversation's id, example (the turn's place, from 0), formatted, loss_start and loss_end (the trainable span of `formatted` in code points, end exclusive). A conversation that ends in another role gets one more row, of all its turns and with an empty span, so that no turn is lost.
    Turns are ordered by turn, then role, then text, so repeated and tied rows have a fixed order and all stay. Null text or role: empty. Null turn: first. Null id: one conversation of its own. Empty table: no rows. Other columns aren't read.
    One shuffle by conversation; no Python. A conversation meets in one row because its last example holds it whole.
    """
    own = turns.select(turns[conv_col].alias("conv"), F.struct(turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text")).alias("t"))
    whole = own.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = whole.select(
        "conv",
        F.transform("turns", lambda t: t["role"] == trained_role).alias("trained"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(BODY))).alias("heads"),
        F.transform("turns", lambda t: escaped(t["text"])).alias("bodies"),
    )
    lines = parts.withColumn("lines", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE))))
    own_last = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("trained", i) | (i == F.size("lines") - 1))
    sizes = F.transform("lines", lambda x: F.char_length(x))
    stop = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x)
    spans = F.transform(own_last, lambda i: F.struct(i.alias("example"), F.get("trained", i).alias("own"), stop(i).alias("stop"), F.char_length(F.get("bodies", i)).alias("size")))
    one = lines.withColumn("sizes", sizes).select("conv", "lines", F.explode(spans).alias("s"))  # of the conversation only its lines are copied to each example
    last = F.when(F.col("s.own"), F.col("s.stop") - len(CLOSE)).otherwise(F.col("s.stop"))
    first = F.when(F.col("s.own"), last - F.col("s.size")).otherwise(last)
    formatted = F.array_join(F.slice("lines", F.lit(1), F.col("s.example") + 1), "")
    return one.select(F.col("conv").alias(conv_col), F.col("s.example").alias("example"), formatted.alias("formatted"), first.cast("long").alias("loss_start"), last.cast("long").alias("loss_end"))


def parsed(formatted: Column) -> Column:
    """The turns that a formatted text holds, as an array of (role, text)."""
    lines = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(line: Column) -> Column:
        sides = F.split(F.substring(line, len(OPEN) + 1, 2**31 - 1), BODY)
        return F.struct(unescaped(F.get(sides, F.lit(0))).alias("role"), unescaped(F.get(sides, F.lit(1))).alias("text"))

    return F.transform(lines, turn)


def trainable(examples: DataFrame) -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescaped(F.substring(examples["formatted"], (examples["loss_start"] + 1).cast("int"), (examples["loss_end"] - examples["loss_start"]).cast("int")))


def chat_digest(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A null id is a conversation of its own; an empty table has none; the others have one row each. Per conversation, read back from the examples: n_turns, turns_sha256 (of role, line feed, text, line feed for each turn), loss_chars, loss_sha256 (of all trainable text in order) and formatted_chars (of all its examples)."""
    row = examples.select(F.col(conv_col).alias("conv"), "example", "formatted", trainable(examples).alias("loss"))
    got = row.groupBy("conv").agg(F.max_by("formatted", "example").alias("whole"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum(F.char_length("formatted")).alias("formatted_chars"))
    read = got.select("conv", parsed(F.col("whole")).alias("turns"), F.array_join(F.col("losses")["loss"], "").alias("loss"), "formatted_chars")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("conv").alias(conv_col), F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")
