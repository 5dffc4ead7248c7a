"""Chat formatting with a grammar round trip: render, parse again, compare, and escape what conflicts until it is identical.

Built-in expressions alone. A conversation becomes the concatenation of its turns

    <turn>### role: text</turn>           raw: role and text as they are
    <turn esc>### role: text</turn>       escaped

First everything is rendered raw and parsed by the deterministic parser (split at the turn
end, then header and text by position); a conversation whose parsed turns differ from its source is rendered again with
escapes: `\\` becomes `\\b`, `<` becomes `\\l`, and in roles also `:` becomes `\\c`. Escaped text holds no `<`, so no control
string, and every `\\` in it is followed by one of these letters, so unescaping is unique. The escaped form is parsed and
compared as well; should it differ still, the job stops.

Turns are ordered by turn, then role and text; null role and text count as empty, null conv_id is a conversation of its own.
Repeated rows are turns like others. Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, OPEN_ESCAPED, CLOSE = "<turn>### ", "<turn esc>### ", "</turn>"
ASSISTANT = "assistant"


def _put(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, role: bool = False) -> Column:
    return _put(text, (("\\", "\\b"), ("<", "\\l")) + ((":", "\\c"),) * role)


def unescape(text: Column) -> Column:
    return _put(text, (("\\c", ":"), ("\\l", "<"), ("\\b", "\\")))


def render(turns: Column, escaped: bool) -> Column:
    """turns: array of (role, text)."""
    if escaped:
        one = lambda t: F.concat(F.lit(OPEN_ESCAPED), escape(t["role"], True), F.lit(": "), escape(t["text"]), F.lit(CLOSE))
    else:
        one = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(": "), t["text"], F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Array of (role, text) from rendered text; what is no turn by the grammar comes out as one without role."""

    def one(part: Column) -> Column:
        plain = part.startswith(OPEN)
        rest = F.when(plain, F.substr(part, F.lit(len(OPEN) + 1))).otherwise(F.substr(part, F.lit(len(OPEN_ESCAPED) + 1)))
        at = F.instr(rest, ": ")
        role, text = F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + 2)
        good = (plain | part.startswith(OPEN_ESCAPED)) & (at > 0)
        return F.struct(
            F.when(~good, "").when(plain, role).otherwise(unescape(role)).alias("role"),
            F.when(~good, part).when(plain, text).otherwise(unescape(text)).alias("text"),
        )

    # the part after the last turn end is empty in rendered text; any other shows up as a turn that differs
    parts = F.split(formatted, CLOSE)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, one)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped (whether it had to be), turns (as parsed from formatted), n_turns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    chats = chats.withColumn("raw", render(F.col("source"), False))
    chats = chats.withColumn("escaped", ~parse(F.col("raw")).eqNullSafe(F.col("source")))
    chats = chats.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("raw")))
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    stop = F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string")
    chats = chats.withColumn("formatted", F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("formatted")).otherwise(stop))
    return chats.select("conv_id", "formatted", "escaped", "turns", F.size("turns").cast("long").alias("n_turns"))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted text gives when read back: digests of the turns and of the text under the loss mask."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    return chats.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
