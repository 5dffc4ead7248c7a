"""Exact deduplication by progressive refinement: length, then a hash of the beginning, then a hash of the whole.

Texts are equal when they are identical after every character of `[\\x20\\x09-\\x0D]` is deleted. Built-in expressions alone.
(1) One pass over the texts keeps two numbers of each, the normalised length and a hash of the first PREFIX characters.
(2) Lengths that one text has alone are dropped, then of the rest the (length, prefix hash) that one text has alone. (3) A
second pass hashes in full (SHA-256) only texts whose pair survived; they are told by a bit array of fixed size, so no text
moves and no join carries one; texts that the array lets through by chance are hashed too and end in groups of one. (4) Rows of
equal digest are a group. What is shuffled are digests and numbers, counted before the shuffle; the rows of a group meet their
result in SALTS parts, so a group that holds a third of all rows is in no single task.

Of a group stays the row with the most code points in the original text, then of the smallest doc_id, then the first in the
order of the table. Null text counts as empty; empty and blank texts are equal to each other. A very long text is one like
others. Repeated rows are rows each: exactly one row of a group is kept, also where it repeats. Rows without doc_id take part
and come after all others in a tie; keep_id is null where such a row stays. Empty table: empty result. Other columns are not
looked at; their names may clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitfilter import bit_array, likely
from .common import SALTS, saved

BLANK = r"[\x20\x09-\x0D]+"
#: Characters of the normalised text whose hash is the second refinement.
PREFIX = 64


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (lower-case hex of the normalised text; null for texts told apart before the
    last step, unless digest_all)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("points"), F.regexp_replace(text, BLANK, "").alias("norm"))
    begin = rows.select("*", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"))

    heads = saved(begin.select("len", "prefix"))
    several = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").select(F.xxhash64(*keys).alias("h"))
    lengths = saved(several(heads, "len"))
    pairs = saved(several(heads.where(likely(bit_array(lengths), F.xxhash64("len"))), "len", "prefix"))

    found = begin.withColumn("open", likely(bit_array(pairs), F.xxhash64("len", "prefix")))
    full = F.sha2("norm", 256) if digest_all else F.when(F.col("open"), F.sha2("norm", 256))
    signed = saved(found.select("doc_id", "points", "open", full.alias("sha"), F.monotonically_increasing_id().alias("row")))

    salted = signed.where("open").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    parts = salted.groupBy("sha", "salt").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    whole = Window.partitionBy("sha")  # SALTS rows for each digest
    parts = parts.select("sha", "salt", F.min("best").over(whole).alias("best"), F.sum("n").over(whole).alias("n"))
    grouped = salted.join(parts, ["sha", "salt"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = signed.where("not open").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return grouped.union(alone)
