"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Built-in expressions alone. Words are `[^\\x20\\x09-\\x0D]+` of the lower-cased text, shingles five words; with fewer words
the whole sequence is one shingle. An item is found in a document if at least `containment` of its distinct shingles are
among the document's.

Search: items are partitioned by size into classes [2**c, 2**(c+1)). An item's sketch holds the k smallest of its permuted
shingle hashes, k = floor((1 - containment) * (largest size of its class)) + 1. A document that holds at least that share of
an item lacks fewer than k of its shingles, so it shows at least one of any k: candidates are the (document, item) with a hit
of the sketch, and none is missed, however long the document. Then the candidates' full shingles are compared as text.
On either side a bit array of fixed size drops nearly all shingles of documents that no item has before anything is joined, so
what is shuffled follows the hits, however large the benchmark; a shingle that many documents share meets the items in
SALTS parts. The sketches are broadcast only if Spark finds them below its size threshold.

Null or empty text, on either side: no shingles, in no pair. Repeated rows of a doc_id count as one document that holds
all their shingles, likewise item_id. Rows without id are left out. Empty tables: empty result. Other columns are not
looked at; their names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitfilter import bit_array, likely
from .common import saved

SIZE, CONTAINMENT = 5, 0.8
#: Parts that the rows of one shingle are dealt to; bits of the array of an item's shingles (0.5 MB; beyond some hundred thousand
#: shingles more of the documents' pass).
SALTS, BITS = 16, 1 << 21


def _words(text: Column) -> Column:
    trimmed = F.trim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _hashes(w: Column) -> Column:
    """A hash of each shingle; not null."""
    rolled = F.transform(F.sequence(F.lit(0), F.size(w) - SIZE), lambda i: F.xxhash64(*[w[i + k] for k in range(SIZE)]))
    return F.when(F.size(w) >= SIZE, rolled).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def _strings(w: Column) -> Column:
    rolled = F.transform(F.sequence(F.lit(1), F.size(w) - SIZE + 1), lambda i: F.array_join(F.slice(w, i, SIZE), " "))
    return F.when(F.size(w) >= SIZE, rolled).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment of the pairs found."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", _words(F.col("text")).alias("w")).where("w is not null")
    items = items.where("item_id is not null and text is not null").select("item_id", _words(F.col("text")).alias("w")).where("w is not null")
    items = items.select("item_id", F.explode(F.arrays_zip(_hashes(F.col("w")).alias("h"), _strings(F.col("w")).alias("s"))).alias("x"))
    items = saved(items.select("item_id", "x.h", "x.s").distinct())

    size = items.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    upper = F.pow(F.lit(2), F.floor(F.log2("item_shingles")) + 1) - 1
    size = size.withColumn("k", F.floor(F.round((1 - containment) * upper, 9)) + 1)
    order = Window.partitionBy("item_id").orderBy(F.xxhash64("h", F.lit("permuted")), "h")
    sketch = items.join(size, "item_id").withColumn("place", F.row_number().over(order)).where("place <= k").select("item_id", "h")

    sketch = saved(sketch)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hits = docs.select("doc_id", F.explode(_hashes(F.col("w"))).alias("h")).where(likely(bit_array(sketch.select("h"), BITS), F.col("h"), BITS)).select("*", salt)
    candidates = saved(hits.join(sketch.select("item_id", "h", every), ["h", "salt"]).select("doc_id", "item_id").distinct())
    found = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    found = found.select("doc_id", F.explode(F.array_distinct(_strings(F.col("w")))).alias("s")).select("*", salt)
    found = found.where(likely(bit_array(items.select(F.xxhash64("s").alias("h")), BITS), F.xxhash64("s"), BITS))
    shared = found.join(items.select("item_id", "s", every), ["s", "salt"]).join(candidates, ["doc_id", "item_id"], "left_semi")
    shared = shared.groupBy("doc_id", "item_id").agg(F.countDistinct("s").alias("shared"))
    out = shared.join(size.select("item_id", "item_shingles"), "item_id")
    out = out.withColumn("containment", F.col("shared").cast("double") / F.col("item_shingles"))
    return out.where(F.col("containment") >= containment).select("doc_id", "item_id", "item_shingles", "shared", "containment")
