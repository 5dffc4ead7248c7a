"""A filter by hashes in built-in expressions: one bit for each hash in an array of fixed size.

The array is a scalar subquery: it is made once from bitmaps of 4 kB, reaches the tasks with their code, and is read within
generated code, so that rows can be dropped before a shuffle without a join. What it lets through holds all rows whose hash is
among the given ones and a few others; where hashes outgrow the bits, more pass. It never decides a result by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the array by default: 8 MB as 32 to a 64-bit entry, whatever the input. A bitmap of Spark holds 32,768 of them.
BITS, MAP_BITS = 1 << 25, 1 << 15


def bit_array(hashes: DataFrame, bits: int = BITS) -> Column:
    """The bits of the one column of 64-bit hashes, as a column for likely() with as many bits."""
    place = F.pmod(F.col(hashes.columns[0]), F.lit(bits)) + 1
    maps = hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    every = hashes.sparkSession.range(1, bits // MAP_BITS + 1, 1, 1).withColumnRenamed("id", "b")
    four = lambda k: F.conv(F.hex(F.substring(F.col("bits"), 4 * k + 1, F.lit(4))), 16, 10).cast("long")
    word = F.transform(F.sequence(F.lit(0), F.lit(MAP_BITS // 32 - 1)), four)
    words = every.join(maps, "b", "left").select("b", F.when(F.col("bits").isNull(), F.array_repeat(F.lit(0).cast("long"), MAP_BITS // 32)).otherwise(word).alias("w"))
    ordered = F.sort_array(F.collect_list(F.struct("b", "w")))  # 1,024 rows by default
    return words.agg(F.flatten(F.transform(ordered, lambda x: x["w"])).alias("bits")).scalar()


def likely(held: Column, hash_: Column, bits: int = BITS) -> Column:
    """Whether the hash is among those of the array, or shares its bit with one."""
    p = F.pmod(hash_, F.lit(bits)).cast("int")
    byte = F.shiftright(p, 3)
    word = F.get(held, F.shiftright(p, 5))
    return F.getbit(word, 8 * (3 - byte.bitwiseAND(F.lit(3))) + p.bitwiseAND(F.lit(7))) == 1
