"""Rounds of cross-validation: bits of a sample, vectors of counts.

A sample carries its rounds as bits, 64 to a word; what is counted over samples is counted for all rounds at once, as one row
with an array of counts. Nothing is copied for each round before it is summed; only counts are unrolled to rows by iter.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


@dataclass(frozen=True)
class Rounds:
    """members: (sample_id, rounds array<bigint>), a row for each sample that is in a round; count: how many rounds there are."""

    members: DataFrame
    count: int


def rounds_of(rows: DataFrame, count: int) -> Rounds:
    """From rows (iter, sample_id)."""
    words = [F.bit_or(F.when(F.floor(F.col("iter") / WORD) == w, F.expr("shiftleft(1L, iter % 64)")).otherwise(F.lit(0).cast("long"))) for w in range(words_for(count))]
    return Rounds(rows.groupBy("sample_id").agg(F.array(*words).alias("rounds")), count)


def words_for(count: int) -> int:
    return -(-count // WORD)


def as_words(flags: list[Column]) -> Column:
    """Booleans as bits."""
    bit = lambda k: F.lit((1 << k % WORD) - (1 << WORD if k % WORD == WORD - 1 else 0)).cast("long")
    bits = [F.when(flag, bit(k)).otherwise(F.lit(0).cast("long")) for k, flag in enumerate(flags)]
    return F.array(*[functools.reduce(Column.bitwiseOR, bits[lo : lo + WORD]) for lo in range(0, len(bits), WORD)])


def size_of(rounds: Rounds | None) -> int:
    return 1 if rounds is None else rounds.count


def joined(rows: DataFrame, rounds: Rounds | None) -> DataFrame:
    """rows (with sample_id) of the samples in a round, with the column rounds; without rounds all samples are in round 0."""
    if rounds is None:
        return rows.withColumn("rounds", F.array(F.lit(1).cast("long")))
    return rows.join(rounds.members, "sample_id")


def flags(count: int) -> Column:
    """For each round 1 or 0, from the column rounds."""
    return F.array(*[F.getbit(F.col("rounds")[k // WORD], F.lit(k % WORD)).cast("long") for k in range(count)])


def vectors(rows: DataFrame, keys: list[str], count: int, weight: Column | None = None) -> DataFrame:
    """keys, counts: for each round how many rows (or the sum of their weights) are in it. rows: with the column rounds."""
    bit = lambda k: F.getbit(F.col("rounds")[k // WORD], F.lit(k % WORD)).cast("long")
    sums = [F.sum(bit(k) if weight is None else bit(k) * weight) for k in range(count)]
    return rows.groupBy(*keys).agg(F.array(*sums).alias("counts"))


def added(rows: DataFrame, keys: list[str], count: int, column: str = "counts") -> DataFrame:
    """The arrays summed entry by entry within keys."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col(column)[k]) for k in range(count)]).alias(column))


def unrolled(counted: DataFrame, name: str) -> DataFrame:
    """A row for each round with a count other than 0."""
    keys = [c for c in counted.columns if c != "counts"]
    return counted.select(*keys, F.posexplode("counts").alias("iter", name)).where(F.col(name) != 0)
