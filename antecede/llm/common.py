"""Helpers shared by the operators of this folder: saved tables, word hashes and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at a time.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where spark.checkpoint.dir is unset and the master is local (tests), a
    folder of our own; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = own.get()
    return path.rstrip("/")


def saved(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Writes the table to the shared folder and returns it as read from there: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """The columns under names that mapInArrow can take, whatever theirs are."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = stream(11, 256)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, np.uint64(b))
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 4 * CHUNK_BYTES:  # for one very long text: not kept
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the n + 1 offsets. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most so many bytes each, or one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and the n + 1 offsets of each text's words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:]))
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * power[:n], out=total[1:])
    return mix((total[ends + 1] - total[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of each word, as words() finds them."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | first[:-1]))
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], False] | first[1:])) + 1
    return starts, ends


_STEP = stream(23, 8) | np.uint64(1)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their offsets; fewer words than size count as one shingle."""
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (counts < size))
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    to = np.r_[0, np.cumsum(made)]
    out = np.zeros(to[-1], np.uint64)
    if len(hashes) >= size:
        wide = len(hashes) - size + 1
        rolled = np.zeros(wide, np.uint64)
        for k in range(size):
            rolled += hashes[k : k + wide] * _STEP[k]
        text = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(wide)
        full = at + size <= offsets[text[:wide] + 1]
        target = to[text[:wide]] + at - offsets[text[:wide]]
        out[target[full]] = mix(rolled[full] + np.uint64(size))
    for i in short:
        h = hashes[offsets[i] : offsets[i + 1]]
        out[to[i]] = mix(np.sum(h * _STEP[: len(h)], dtype=np.uint64, keepdims=True) + np.uint64(len(h)))[0]
    for i in np.flatnonzero(made > 1):
        out[to[i] : to[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[to[:-1][made > 0]] = True
    return out[new], np.r_[0, np.cumsum(new)][to]


#: Bits of the filter that likely_in() broadcasts: 4 MB, whatever the input.
FILTER_BITS = 1 << 25


def likely_in(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is among the ids (one column), and a few others: a filter before a join, so that the join
    need not shuffle what it will drop. One bit for each hash, of FILTER_BITS; where ids outgrow it, more rows pass."""
    place = F.pmod(F.xxhash64(F.col(ids.columns[0]).cast("long")), F.lit(FILTER_BITS)) + 1
    bits = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for b, part in bits.collect():  # at most FILTER_BITS bits
        held[(b - 1) * 4096 : b * 4096] = np.frombuffer(part, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            mask = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(mask.astype(bool))).select(list(range(batch.num_columns - 1)))

    spot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS))
    return rows.withColumn("_spot", spot).mapInArrow(keep, rows.schema)


#: Parts that the rows of one key are dealt to.
SALTS = 64


def with_least(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with the least value of their keys. The rows of a key meet it in SALTS parts, not in one task: the least of each
    part first, then of the key, then back to the parts."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy(*keys, "_salt").agg(F.min(value).alias("_least"))
    parts = parts.select(*keys, "_salt", F.min("_least").over(Window.partitionBy(*keys)).alias(name))  # SALTS rows for each key
    return rows.join(parts, [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component being the smallest id reachable.

    Large-star and small-star steps in turn until nothing changes: each step is a grouped minimum (map-side combined) that
    goes back to the links in SALTS parts, so the links of a hot node are never gathered in one task. Empty in, empty out.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = with_least(edges.union(edges.select("b", "a")), ["a"], "b", "m").withColumn("m", F.least("a", "m"))
        large = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = with_least(saved(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), ["a"], "b", "m")
        small = low.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = saved(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ids = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return ids.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
