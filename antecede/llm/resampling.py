"""Importance resampling towards a target distribution over hashed n-grams.

(1) One pass over the texts makes a sparse matrix, documents by buckets: the counts of all runs of 1 to 3 words by the CRC-32
of their bytes modulo BUCKETS. It is stored in CSR blocks, one row for about BLOCK bytes of text: the documents' ids and numbers
of words, where each one's entries end, the buckets as gaps and the counts as bytes (a larger count is several entries). (2) Column sums of the blocks, one vector a task
combined by treeAggregate, give the distribution of the documents, and of the target likewise. (3) A bucket's gain is the scaled
logarithm of the ratio; the product of the blocks with the gains gives the weights. (4) With a Gumbel term for each document,
drawn by a hash of its id, the highest scores are a sample without replacement in proportion to the exponentials of the weights.
The order is one range-partitioned sort of numbers; a row's rank is its place in its partition after the rows of those before.

The CRC of a run needs no bytes but each word's once: the register after "a b" is the one after "a", moved on by the length of
" b" (a linear map, looked up), xor the register that " b" leaves from zero. Long texts go in pieces cut between words, each
with the last two words of the one before, whose own features are taken off again; so memory does not follow a text's length.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. Null text has no words, weight 0 and is never drawn,
as are all documents of fewer than `least_words`. Ties go to the smaller doc_id. Repeated rows of a doc_id are documents each;
rows without doc_id take part with the hash of the empty id, after all others in a tie. Empty target: the gains compare with the
uniform distribution that the added counts leave. Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
import operator
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import saved

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 5, 20, 42
#: Bytes of text of a block; bytes of one text beyond which it is taken in pieces; bytes of a row group, so that readers hold few
#: blocks at a time.
BLOCK, PIECE, ROW_GROUP = 1 << 18, 1 << 22, 1 << 23
#: Word lengths with a table of their own.
SHORT = 64

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_ROW = "ids array<bigint>, words array<bigint>, ends binary, gaps binary, counts binary"


def _byte_table() -> np.ndarray:
    """Of the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _byte_table()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[..., 0, x & 255] ^ tables[..., 1, (x >> 8) & 255] ^ tables[..., 2, (x >> 16) & 255] ^ tables[..., 3, x >> 24]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """What each byte of a register becomes after 0 to SHORT zero bytes, and after 2 ** k zero bytes."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    near = []
    for _ in range(SHORT + 1):
        near.append(now)
        now = _TABLE[now & 255] ^ (now >> 8)
    far = [near[1]]
    for _ in range(40):
        far.append(_apply(far[-1], far[-1]))
    return np.stack(near), np.stack(far)


_NEAR, _FAR = _shift_tables()


def moved(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers after `by` zero bytes each."""
    n = np.minimum(by, SHORT)
    out = _NEAR[n, 0, x & 255] ^ _NEAR[n, 1, (x >> 8) & 255] ^ _NEAR[n, 2, (x >> 16) & 255] ^ _NEAR[n, 3, x >> 24]
    rest = by - n
    for k in range(int(rest.max(initial=0)).bit_length()):
        on = np.flatnonzero(rest >> k & 1)
        out[on] = _apply(_FAR[k], out[on])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and lengths of the words of lower-cased bytes, and the n + 1 offsets of each text's words."""
    inside = _WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | first[:-1]))
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], False] | first[1:])) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def registers(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC register that each word leaves from zero."""
    out = np.zeros(len(starts), np.uint32)
    at = np.flatnonzero(length <= SHORT)
    for j in range(SHORT):
        at = at[length[at] > j]
        if not len(at):
            break
        x = out[at]
        out[at] = _TABLE[(x ^ data[starts[at] + j]) & 255] ^ (x >> 8)
    for k in np.flatnonzero(length > SHORT):
        out[k] = zlib.crc32(data[starts[k] : starts[k] + length[k]].tobytes(), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts (lower-cased bytes): number of words; and the text, bucket and count of each entry, in order."""
    starts, length, to = words(data, offsets)
    n = np.diff(to)
    text = np.repeat(np.arange(len(n)), n)
    own = registers(data, starts, length)
    full = np.uint32(0xFFFFFFFF)
    runs, keys = moved(np.full(len(own), full), length) ^ own, []
    after = moved(np.full(len(own), _TABLE[32]), length) ^ own  # what " word" leaves from zero
    for k in range(3):
        if k:
            runs = moved(runs[:-1], length[k:] + 1) ^ after[k:] if len(runs) > 1 else runs[:0]
        whole = text[: len(runs)] == text[k : k + len(runs)]
        keys.append(text[: len(runs)][whole] * buckets + (runs[whole] ^ full) % np.uint32(buckets))
    entry, count = np.unique(np.concatenate(keys), return_counts=True)
    return n, entry // buckets, entry % buckets, count


def long_features(data: np.ndarray, buckets: int, piece: int) -> tuple[int, np.ndarray]:
    """Number of words and counts of all buckets of one long text."""
    total, n, lo, before = np.zeros(buckets, np.int64), 0, 0, np.zeros(0, np.uint8)
    space = np.array([32], np.uint8)
    while lo < len(data):
        hi = min(lo + piece, len(data))
        while hi < len(data) and _WORD[data[hi]] and _WORD[data[hi - 1]]:
            ahead = np.flatnonzero(~_WORD[data[hi : hi + piece]])
            hi += int(ahead[0]) if len(ahead) else min(piece, len(data) - hi)
        part = np.concatenate([before, space, data[lo:hi]])
        for sign, x in ((1, part), (-1, before)):
            many, _, bucket, count = features(x, np.array([0, len(x)]), buckets)
            total[bucket] += sign * count
            n += sign * int(many[0])
        starts, length, _ = words(part, np.array([0, len(part)]))
        before = part[starts[-2:][0] : starts[-1] + length[-1]].copy() if len(starts) else before[:0]
        lo = hi
    return n, total


def _counted(buckets: int, piece: int):
    """id and text to CSR blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            for lo, hi in C.chunks(offsets, BLOCK):
                low = C._LOWER[data[offsets[lo] : offsets[hi]]]
                if len(low) > piece and hi == lo + 1:
                    n, total = long_features(low, buckets, piece)
                    n, text, bucket = np.array([n]), np.zeros(int((total > 0).sum()), np.int64), np.flatnonzero(total)
                    count = total[bucket]
                else:
                    n, text, bucket, count = features(low, offsets[lo : hi + 1] - offsets[lo], buckets)
                several = np.maximum(-(-count // 255), 1)  # entries of a bucket
                last = np.cumsum(several) - 1
                text, bucket, rest = np.repeat(text, several), np.repeat(bucket, several), count - 255 * (several - 1)
                count = np.full(len(text), 255)
                count[last] = rest
                gaps = bucket - np.r_[0, bucket[:-1]] * np.r_[False, text[1:] == text[:-1]][: len(text)]
                ends = np.cumsum(np.bincount(text, minlength=hi - lo))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [one(batch.column(0).slice(lo, hi - lo)), one(pa.array(n.astype(np.int64))), *(pa.array([x.tobytes()], pa.binary()) for x in (ends.astype(np.int64), gaps.astype(np.uint16), count.astype(np.uint8)))],
                    names=["ids", "words", "ends", "gaps", "counts"],
                )

    return run


def count_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, piece: int = PIECE) -> DataFrame:
    """The stored CSR blocks of a table. buckets: at most 65,536."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    path = f"{C.shared_dir(docs.sparkSession)}/blocks-{uuid.uuid4().hex}"
    rows.mapInArrow(_counted(buckets, piece), _ROW).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return docs.sparkSession.read.schema(_ROW).parquet(path)


def entries(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ends, buckets and counts of a block."""
    ends = np.frombuffer(block["ends"], np.int64)
    total = np.cumsum(np.frombuffer(block["gaps"], np.uint16), dtype=np.int64)
    begins = np.r_[0, ends[:-1]]
    size = ends - begins
    before = np.where(begins > 0, total[np.maximum(begins, 1) - 1], 0) if len(total) else begins
    return ends, total - np.repeat(before, size), np.frombuffer(block["counts"], np.uint8)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of each bucket over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                _, bucket, count = entries(block)
                total += np.bincount(bucket, count, buckets).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = blocks.select("ends", "gaps", "counts").mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return parts.treeAggregate(np.zeros(buckets, np.int64), operator.add, operator.add, depth=3)


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over its share in the documents."""
    n, s, t = len(own), int(own.sum()), int(target.sum())
    value = lambda a, b: math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n))))
    return np.array([value(a, b) for a, b in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the blocks' product with the gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in enumerate(batch.select(["ends", "gaps", "counts"]).to_pylist()):
                ends, bucket, count = entries(block)
                upto = np.r_[0, np.cumsum(gain[bucket] * count.astype(np.int64))][ends]
                n = batch.column(1)[k].values.to_numpy(zero_copy_only=False)
                runs = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.array(n), pa.array(runs), pa.array(np.diff(upto, prepend=0))], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn. share: percent."""
    blocks = count_matrix(docs, id_col, text_col, buckets)
    goal = count_matrix(target.withColumn("_id", F.lit(0)), "_id", "text", buckets)
    rows = weights(blocks, gains(column_sums(blocks, buckets), column_sums(goal, buckets)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumns({"score": F.col("weight") + gumbel, "enough": F.col("n_words") >= least_words, "row": F.monotonically_increasing_id()})
    rows = saved(rows)
    drawn = share * rows.where("enough").count() // 100
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    rows = saved(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part long, before long")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = rows.withColumn("part", part).join(F.broadcast(starts), "part")
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("enough") & (place <= drawn), place).alias("rank"))
