"""MinHash near-deduplication: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set holds its distinct five-word shingles as 64-bit
hashes, with fewer words the whole sequence as one. Two documents are linked if 100 * |A and B| >= percent * |A or B|,
counted on the full sets.

Steps: (1) one pass over the texts hashes each set, splits the hash range into BINS bins, keeps each bin's minimum and
fills empty bins from a bin drawn by a fixed hash of (bin, attempt), then folds BANDS * ROWS bins into band keys.
(2) Documents with equal sets form a class; only its smallest doc_id goes on. (3) Each bucket proposes a star, its smallest
doc_id with every other member, so a bucket of n members costs n - 1 candidate edges. (4) Full sets decide, first between
each document and the least of its hubs: a hub's text goes to its members once for each part of about PART of them, so a group of near
copies moves each text once. Then the other edges of stars whose ends are still apart. (5) As two members of a bucket may be linked with each
other and not with their hub, the buckets that still hold documents of several components are looked at, each by itself (those of
one hub together), so that documents that never shared a bucket are not compared however buckets chain. Their documents
are compared in blocks of at most about BLOCK documents or VOLUME shingles; the task of two blocks counts intersections of full sets, skips
what is connected already and returns a spanning forest of the links it found. Buckets too large for one block are narrowed first by a
prefix filter: a document's rarest shingles, n - ceil(percent * n / 100) + 1 of them in one order for all documents, hold one that any
document linked with it has among its own, so only documents of different components that share such a shingle are compared. The order is by
counts in CELLS cells, summed over these documents by treeAggregate, then by hash: whatever the counts, it loses no link. Thus no link of
documents that share a bucket is lost, no pair is a row, and texts move once for each bucket or rare shingle and block. (6) Components of all links.
What moves are texts: compressed they are smaller than the hashes of their shingles.

Defined results: text null or without words: n_shingles 0, linked with nothing, kept. A very long text is one like others. Repeated rows of one doc_id count as
one document (that of the least set fingerprint). Rows without doc_id are left out. Empty table: empty result. Columns
besides the two named are not looked at.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import SALTS, components, likely_in, saved, with_least

SIZE = 5
BINS, BANDS, ROWS = 128, 25, 5
PERCENT = 85
#: Documents and shingles of a block, about; members of a star that meet a copy of the hub's text, about.
BLOCK, VOLUME, PART = 512, 1_000_000, 2_000
#: Cells of the counts that order shingles from rare to frequent: 8 MB, whatever the input.
CELLS = 1 << 20

_ATTEMPTS = 2048
_DONOR = (C.stream(31, _ATTEMPTS * BINS) % np.uint64(BINS)).astype(np.int64).reshape(_ATTEMPTS, BINS)
_ODD = C.stream(37, ROWS) | np.uint64(1)


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One-permutation signatures, one row of BINS uint64 for each set (zeros for an empty set). sets: sorted within each."""
    n = len(offsets) - 1
    sig, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    if len(sets):
        owner = np.repeat(np.arange(n), np.diff(offsets))
        cell = owner * BINS + (sets >> np.uint64(57)).astype(np.int64)
        least = np.r_[True, cell[1:] != cell[:-1]]  # sorted: the first of a bin is its minimum
        sig.reshape(-1)[cell[least]] = sets[least]
        full.reshape(-1)[cell[least]] = True
    row, bin_ = np.nonzero(~full & full.any(1)[:, None])
    for attempt in range(_ATTEMPTS):
        if not len(row):
            return sig
        donor = _DONOR[attempt, bin_]
        hit = full[row, donor]
        sig[row[hit], bin_[hit]] = sig[row[hit], donor[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    sig[row, bin_] = sig[row, full[row].argmax(1)]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    folded = (sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS) * _ODD).sum(2, dtype=np.uint64)
    return C.mix(folded + C.stream(41, BANDS)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = C.utf8(batch.column(1))
        for lo, hi in C.chunks(offsets):
            sets, at = C.shingles(*C.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), SIZE)
            n = np.diff(at)
            sums = np.r_[np.uint64(0), np.cumsum(C.mix(sets + np.uint64(3)))]
            ors = np.r_[np.uint64(0), np.cumsum(C.mix(sets ^ np.uint64(0x5851F42D4C957F2D)))]
            sig = signatures(sets, at)
            keys = band_keys(sig)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(n, pa.int64()),
                    pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)),
                    pa.array((ors[at[1:]] - ors[at[:-1]]).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1))),
                ],
                names=["doc_id", "n", "fp1", "fp2", "bands"],
            )


def forest(ids: list[int], sets: list[np.ndarray], groups: list[int], left: np.ndarray, inside: bool, percent: int) -> list[tuple[int, int]]:
    """Links that connect all that the links between left and not left connect (inside: the links among all) and the groups do
    not, at most len(ids) - 1."""
    right = np.arange(len(ids)) if inside else np.flatnonzero(~left)
    if not len(right) or len(ids) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    _, names = np.unique(np.concatenate(sets), return_inverse=True)
    names = np.split(names, np.cumsum(sizes)[:-1])
    flat = np.concatenate([names[k] for k in right])
    starts = np.r_[0, np.cumsum(sizes[right])[:-1]]
    mark = np.zeros(int(flat.max(initial=-1)) + 1 + max((int(x.max()) for x in names), default=0) + 1, np.int32)
    group, found = np.unique(groups, return_inverse=True)[1], []
    for i in np.arange(len(ids)) if inside else np.flatnonzero(left):
        near = (group[right] != group[i]) & (100 * np.minimum(sizes[right], sizes[i]) >= percent * np.maximum(sizes[right], sizes[i]))
        if not near.any():
            continue
        mark[names[i]] = 1
        if near.sum() * 8 < len(right):
            common = np.zeros(len(right), np.int64)
            for k in np.flatnonzero(near):
                common[k] = mark[names[right[k]]].sum()
        else:
            common = np.add.reduceat(mark[flat], starts)
        mark[names[i]] = 0
        for k in np.flatnonzero(near & (100 * common >= percent * (sizes[right] + sizes[i] - common))):
            j = right[k]
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                found.append((ids[i], ids[j]))
    return found


def _compare(percent: int):
    """Rows sorted by (family, i, j, doc_id): the links of each group, as forest() finds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, blocks, groups, sets, prints, found = None, [], [], [], [], [], []

        def settle() -> None:
            if len(ids) > 1:
                left = np.array(blocks) == key[1]
                found.extend(forest(ids, sets, groups, left, key[1] == key[2], percent))
            for x in (ids, blocks, groups, sets, prints):
                x.clear()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return made

        for batch in batches:
            family, left, right, doc, block, group = (batch.column(k).to_pylist() for k in range(6))
            data, offsets = C.utf8(batch.column(6))
            for lo, hi in C.chunks(offsets):
                made, at = C.shingles(*C.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), SIZE)
                for r in range(lo, hi):
                    s = made[at[r - lo] : at[r - lo + 1]].copy()
                    if (now := (family[r], left[r], right[r])) != key:
                        settle()
                        key = now
                    fp = (int(np.sum(C.mix(s + np.uint64(3)), dtype=np.uint64).view(np.int64)), len(s))
                    if ids and ids[-1] == doc[r]:  # of repeated rows the least counts, as in the signatures
                        if fp < prints[-1]:
                            sets[-1], prints[-1] = s, fp
                        continue
                    ids.append(doc[r])
                    blocks.append(block[r])
                    groups.append(group[r])
                    sets.append(s)
                    prints.append(fp)
            yield out()
        settle()
        yield out()

    return run


def _meet(percent: int):
    """Rows sorted by (hub, part, whether they are the hub's), each hub's text before its members': the members linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            hub, part, doc, fp = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            data, offsets = C.utf8(batch.column(5))
            found = []
            for lo, hi in C.chunks(offsets):
                made, at = C.shingles(*C.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), SIZE)
                sums = np.r_[np.uint64(0), np.cumsum(C.mix(made + np.uint64(3)))]
                prints = (sums[at[1:]] - sums[at[:-1]]).view(np.int64)
                for r in range(lo, hi):
                    if prints[r - lo] != fp[r]:  # another text of a repeated doc_id
                        continue
                    s = made[at[r - lo] : at[r - lo + 1]]
                    if doc[r] == hub[r]:
                        key, own = (hub[r], part[r]), s.copy()
                    elif (hub[r], part[r]) == key and 100 * min(len(s), len(own)) >= percent * max(len(s), len(own)):
                        common = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                        if 100 * common >= percent * (len(s) + len(own) - common):
                            found.append((hub[r], doc[r]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _cells(sets: np.ndarray) -> np.ndarray:
    return (C.mix(sets) % np.uint64(CELLS)).astype(np.int64)


def frequencies(texts: DataFrame) -> np.ndarray:
    """In how many rows of the one column text shingles of a cell are: a vector of CELLS, one a task and a tree of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            data, offsets = C.utf8(batch.column(0))
            for lo, hi in C.chunks(offsets):
                made, _ = C.shingles(*C.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), SIZE)
                np.add.at(total, _cells(made), 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = texts.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return parts.treeAggregate(np.zeros(CELLS, np.int64), operator.add, operator.add, depth=3)


def prefix(s: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets as similar as percent share one of them."""
    return s[np.lexsort((s, count[_cells(s)]))[: len(s) - -(-percent * len(s) // 100) + 1]]


def rare(texts: DataFrame, percent: int) -> DataFrame:
    """Rows (id, shingle): the prefix of each row's set, in the order of the counts over all these rows. texts: doc_id, text."""
    shared = texts.sparkSession.sparkContext.broadcast(frequencies(texts.select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            for lo, hi in C.chunks(offsets):
                made, at = C.shingles(*C.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), SIZE)
                parts = [prefix(made[at[k] : at[k + 1]], shared.value, percent) if at[k] < at[k + 1] else made[:0] for k in range(hi - lo)]
                ids = np.repeat(batch.column(0).to_numpy()[lo:hi], [len(x) for x in parts])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(parts).view(np.int64))], names=["id", "shingle"])

    return texts.mapInArrow(run, "id long, shingle long")


def narrowed(families: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of families too large for a block, the documents of different components that share a rare shingle, each family being
    what shares one, named by its smallest id: rows (family, id, component, n) that lose no link between components."""
    members = saved(families.select("id", "component", "n").distinct())
    held = texts.join(members.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    shingle = saved(rare(saved(held), percent).join(members, "id"))
    several = shingle.groupBy("shingle").agg(F.min("id").alias("family"), F.min("component").alias("low"), F.max("component").alias("high"))
    return shingle.join(several.where("low < high").select("shingle", "family"), "shingle").select("family", "id", "component", "n").distinct()


def blocks() -> F.Column:
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / VOLUME)).cast("int").alias("blocks")


def linked(edges: DataFrame, texts: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """Of the edges (hub, id) those whose full sets are similar enough, as (a, b). prints: doc_id, fp1 of the text that counts."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    per = salted.groupBy("hub", "salt").agg(F.count("*").alias("n"))
    parts = per.groupBy("hub").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    parts = per.select("hub", "salt").join(parts, "hub").withColumn("part", F.pmod("salt", "parts").cast("int"))
    members = salted.join(parts, ["hub", "salt"]).select("hub", "part", F.lit(True).alias("member"), F.col("id").alias("doc_id"))
    hubs = parts.select("hub", "part", F.lit(False).alias("member"), F.col("hub").alias("doc_id")).distinct()
    rows = members.union(hubs).join(prints.select("doc_id", "fp1"), "doc_id").join(texts, "doc_id").select("hub", "part", "member", "doc_id", "fp1", "text")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "member").mapInArrow(_meet(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id); see the module."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    signed = texts.mapInArrow(_sign, "doc_id long, n long, fp1 long, fp2 long, bands array<long>")
    signed = saved(signed.groupBy("doc_id").agg(F.min(F.struct("fp1", "n", "fp2", "bands")).alias("s")).select("doc_id", "s.*"))
    class_ = ["fp1", "fp2", "n"]
    of = saved(with_least(signed.where("n > 0").select("doc_id", *class_), class_, "doc_id", "rep"))  # a row for each document
    reps = signed.join(of.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")

    placed = saved(reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")))
    hubs = placed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1").select("key", "hub")
    stars = saved(placed.join(hubs, "key").where("id <> hub").select("hub", "id").distinct())
    near = saved(likely_in(texts, "doc_id", stars.select(F.explode(F.array("hub", "id")).alias("id")).distinct()))

    first = stars.groupBy("id").agg(F.min("hub").alias("hub"))
    links = saved(linked(first, near, signed, percent))
    label = links.select(F.col("b").alias("id"), F.col("a").alias("label"))
    rest = stars.join(first.withColumn("tried", F.lit(True)), ["id", "hub"], "left").where("tried is null").drop("tried")
    rest = rest.join(label, "id", "left").select("id", "hub", F.coalesce("label", "id").alias("mine"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    theirs = rest.select("hub", "salt").distinct().join(label.withColumnRenamed("id", "hub"), "hub", "left").select("hub", "salt", F.coalesce("label", "hub").alias("theirs"))
    rest = rest.join(theirs, ["hub", "salt"]).where("mine <> theirs").select("hub", "id")
    links = saved(links.union(linked(saved(rest), near, signed, percent)))
    joined = saved(components(links))

    # buckets that hold documents of several components
    apart = placed.join(joined, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))
    mixed = apart.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("hub")).where("low < high")
    apart = saved(apart.join(mixed.select("key", "hub"), "key").select("hub", "id", "component").distinct())
    if not apart.isEmpty():
        families = apart.join(signed.select(F.col("doc_id").alias("id"), "n"), "id").select(F.col("hub").alias("family"), "id", "component", "n")
        sizes = saved(families.groupBy("family").agg(blocks()))
        large = sizes.where("blocks > 1").select("family")
        if not large.isEmpty():
            less = narrowed(families.join(large, "family", "left_semi"), near, percent)
            families = saved(families.join(large, "family", "left_anti").union(less).distinct())
            sizes = families.groupBy("family").agg(blocks())
        members = families.join(sizes, "family").select("family", F.col("id").alias("doc_id"), "component", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
        rows = members.join(near, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "block", "component", "text")
        rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "doc_id")
        joined = saved(components(links.union(rows.mapInArrow(_compare(percent), "a long, b long"))))

    of = of.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    roots = of.select("rep", "salt").distinct().join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "salt", F.coalesce("component", "rep").alias("component_id"))
    root = of.join(roots, ["rep", "salt"]).select("doc_id", "n", "component_id")
    out = root.union(signed.where("n = 0").select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
