"""Resampling and cross-validation as key columns.

Replicates live in two ways only: as sums inside a task, and as rows (iter, block, parent, child, weights) that hold
the weights of an arc in WIDTH replicates of a round. No draw is a row and none is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.functions import draws
from antecede.functions.tally import WIDTH, Tally, Weights, between_tiers, ordered_arcs
from antecede.operators.rounds import WORD, Rounds, added, as_words, flags, joined, size_of, vectors, words_for
from antecede.sources.tables import spread, stored

#: Drawn mutations that a task holds at a time, about; rows of a bucket, about, and counts of (bucket, round) at most.
CHUNK, BUCKET, MAX_COUNTS = 1 << 19, 4096, 1 << 22
#: Draws of a sample from which tables pay; kinds of mutations that have tables at most, and how often each occurs at least.
DENSE_CELLS, KINDS, LEAST = 2048, 1024, 64
#: Bytes of drawn numbers that a task holds at a time.
HELD = 1 << 26
_BLOCKS = "iter int, block int, parent int, child int, weights array<bigint>"


def bits(words: pd.Series, count: int) -> np.ndarray:
    """Rows x count booleans of the column rounds."""
    if not len(words):
        return np.zeros((0, count), bool)
    packed = np.stack(words.to_numpy()).astype("<i8").view(np.uint8)
    return np.unpackbits(packed, axis=1, bitorder="little")[:, :count].astype(bool)


def _given(tally: Tally | Weights) -> Iterator[pd.DataFrame]:
    for part in tally.rows():
        yield pd.DataFrame(part | {"weights": list(part["weights"])}).astype({c: np.int32 for c in ("iter", "block", "parent", "child")})


def replicate_blocks(vaf: DataFrame, names: list[str], nsampling: int, seed: int, rounds: Rounds | None = None, mode: str = "tiers") -> DataFrame:
    """F1 with B2, B3, D1, D2, D4: iter, block, parent, child (places in names), weights of each replicate.

    A sample's mutations are one row and have one stream of draws, in the order of its rounds; those of one mutation have no arc
    and draw nothing. Where a sample is drawn DENSE_CELLS times or more, one whose mutations are all of common kinds
    (common_kinds()) is drawn by bins from tables, see _Bins. The others are drawn, clamped and put in
    order side by side with those of equal numbers of mutations, about CHUNK mutations at a time. The distribution is the same. Arcs are summed
    in the task. vaf: one row for each (sample, gene)."""
    at = {g: k for k, g in enumerate(names)}
    count, genes = size_of(rounds), len(names)
    cols = ["gene_id", "alt_count", "ref_count", "copy_number", "normal_ploidy"]
    dense = mode == "tiers" and count * nsampling >= DENSE_CELLS
    vaf = common_kinds(vaf, cols[1:]) if dense else vaf.withColumn("common", F.lit(False))
    packed = spread(vaf, "sample_id").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("m"), F.every("common").alias("common"))
    rows = joined(packed.where(F.size("m") > 1), rounds)
    rows = rows.select(F.xxhash64("sample_id").alias("key"), "rounds", "common", *[F.col(f"m.{c}").alias(c) for c in cols])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally, sums = Tally(count, nsampling, genes), Weights(count, nsampling, genes)
        bins = _Bins(seed, nsampling, sums, tally)
        for batch in batches:
            if not len(batch):
                continue
            common = batch[batch.common]
            for x, its in zip(common.itertuples(), bits(common["rounds"], count), strict=True):
                known = sorted((at[g], a, b, c) for g, a, b, c, _ in zip(*(getattr(x, c) for c in cols), strict=True) if g in at)
                bins.add(x.key, known, np.flatnonzero(its))
            bins.settle()
            if sums.full():
                yield from _given(sums)
            batch = batch[~batch.common].reset_index(drop=True)
            member, size = bits(batch["rounds"], count), batch.gene_id.str.len().to_numpy()
            keys, labels, numbers = batch.key.to_numpy(), batch.gene_id.to_numpy(), [batch[c].to_numpy() for c in cols[1:]]
            for k in np.unique(size).tolist():
                cells, values, owners, held = [], [], [], 0
                place = np.full((len(batch), k), -1)

                def settle() -> None:
                    cell, owner, value = np.concatenate(cells), np.concatenate(owners), np.concatenate(values)
                    for row, parent, child, weight in ordered_arcs(place[owner], value, mode):
                        tally.add(cell[row], parent, child, weight)
                    for x in (cells, values, owners):
                        x.clear()

                for i in np.flatnonzero(size == k).tolist():
                    known = np.array([at.get(g, -1) for g in labels[i]])
                    order = np.argsort(known, kind="stable")
                    place[i] = known[order]
                    a, b, copies, ploidy = (np.asarray(x[i], float)[order] for x in numbers)
                    rng, its = draws.stream(seed, int(keys[i])), np.flatnonzero(member[i])
                    most = max(1, CHUNK // (k * nsampling))
                    for lo in range(0, len(its), most):
                        now = its[lo : lo + most]
                        cell = (now[:, None] * nsampling + np.arange(nsampling)).reshape(-1)
                        value = np.clip((ploidy + (copies - ploidy)) * draws.beta(rng, a, b, len(cell)), 0, 1)
                        value[:, place[i] < 0] = 0.0  # genes that are not asked for
                        cells.append(cell)
                        values.append(value)
                        owners.append(np.full(len(cell), i))
                        held += value.size
                        if held >= CHUNK:
                            settle()
                            held = 0
                if held:
                    settle()
            if tally.full():
                yield from _given(tally)
        yield from _given(tally)
        yield from _given(sums)

    return _summed(rows.mapInPandas(draw, _BLOCKS))


def common_kinds(vaf: DataFrame, cols: list[str]) -> DataFrame:
    """vaf with common: whether a mutation's counts and copies are among the KINDS most frequent that occur LEAST times and that
    draws.Binned can hold, or its ccf is certain (no reads altered, or none unaltered and a copy or more)."""
    a, b, c, _ = (F.col(x).cast("double") for x in cols)  # the ccf is copy_number times the share: the ploidy cancels out
    certain = (c > 0) & (((a == 0) & (b > 0)) | ((a > 0) & (b == 0) & (c >= 1)))
    fits = (a >= 1) & (b >= 1) & (a == F.floor(a)) & (b == F.floor(b)) & (c > 0) & (c < 1000) & (F.greatest(a, b) <= (draws.BINS - 1) * F.least(c, F.lit(1.0)))
    kinds = vaf.where(fits).groupBy(*cols).agg(F.count("*").alias("times")).where(F.col("times") >= LEAST)
    kinds = kinds.orderBy(F.desc("times"), *cols).limit(KINDS).select(*cols, F.lit(True).alias("kind"))
    return vaf.join(F.broadcast(kinds), cols, "left").withColumn("common", F.coalesce("kind", F.lit(False)) | F.coalesce(certain, F.lit(False))).drop("kind")


class _Bins:
    """Draws of samples by bins, and their arcs. A sample is (place, altered, unaltered, copies) for each gene and its rounds. Each ccf is
    drawn as a bin of [0, 1]; where two fall into one bin, other than that of 1, the ccfs of the sample are drawn inside their
    bins and compared: those cells wait until there are some of many samples."""

    def __init__(self, seed: int, nsampling: int, sums: Weights, tally: Tally):
        self.seed, self.streams, self.nsampling, self.sums, self.tally = seed, draws.Streams(seed), nsampling, sums, tally
        self.waiting, self.cells = {}, 0

    def add(self, key: int, known: list[tuple], its: np.ndarray) -> None:
        known = [x for x in known if x[1] > 0]  # the others have a ccf of 0: unobserved
        k, reps, genes = len(known), self.nsampling, self.sums.genes
        if k < 2 or not len(its):
            return
        rng = self.streams.of(key)
        tables = [draws.binned(a, b, c) if b > 0 else None for _, a, b, c in known]  # None: the ccf is 1
        every = np.zeros((k, k, *self.sums.shape), np.uint8)
        most = max(1, CHUNK // (k * reps))
        for lo in range(0, len(its), most):
            now = its[lo : lo + most]
            columns, coins = draws.short(rng, 2, k, len(now) * reps)
            columns &= draws.BINS - 1
            value = np.full(columns.shape, draws.BINS - 1, np.uint16)
            for m, t in enumerate(tables):
                if t is not None:
                    value[m] = t.place(rng, columns[m], coins[m])
            arcs, equal = between_tiers(value)
            unsure = np.flatnonzero(((equal > 0) & (value < draws.BINS - 1)).any(0))
            if len(unsure):
                arcs[:, :, unsure] = False
                cell = now[unsure // reps] * reps + unsure % reps
                self.waiting.setdefault(k, []).append((key, known, cell, value[:, unsure], rng.random((2, 6, k, len(unsure)))))
                self.cells += len(unsure)
            every[:, :, now] = arcs.view(np.uint8).reshape(k, k, len(now), reps)
        self.sums.mark([(known[i][0] * genes + known[j][0], every[i, j]) for i in range(k) for j in range(k) if i != j])
        if self.cells > CHUNK >> 3:
            self.settle()

    def settle(self) -> None:
        for k, parts in self.waiting.items():
            ends = np.cumsum([len(p[2]) for p in parts])
            owner, cell = np.repeat(np.arange(len(parts)), np.diff(ends, prepend=0)), np.concatenate([p[2] for p in parts])
            place, a, b, c = np.array([p[1] for p in parts], float)[owner].transpose(2, 1, 0)  # genes x cells
            bins, tries = np.concatenate([p[3] for p in parts], 1), np.concatenate([p[4] for p in parts], 3)
            value, sure = np.empty(bins.shape), b == 0
            value[sure] = 1.0
            value[~sure], left = draws.within(a[~sure], b[~sure], c[~sure], bins[~sure], tries[:, :, ~sure])
            for k_, x in zip(*np.nonzero(~sure), strict=True) if left else ():
                if np.isnan(value[k_, x]):  # a stream of its own for what these tries did not settle
                    more = draws.stream(self.seed, parts[owner[x]][0], int(cell[x]), int(place[k_, x]))
                    one = np.array([[a[k_, x]], [b[k_, x]], [c[k_, x]], [bins[k_, x]]])
                    while np.isnan(value[k_, x]):
                        value[k_, x] = draws.within(*one, more.random((2, 64, 1)))[0][0]
            arcs = between_tiers(value)[0]
            i, j, x = np.nonzero(arcs)
            self.tally.add(cell[x], place[i, x].astype(np.int64), place[j, x].astype(np.int64))
        self.waiting, self.cells = {}, 0


def _summed(parts: DataFrame) -> DataFrame:
    """What the tasks counted, added up; loops dropped."""
    return added(parts.where("parent <> child"), ["iter", "block", "parent", "child"], WIDTH, "weights")


def by_replicate(blocks: DataFrame, names: list[str]) -> DataFrame:
    """Blocks as weighted arcs: iter, rep, parent, child, weight."""
    label = lambda c: F.element_at(F.lit(names), F.col(c) + 1)
    rows = blocks.select("iter", "block", label("parent").alias("parent"), label("child").alias("child"), F.posexplode("weights").alias("k", "weight"))
    return rows.where("weight > 0").select("iter", (F.col("block") * WIDTH + F.col("k")).alias("rep"), "parent", "child", "weight")


def replicate_arcs(vaf: DataFrame, nsampling: int, seed: int, rounds: Rounds | None = None, mode: str = "tiers") -> DataFrame:
    """replicate_blocks() as weighted arcs (iter, rep, parent, child, weight)."""
    names = sorted(r[0] for r in vaf.select("gene_id").distinct().collect())  # a row for each gene
    return by_replicate(replicate_blocks(vaf, names, nsampling, seed, rounds, mode), names)


def subsamples(samples: DataFrame, niterations: int, share: float = 0.8, seed: int = 1) -> Rounds:
    """round(share * n) samples without replacement in each round: those of least hash (the first 60 bits of the MD5 of seed,
    round and sample_id, as hexadecimal digits), equal ones by sample_id.

    As hashes are spread evenly, the last hash taken lies close to share of their range. One pass hashes each sample once for
    each round: hashes below a window of about 12 standard deviations are taken, those inside, some 5 * sqrt(n) for each round,
    are kept beside, and the cut is picked from these. A window that misses a cut is widened, up to all hashes."""
    n = samples.count()
    size = round(share * n)  # halves to even
    if not size:
        return Rounds(samples.limit(0).select("sample_id", F.array().cast("array<bigint>").alias("rounds")), niterations)
    top, wide = 1 << 60, 6 * (share * (1 - share) / n) ** 0.5 + 4 / n
    start = F.lit([f"{seed}:{k}" for k in range(niterations)])
    hashed = spread(samples.select("sample_id"), "sample_id").select("sample_id", F.transform(start, lambda x: F.substring(F.md5(F.concat_ws(":", x, "sample_id").cast("binary")), 1, 15)).alias("h"))
    while True:
        low, high = f"{int(max(0.0, share - wide) * top):015x}", f"{min(top - 1, int((share + wide) * top) + 1):015x}"
        near = F.filter(F.transform("h", lambda h, k: F.struct(k.alias("iter"), h.alias("h"))), lambda x: (x["h"] >= low) & (x["h"] <= high))
        held = stored(hashed.select("sample_id", as_words([F.col("h")[k] < low for k in range(niterations)]).alias("rounds"), near.alias("near")))
        below = vectors(held, [], niterations).first().counts
        found = held.select("sample_id", F.explode("near").alias("x")).groupBy("x.iter").agg(F.sort_array(F.collect_list(F.struct("x.h", "sample_id"))).alias("near"))
        found = found.select("iter", F.get("near", F.get(F.lit([size - b - 1 for b in below]), F.col("iter")).cast("int")).alias("cut"))
        cuts = {r.iter: r.cut for r in found.collect() if r.cut is not None}  # a row for each round
        if len(cuts) == niterations:
            break
        wide *= 8
    cut_h, cut_id = F.lit([cuts[k].h for k in range(niterations)]), F.lit([cuts[k].sample_id for k in range(niterations)])

    def taken(x: Column) -> Column:
        cut = F.get(cut_h, x["iter"])
        return (x["h"] < cut) | ((x["h"] == cut) & (F.col("sample_id") <= F.get(cut_id, x["iter"])))

    def word(w: int) -> Column:
        bit = lambda k: F.when(F.floor(k / WORD) == w, F.call_function("shiftleft", F.lit(1).cast("long"), k % WORD)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.filter("near", taken), F.col("rounds")[w], lambda acc, x: acc.bitwiseOR(bit(x["iter"])))

    members = held.select("sample_id", F.array(*[word(w) for w in range(words_for(niterations))]).alias("rounds"))
    return Rounds(members.where(F.exists("rounds", lambda w: w != 0)), niterations)


def memberships(rounds: Rounds) -> DataFrame:
    """(iter, sample_id) of all rounds, for reports."""
    rows = rounds.members.select("sample_id", F.posexplode("rounds").alias("w", "bits"))
    rows = rows.select("sample_id", "w", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).where(F.getbit("bits", F.col("k")) == 1)
    return rows.select((F.col("w") * 64 + F.col("k")).alias("iter"), "sample_id")


def _in_buckets(rows: DataFrame, keys: list[str], count: int, nsampling: int, seed: int) -> tuple[DataFrame, draws.Split]:
    """rows (one for each of keys, with counts: how many samples it stands for in each round) dealt out by bucket and sorted by keys,
    and the draws of the buckets."""
    rows = stored(rows)
    n = rows.count()
    buckets = 1 << max(0, min(n // BUCKET, MAX_COUNTS // count)).bit_length()
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = np.zeros((buckets, count), np.int64)
    for r in added(placed, ["bucket"], count).collect():  # at most 2 * MAX_COUNTS numbers
        counts[r.bucket] = r.counts
    return spread(placed, "bucket").sortWithinPartitions("bucket", *keys), draws.Split(counts, nsampling, seed)


def _by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one bucket at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for bucket, part in batch.groupby("bucket", sort=False):
            if held and held[0].bucket.iat[0] != bucket:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def bootstrap(samples: DataFrame, nsampling: int, seed: int = 1, rounds: Rounds | None = None) -> DataFrame:
    """(iter, rep, sample_id, multiplicity): per replicate, as many draws with replacement as there are samples in the round."""
    count = size_of(rounds)
    rows = joined(samples.select("sample_id"), rounds).select("sample_id", flags(count).alias("counts"))
    rows, split = _in_buckets(rows, ["sample_id"], count, nsampling, seed)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _by_bucket(batches):
            names = part.sample_id.to_numpy()
            for it, inside, many in split.rounds(int(part.bucket.iat[0]), np.stack(part.counts.to_numpy())):
                at, rep = np.nonzero(many)
                yield pd.DataFrame({"iter": np.int32(it), "rep": rep.astype(np.int32), "sample_id": names[inside[at]], "multiplicity": many[at, rep].astype(np.int64)})

    return rows.mapInPandas(draw, "iter int, rep int, sample_id string, multiplicity long")


def trees_alike(trees: DataFrame, samples: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """Nested trees (sample_id, nodes, edges) counted by shape: nodes, edges, drawn (trees with a node, of these samples) and counts
    for each round. The arrays are the whole tree, so equal trees are one row, summed on the map side."""
    tree = F.coalesce(F.size("nodes") > 0, F.lit(False))
    if rounds is None:
        asked = samples.select("sample_id", F.lit(True).alias("asked")).distinct()
        rows = joined(trees.join(asked, "sample_id", "left"), None).withColumn("drawn", tree & F.coalesce("asked", F.lit(False)))
    else:
        rows = joined(trees, rounds).withColumn("drawn", tree)
    return vectors(rows, ["nodes", "edges", "drawn"], size_of(rounds))


def bootstrap_blocks(nodes: DataFrame, edges: DataFrame, names: list[str], nsampling: int, seed: int = 1, rounds: Rounds | None = None) -> DataFrame:
    """F2 with D3, D4: tree_blocks() with each tree by itself: the arcs of the trees that bootstrap() draws. A tree is a sample with a node."""
    arcs = edges.groupBy("sample_id").agg(F.collect_list(F.struct("parent", "child")).alias("arcs"))
    trees = joined(nodes.select("sample_id").distinct().join(arcs, "sample_id", "left"), rounds)
    return tree_blocks(trees.select("sample_id", "arcs", flags(size_of(rounds)).alias("counts")), ["sample_id"], names, nsampling, seed, size_of(rounds))


def tree_blocks(trees: DataFrame, keys: list[str], names: list[str], nsampling: int, seed: int = 1, count: int = 1) -> DataFrame:
    """F2 with D3, D4: iter, block, parent, child (places in names), weights: the arcs of as many trees as the round has, drawn with
    replacement, in each replicate. trees: one row for each of keys, with arcs (array of parent and child) and counts: how many
    trees of each round are like this.

    The draws of a round are split over buckets of rows by their counts, then dealt to the rows in the task that holds the
    bucket (draws.Split), where the arcs are summed: no draw is a row."""
    at, genes = {g: k for k, g in enumerate(names)}, len(names)
    rows, split = _in_buckets(trees.select(*dict.fromkeys([*keys, "arcs", "counts"])), keys, count, nsampling, seed)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Weights(count, nsampling, genes)
        for part in _by_bucket(batches):
            arcs = [(at[x["parent"]] * genes + at[x["child"]], i) for i, row in enumerate(part.arcs) if row is not None for x in row if x["parent"] in at and x["child"] in at]
            weight = np.stack(part.counts.to_numpy())
            kind = np.uint16 if weight.max(initial=0) <= draws.LIGHT else np.int64
            most = max(1, HELD // (len(part) * nsampling * np.dtype(kind).itemsize))
            its, many = [], np.zeros((len(part), min(most, count), nsampling), kind)

            def settle() -> None:
                where = slice(its[0], its[-1] + 1) if its[-1] - its[0] == len(its) - 1 else np.array(its)
                for code, row in arcs:
                    sums.add(code, where, many[row, : len(its)])
                its.clear()
                many[...] = 0

            for it, inside, drawn in split.rounds(int(part.bucket.iat[0]), weight):
                many[inside, len(its)] = drawn
                its.append(it)
                if len(its) == most:
                    settle()
            if its:
                settle()
            if sums.full():
                yield from _given(sums)
        yield from _given(sums)

    return _summed(rows.mapInPandas(draw, _BLOCKS))


def frequencies(edges: DataFrame, niterations: int) -> DataFrame:
    """share of iterations that have an edge; with regularization where there is one."""
    keys = [c for c in ("regularization", "parent", "child") if c in edges.columns]
    return edges.groupBy(*keys).agg((F.count("*").cast("double") / niterations).alias("frequency"))


def mean_over_iterations(ranking: DataFrame, niterations: int) -> DataFrame:
    """not rounded."""
    return ranking.groupBy("gene_id").agg((F.sum("rank").cast("double") / niterations).alias("rank"))
