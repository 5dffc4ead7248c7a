"""Marginal, joint, null and precedence probabilities.

Pairs come from one array for each sample, filtered to the genes first, so a sample adds at most genes ** 2 / 2 rows and a
self-join never meets a hot sample; only unordered pairs are made and mirrored after the count. `rounds` holds the
cross-validation rounds of a sample as bits (round 0 without any); a pair is counted for all of them at once, and only counts
become rows by iter. count: how many rounds there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.operators.rounds import Rounds, added, joined, size_of, unrolled, vectors
from antecede.sources.tables import spread


def packed(ccf: DataFrame, rounds: Rounds | None = None, once: bool = False) -> DataFrame:
    """sample_id, muts (array of gene_id and ccf by gene), rounds. once: equal rows count once."""
    rows = spread(ccf.where((F.col("ccf") > 0) & ~F.isnan("ccf")).select("sample_id", "gene_id", "ccf"), "sample_id")
    collect = F.collect_set if once else F.collect_list
    return joined(rows.groupBy("sample_id").agg(F.sort_array(collect(F.struct("gene_id", "ccf"))).alias("muts")), rounds)


def sample_counts(samples: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """iter, n: all samples count, also those without a mutation."""
    if rounds is None:
        return samples.agg(F.count("*").alias("n")).select(F.lit(0).alias("iter"), "n")
    return unrolled(vectors(rounds.members, [], rounds.count), "n")


def pair_counts(pack: DataFrame, count: int = 1) -> DataFrame:
    """iter, gene_i < gene_j: both (samples with the two), up and down (those where gene_i's ccf is larger, smaller)."""

    def pair(i, j):
        a, b = F.col("muts")[i], F.col("muts")[j]
        side = F.when(a["ccf"] > b["ccf"], 1).when(a["ccf"] < b["ccf"], -1).otherwise(0)
        return F.struct(a["gene_id"].alias("gene_i"), b["gene_id"].alias("gene_j"), side.alias("side"))

    last = F.size("muts") - 1
    every = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: pair(i, j))))
    pairs = pack.where(F.size("muts") > 1).select("rounds", F.explode(every).alias("p")).select("rounds", "p.*")
    sums = unrolled(vectors(pairs, ["gene_i", "gene_j", "side"], count), "c").groupBy("iter", "gene_i", "gene_j")
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("c")).otherwise(0))
    return sums.agg(F.sum("c").alias("both"), of(1).alias("up"), of(-1).alias("down"))


def _mirrored(pairs: DataFrame) -> DataFrame:
    back = {"gene_i": "gene_j", "gene_j": "gene_i", "up": "down", "down": "up"}
    return pairs.unionByName(pairs.select(*[F.col(back.get(c, c)).alias(c) for c in pairs.columns]))


def gene_counts(pack: DataFrame, count: int = 1) -> DataFrame:
    return unrolled(vectors(pack.select("rounds", F.explode("muts.gene_id").alias("gene_id")), ["gene_id"], count), "c")


def marginals(pack: DataFrame, n: DataFrame, count: int = 1) -> DataFrame:
    """C1."""
    return gene_counts(pack, count).join(F.broadcast(n), "iter").select("iter", "gene_id", (F.col("c").cast("double") / F.col("n")).alias("p"))


def joint_counts(pack: DataFrame, pairs: DataFrame | None = None, count: int = 1) -> DataFrame:
    """iter, gene_i, gene_j, c: ordered pairs and the diagonal. pairs: pair_counts(pack), where it is made already."""
    pairs = (pair_counts(pack, count) if pairs is None else pairs).select("iter", "gene_i", "gene_j", F.col("both").alias("c"))
    same = gene_counts(pack, count).select("iter", F.col("gene_id").alias("gene_i"), F.col("gene_id").alias("gene_j"), "c")
    return _mirrored(pairs).unionByName(same)


def joints(pack: DataFrame, n: DataFrame, count: int = 1) -> DataFrame:
    """All ordered pairs that co-occur, with the diagonal."""
    return joint_counts(pack, None, count).join(F.broadcast(n), "iter").select("iter", "gene_i", "gene_j", (F.col("c").cast("double") / F.col("n")).alias("p"))


def grid(genes: DataFrame, n: DataFrame) -> DataFrame:
    """iter x ordered pairs of different genes: genes ** 2 rows for each round."""
    g = F.broadcast(genes.select("gene_id"))
    both = g.withColumnRenamed("gene_id", "gene_i").crossJoin(g.withColumnRenamed("gene_id", "gene_j")).where("gene_i <> gene_j")
    return both.crossJoin(F.broadcast(n))


def p_null(pack: DataFrame, genes: DataFrame, n: DataFrame, pairs: DataFrame | None = None, count: int = 1) -> DataFrame:
    """P(i and not j) = P(i) - P(i, j), from counts. pairs: pair_counts(pack), where it is made already."""
    one = gene_counts(pack, count).select("iter", F.col("gene_id").alias("gene_i"), F.col("c").alias("ci"))
    two = joint_counts(pack, pairs, count).where("gene_i <> gene_j")
    rows = grid(genes, n).join(one, ["iter", "gene_i"], "left").join(two, ["iter", "gene_i", "gene_j"], "left").fillna(0, ["ci", "c"])
    return rows.select("iter", "gene_i", "gene_j", (F.col("ci").cast("double") / F.col("n") - F.col("c").cast("double") / F.col("n")).alias("p_null"))


def _on_grid(counts: DataFrame, genes: DataFrame, n: DataFrame, value: Column) -> DataFrame:
    rows = grid(genes, n).join(counts, ["iter", "gene_i", "gene_j"], "left")
    return rows.select("iter", "gene_i", "gene_j", F.coalesce(value, F.lit(0.0)).alias("p_model"))


def p_model_ccf(pack: DataFrame, genes: DataFrame, n: DataFrame, pairs: DataFrame | None = None, count: int = 1) -> DataFrame:
    """C4: among samples with both, the share in which i has the larger ccf; ties count below only, no co-occurrence is 0.
    pairs: pair_counts(pack), where it is made already."""
    counts = _mirrored(pair_counts(pack, count) if pairs is None else pairs)
    return _on_grid(counts, genes, n, F.col("up").cast("double") / F.col("both"))


def p_model_trees(nodes: DataFrame, edges: DataFrame, genes: DataFrame, n: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """Direct parent-child edges over trees that hold both labels."""
    count = size_of(rounds)
    held = packed(nodes.select("sample_id", "gene_id").distinct().withColumn("ccf", F.lit(1.0)), rounds)
    direct = joined(edges.select("sample_id", F.col("parent").alias("gene_i"), F.col("child").alias("gene_j")), rounds)
    direct = unrolled(vectors(direct, ["gene_i", "gene_j"], count), "up")
    counts = joint_counts(held, None, count).withColumnRenamed("c", "both").join(direct, ["iter", "gene_i", "gene_j"], "left")
    return _on_grid(counts, genes, n, F.try_divide(F.col("up").cast("double"), F.col("both")))


def shape_arcs(alike: DataFrame, count: int = 1) -> DataFrame:
    """iter, parent, child, weight: the edges of trees counted by shape (resample.trees_alike())."""
    rows = alike.select("counts", F.explode("edges").alias("e")).select("e.parent", "e.child", "counts").where("parent <> child")
    return unrolled(added(rows, ["parent", "child"], count), "weight")


def p_model_shapes(alike: DataFrame, genes: DataFrame, n: DataFrame, count: int = 1) -> DataFrame:
    """C5-C7 of trees counted by shape: nodes, edges, counts."""
    last = F.size("nodes") - 1
    node = lambda k: F.get("nodes", k)
    both = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: F.struct(node(i).alias("gene_i"), node(j).alias("gene_j")))))
    pairs = alike.where(F.size("nodes") > 1).select("counts", F.explode(both).alias("p")).select("p.*", "counts")
    pairs = unrolled(added(pairs, ["gene_i", "gene_j"], count), "both")
    pairs = pairs.unionByName(pairs.select("iter", F.col("gene_j").alias("gene_i"), F.col("gene_i").alias("gene_j"), "both"))
    direct = alike.select("counts", F.explode("edges").alias("e")).select(F.col("e.parent").alias("gene_i"), F.col("e.child").alias("gene_j"), "counts")
    counts = pairs.join(unrolled(added(direct, ["gene_i", "gene_j"], count), "up"), ["iter", "gene_i", "gene_j"], "left")
    return _on_grid(counts, genes, n, F.try_divide(F.col("up").cast("double"), F.col("both")))
