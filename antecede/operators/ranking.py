"""Hierarchy ranking of arcs, mean ranks, posets and the probability-raising filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.functions import agony
from antecede.functions.tally import WIDTH
from antecede.sources.tables import spread, stored

KEYS = ["iter", "rep"]


def with_keys(arcs: DataFrame) -> DataFrame:
    for k in KEYS:
        if k not in arcs.columns:
            arcs = arcs.withColumn(k, F.lit(0))
    return arcs.select(*KEYS, "parent", "child", "weight")


def _rank(key: tuple, arcs: pd.DataFrame) -> pd.DataFrame:
    names, rank, score, flow = agony.solve(arcs.parent.tolist(), arcs.child.tolist(), arcs.weight.tolist())
    return pd.DataFrame({"iter": key[0], "rep": key[1], "gene_id": names, "rank": rank, "agony": score, "circulation": flow})


def minimum_agony(arcs: DataFrame) -> DataFrame:
    """Iter, rep, gene_id, rank, agony, circulation. A group is one graph, at most genes ** 2 weighted arcs; a graph of
    more than a few thousand genes is one task and should go to dag_ranks() if it has no cycle."""
    arcs = with_keys(arcs).where("parent <> child")
    return spread(arcs, *KEYS).groupBy(*KEYS).applyInPandas(_rank, "iter int, rep int, gene_id string, rank int, agony long, circulation long")


def minimum_agony_blocks(blocks: DataFrame, names: list[str]) -> DataFrame:
    """E1, E3 for replicates in blocks (iter, block, parent, child, weights; parent and child are places in names): as
    minimum_agony(). A group is WIDTH graphs on the same arcs, each solved from the one before."""

    def rank(key: tuple, arcs: pd.DataFrame) -> pd.DataFrame:
        used, ends = np.unique(np.concatenate([arcs.parent, arcs.child]), return_inverse=True)
        u, v = np.split(ends, 2)
        weights = np.stack(arcs.weights.to_numpy()).astype(np.int64)
        ranks, score, flow = agony.solve_all(len(used), u, v, weights)
        seen = np.zeros((WIDTH, len(used)), bool)  # genes that have an arc in the replicate
        row, rep = np.nonzero(weights)
        seen[rep, u[row]] = seen[rep, v[row]] = True
        rep, at = np.nonzero(seen)
        labels = np.array(names, object)[used[at]]
        return pd.DataFrame({"iter": key[0], "rep": key[1] * WIDTH + rep, "gene_id": labels, "rank": ranks[rep, at], "agony": score[rep], "circulation": flow[rep]})

    keys = ["iter", "block"]
    return spread(blocks, *keys).groupBy(*keys).applyInPandas(rank, "iter int, rep int, gene_id string, rank int, agony long, circulation long")


def dag_ranks(arcs: DataFrame) -> DataFrame:
    """E3 for arcs without cycles, as DataFrame rounds: rank = longest path from a root. A cycle is reported as an error."""
    arcs = stored(with_keys(arcs).select(*KEYS, "parent", "child").distinct())
    nodes = arcs.select(*KEYS, F.explode(F.array("parent", "child")).alias("gene_id")).distinct()
    ranks = stored(nodes.withColumn("rank", F.lit(0)))
    most = nodes.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0
    for _ in range(most + 1):
        raised = arcs.join(ranks.withColumnRenamed("gene_id", "parent"), [*KEYS, "parent"]).groupBy(*KEYS, F.col("child").alias("gene_id"))
        raised = raised.agg((F.max("rank") + 1).alias("up"))
        new = stored(ranks.join(raised, [*KEYS, "gene_id"], "left").select(*KEYS, "gene_id", F.greatest("rank", "up").alias("rank"), (F.coalesce("up", F.lit(0)) > F.col("rank")).alias("moved")))
        ranks = new.drop("moved")
        if new.where("moved").isEmpty():
            return ranks
    raise ValueError("the arcs have a cycle")


def agony_score(arcs: DataFrame, ranking: DataFrame) -> DataFrame:
    """Agony of a given ranking, per (iter, rep)."""
    arcs, r = with_keys(arcs), ranking.select(*KEYS, "gene_id", "rank")
    both = arcs.join(r.select(*KEYS, F.col("gene_id").alias("parent"), F.col("rank").alias("rp")), [*KEYS, "parent"])
    both = both.join(r.select(*KEYS, F.col("gene_id").alias("child"), F.col("rank").alias("rc")), [*KEYS, "child"])
    return both.groupBy(*KEYS).agg(F.sum(F.col("weight") * F.greatest(F.col("rp") - F.col("rc") + 1, F.lit(0))).alias("agony"))


def mean_ranks(ranking: DataFrame, genes: DataFrame, iters: DataFrame) -> DataFrame:
    """Per iter and gene, the mean over the replicates that have an arc, halves to even; a gene absent from one adds 0."""
    divisor = ranking.groupBy("iter").agg(F.count_distinct("rep").alias("reps"))
    sums = ranking.groupBy("iter", "gene_id").agg(F.sum("rank").alias("total"))
    every = iters.select("iter").crossJoin(F.broadcast(genes.select("gene_id")))
    rows = every.join(F.broadcast(divisor), "iter", "left").join(sums, ["iter", "gene_id"], "left")
    return rows.select("iter", "gene_id", F.coalesce(F.bround(F.col("total") / F.col("reps")), F.lit(0.0)).cast("int").alias("rank"))


def poset(ranking: DataFrame) -> DataFrame:
    """E5: iter, parent, child where the parent's rank is below the child's. ranking: (iter, gene_id, rank), small."""
    r = ranking.select("iter", "gene_id", "rank")
    low = r.select("iter", F.col("gene_id").alias("parent"), F.col("rank").alias("low"))
    high = r.select("iter", F.col("gene_id").alias("child"), F.col("rank").alias("high"))
    return low.join(high, (low.iter == high.iter) & (F.col("low") < F.col("high"))).select(low.iter, "parent", "child")


def single_poset(arcs: DataFrame, genes: DataFrame, iters: DataFrame) -> DataFrame:
    """Poset of one arc set per iter; only genes in an arc take part; without any arc, every ordered pair."""
    arcs = with_keys(arcs)
    made = poset(minimum_agony(arcs))
    g = genes.select("gene_id")
    every = g.select(F.col("gene_id").alias("parent")).crossJoin(g.select(F.col("gene_id").alias("child"))).where("parent <> child")
    bare = iters.select("iter").join(arcs.select("iter").distinct(), "iter", "left_anti")
    return made.unionByName(bare.crossJoin(F.broadcast(every)))


def probability_raising(edges: DataFrame, p_model: DataFrame, p_null: DataFrame) -> DataFrame:
    """Edges whose p_model exceeds p_null."""
    both = p_model.join(p_null, ["iter", "gene_i", "gene_j"]).where("p_model > p_null")
    return edges.join(both.select("iter", F.col("gene_i").alias("parent"), F.col("gene_j").alias("child")), ["iter", "parent", "child"], "left_semi")
