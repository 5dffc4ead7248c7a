"""Strong parts and the ranking part by part: against reachability of all pairs, and against the whole graph in one task."""

import numpy as np
import pytest

from antecede.functions import agony
from antecede.jobs import inference
from antecede.operators import ranking, strong

SCHEMA = "iter int, rep int, parent string, child string, weight long"


def graphs(count=12, seed=5):
    """Random graphs as replicates, sparse to dense, with loops and equal arcs."""
    rng = np.random.default_rng(seed)
    rows = []
    for rep in range(count):
        n = int(rng.integers(2, 26))
        m = int(n * rng.choice([0.7, 1.1, 1.6, 3.0])) + 1
        rows += [(rep % 2, rep, f"g{a:02d}", f"g{b:02d}", int(w)) for a, b, w in zip(*rng.integers(0, n, (2, m)), rng.integers(1, 6, m), strict=True)]
    return rows


def reach(arcs):
    names = sorted({x for a in arcs for x in a})
    at = {x: k for k, x in enumerate(names)}
    r = np.eye(len(names), dtype=bool)
    for a, b in arcs:
        r[at[a], at[b]] = True
    for k in range(len(names)):
        r |= np.outer(r[:, k], r[k])
    return names, r


def test_strong_parts_are_mutual_reach(spark):
    rows = graphs()
    got = {(r.iter, r.rep, r.gene_id): r.part for r in strong.strong_parts(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        names, r = reach([x[2:4] for x in rows if x[:2] == key and x[2] != x[3]])
        for k, name in enumerate(names):
            want[(*key, name)] = names[int(np.flatnonzero(r[k] & r[:, k])[0])]
    assert got == want
    sizes = np.bincount(np.unique([f"{k[1]} {p}" for k, p in got.items()], return_inverse=True)[1])
    assert (sizes > 1).sum() > 5 and (sizes == 1).sum() > 5


def test_ranks_by_parts_are_those_of_the_whole(spark):
    arcs = spark.createDataFrame(graphs(14, 6), SCHEMA)
    key = lambda df: sorted(tuple(r) for r in df.select("iter", "rep", "gene_id", "rank", "agony", "circulation").collect())
    got = key(strong.minimum_agony(arcs))
    assert got == key(ranking.minimum_agony(arcs)) and all(r[4] == r[5] for r in got) and any(r[4] for r in got)


def test_odd_input(spark):
    make = lambda rows: spark.createDataFrame(rows, "parent string, child string, weight long")
    assert strong.minimum_agony(make([])).count() == 0 and strong.strong_parts(make([("a", "a", 1)])).count() == 0
    rows = [("a", "b", 1), ("b", "a", 2), ("b", "c", 1), ("c", "c", 9), (None, "c", 1), ("x", None, 1), ("y", "z", 0), ("c", "d", 1)]
    got = {r.gene_id: r["rank"] for r in strong.minimum_agony(make(rows)).collect()}
    names, rank, *_ = agony.solve(["a", "b", "b", "c", "y"], ["b", "a", "c", "d", "z"], [1, 2, 1, 1, 0])
    assert got == dict(zip(names, rank.tolist(), strict=True))


def test_a_part_is_raised_gene_by_gene(spark):
    """A chain enters a cycle in the middle: only what lies above that place is raised."""
    rows = [("a", "b", 5), ("b", "c", 5), ("c", "a", 1), ("p", "q", 1), ("q", "r", 1), ("r", "s", 1), ("s", "c", 1), ("c", "t", 1)]
    arcs = spark.createDataFrame(rows, "parent string, child string, weight long")
    got = {r.gene_id: r["rank"] for r in inference.rank_arcs(arcs, by_parts=True).collect()}
    assert got == {r.gene_id: r["rank"] for r in inference.rank_arcs(arcs).collect()}
    assert (got["a"], got["c"], got["t"]) == (0, 4, 5) or got["c"] - got["a"] >= 2


@pytest.mark.parametrize("count", [20_000])
def test_many_small_cycles_run_in_many_tasks(spark, count):
    """A graph of 5 x count genes in cycles of five that hang together two by two: each part is a group, none sees the graph."""
    from pyspark.sql import functions as F

    c = spark.range(count).withColumnRenamed("id", "c")
    name = lambda k: F.format_string("%06d-%d", "c", k % 5)
    ring = [F.struct(name(F.lit(k)).alias("parent"), name(F.lit(k + 1)).alias("child"), F.lit(1 if k == 4 else 3).cast("long").alias("weight")) for k in range(5)]
    arcs = c.select(F.explode(F.array(*ring)).alias("x")).select("x.*")
    link = c.where("c % 2 = 0").select(name(F.lit(4)).alias("parent"), F.format_string("%06d-0", F.col("c") + 1).alias("child"), F.lit(1).cast("long").alias("weight"))
    out = strong.minimum_agony(arcs.union(link))
    got = {r["at"]: (r.low, r.high, r.n) for r in out.withColumn("at", F.expr("int(substring(gene_id, 1, 6)) % 2 * 10 + int(right(gene_id, 1))")).groupBy("at").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count("*").alias("n")).collect()}
    assert got == {s * 10 + k: (s * 5 + k, s * 5 + k, count // 2) for s in (0, 1) for k in range(5)}
    assert out.select("agony", "circulation").distinct().collect() == [(5 * count, 5 * count)]
