"""Rounds of cross-validation counted at once, draws over trees, datasets of their own and wide profiles."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.jobs import inference
from antecede.operators import learn, probabilities, resample
from antecede.operators.rounds import Rounds, rounds_of


def frame(spark, names, kind):
    return spark.createDataFrame([(x,) for x in names], f"{kind} string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def mutations(spark, n, genes, seed):
    rng = np.random.default_rng(seed)
    out = [(f"s{i}", f"g{k}", float(rng.integers(1, 5)) / 4) for i in range(n) for k in range(genes) if rng.random() < 0.4]
    return spark.createDataFrame(out, "sample_id string, gene_id string, ccf double"), frame(spark, [f"s{i}" for i in range(n)], "sample_id")


@pytest.mark.parametrize("share", [0.8, 0.0, 1.0])
def test_subsamples_are_those_of_least_hash(spark, share):
    names = [f"s{k}" for k in range(137)]
    got = resample.subsamples(frame(spark, names, "sample_id"), 70, share, seed=3)  # more rounds than a word has bits
    held = {}
    for it, s in rows(resample.memberships(got), "iter", "sample_id"):
        held.setdefault(it, set()).add(s)
    for it in range(70):
        order = sorted(names, key=lambda s: (hashlib.md5(f"3:{it}:{s}".encode()).hexdigest()[:15], s))
        assert held.get(it, set()) == set(order[: round(share * 137)])


def test_counts_of_all_rounds_are_those_of_each(spark):
    c, samples = mutations(spark, 80, 5, 1)
    member = samples.crossJoin(spark.range(67).select(F.col("id").cast("int").alias("iter"))).where("pmod(xxhash64(sample_id, iter), 3) > 0").persist()
    rounds, genes = rounds_of(member, 67), frame(spark, [f"g{k}" for k in range(6)], "gene_id")
    n, pack = probabilities.sample_counts(samples, rounds), probabilities.packed(c, rounds)
    whole = {
        "null": rows(probabilities.p_null(pack, genes, n, count=67), "iter", "gene_i", "gene_j", "p_null"),
        "model": rows(probabilities.p_model_ccf(pack, genes, n, count=67), "iter", "gene_i", "gene_j", "p_model"),
        "profiles": rows(learn.profiles(pack, n, 67), "iter", "genes", "n"),
    }
    for it in (0, 40, 66):
        some = member.where(F.col("iter") == it)
        alone = probabilities.packed(c.join(some, "sample_id"))
        m = probabilities.sample_counts(some)
        assert [r[1:] for r in whole["null"] if r[0] == it] == rows(probabilities.p_null(alone, genes, m), "gene_i", "gene_j", "p_null")
        assert [r[1:] for r in whole["model"] if r[0] == it] == rows(probabilities.p_model_ccf(alone, genes, m), "gene_i", "gene_j", "p_model")
        assert [r[1:] for r in whole["profiles"] if r[0] == it] == rows(learn.profiles(alone, m), "genes", "n")


def test_climb_of_all_rounds_is_that_of_each(spark):
    c, samples = mutations(spark, 150, 6, 2)
    member = samples.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("iter"))).where("pmod(xxhash64(sample_id, iter), 4) > 0")
    rounds, names = rounds_of(member, 3), [f"g{k}" for k in range(6)]
    pack, n = probabilities.packed(c, rounds), probabilities.sample_counts(samples, rounds)
    edges = spark.createDataFrame([(it, f"g{i}", f"g{j}") for it in range(3) for j in range(6) for i in range(j) if (i + j + it) % 4], "iter int, parent string, child string")
    key = ["regularization", "parent", "child"]
    for search in (lambda p, e, m, **k: learn.hill_climb(p, e, m, restarts=3, **k), learn.tabu_search):
        whole = rows(search(learn.bit_profiles(pack, names, n, 3), edges, n), "iter", *key)
        for it in range(3):
            alone = learn.profiles(pack, n, 3).where(F.col("iter") == it).withColumn("iter", F.lit(0))
            found = search(alone, edges.where(F.col("iter") == it).withColumn("iter", F.lit(0)), n.where(F.col("iter") == it).withColumn("iter", F.lit(0)))
            assert [r[1:] for r in whole if r[0] == it] == rows(found, *key)
    large = learn.hill_climb(learn.bit_profiles(pack, names, n, 3), edges, n, restarts=3, max_cells=0)
    assert rows(large, "iter", *key) == rows(learn.hill_climb(learn.bit_profiles(pack, names, n, 3), edges, n, restarts=3), "iter", *key)


def test_trees_alone_are_drawn(spark):
    """Patients without a tree take no draw away, and the trees are those of the round."""
    trees = spark.createDataFrame([(f"t{k}", "A", "B") for k in range(30)], "sample_id string, parent string, child string")
    nodes = trees.select("sample_id", F.explode(F.array("parent", "child")).alias("gene_id"))
    blocks = resample.bootstrap_blocks(nodes.select("sample_id"), trees, ["A", "B"], 40, 5)
    assert [r.weight for r in resample.by_replicate(blocks, ["A", "B"]).collect()] == [30] * 40
    members = spark.createDataFrame([(f"t{k}", [3 if k < 10 else 1]) for k in range(30)] + [(f"bare{k}", [3]) for k in range(50)], "sample_id string, rounds array<bigint>")
    blocks = resample.bootstrap_blocks(nodes.select("sample_id"), trees, ["A", "B"], 40, 5, Rounds(members, 2))
    assert {(r.iter, r.weight) for r in resample.by_replicate(blocks, ["A", "B"]).collect()} == {(0, 30), (1, 10)}
    everyone = frame(spark, [f"t{k}" for k in range(30)] + [f"bare{k}" for k in range(50)], "sample_id")
    out = inference.tree_bootstrap(nodes, nodes, trees, everyone, frame(spark, "AB", "gene_id"), nsampling=2, restarts=0)
    assert rows(out.poset, "parent", "child") == [("A", "B")]


def test_arcs_of_a_bootstrap_are_those_of_the_trees_drawn(spark):
    rng = np.random.default_rng(8)
    edges = [(f"t{k}", f"g{a}", f"g{b}") for k in range(700) for a, b in rng.integers(0, 5, (2, 2)) if a != b]
    edges = spark.createDataFrame(edges, "sample_id string, parent string, child string")
    names = frame(spark, [f"t{k}" for k in range(700)], "sample_id")
    drawn = resample.bootstrap(names, 30, 3).join(edges, "sample_id").groupBy("rep", "parent", "child").agg(F.sum("multiplicity").alias("weight"))
    genes = [f"g{k}" for k in range(5)]
    for part in (names, names.repartition(5)):
        got = resample.by_replicate(resample.bootstrap_blocks(part, edges, genes, 30, 3), genes)
        assert rows(got, "rep", "parent", "child", "weight") == rows(drawn, "rep", "parent", "child", "weight")


def test_dataset_gives_null_model_and_parents(spark):
    """Mutations observed without a ccf count in the null model and in the parent search, those with a ccf alone give the order."""
    c = spark.createDataFrame([(f"s{k}", g, x) for k in range(40) for g, x in (("A", 0.9), ("B", 0.4))], "sample_id string, gene_id string, ccf double")
    samples, genes = frame(spark, [f"s{k}" for k in range(100)], "sample_id"), frame(spark, "ABC", "gene_id")
    seen = c.select("sample_id", "gene_id").union(samples.select("sample_id", F.lit("C")))  # C has no ccf at all
    t = inference._Tables.of(c, samples, genes, seen, None)
    null = dict(((i, j), p) for i, j, p in rows(probabilities.p_null(t.seen, genes, t.n), "gene_i", "gene_j", "p_null"))
    assert null["C", "A"] == pytest.approx(0.6) and null["A", "C"] == pytest.approx(0.0)
    assert {g for r in learn.profiles(t.seen, t.n).collect() for g in r.genes} == {"A", "B", "C"}
    out = inference.ccf_inference(c, samples, genes, restarts=0, dataset=seen)
    assert rows(out.poset, "parent", "child") == [("A", "B")] and set(rows(out.inference, "parent", "child")) == {("A", "B")}
    some = seen.where("sample_id < 's2'")  # most of the ccfs are not in the dataset: no raised null, no parents from them
    t = inference._Tables.of(c, samples, genes, some, None)
    assert sum(r.n for r in learn.profiles(t.seen, t.n).collect() if r.genes) == some.select("sample_id").distinct().count()
    none = inference.ccf_confidence(c, samples, genes, None, niterations=2, restarts=0, dataset=seen)
    assert rows(none.poset, "parent", "child", "frequency") == [("A", "B", 1.0)]


def test_wide_profiles(spark):
    """500 genes, 100,000 samples: profiles as bits, projected on each child's candidates."""
    genes = [f"g{k:03d}" for k in range(500)]
    c = spark.range(400_000).select(F.concat(F.lit("s"), F.col("id") % 100_000).alias("sample_id"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("k")).distinct()
    c = c.select("sample_id", F.concat(F.lit("g"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("gene_id"), F.lit(1.0).alias("ccf"))
    samples = spark.range(100_000).select(F.concat(F.lit("s"), F.col("id")).alias("sample_id"))
    pack, n = probabilities.packed(c).persist(), probabilities.sample_counts(samples)
    held = learn.bit_profiles(pack, genes, n)
    edges = [(0, genes[p], genes[x]) for x in (7, 63, 64, 499) for p in (0, 62, 65, 127, 128, 300) if p < x]
    made = learn.tables(held, spark.createDataFrame(edges, "iter int, parent string, child string"))
    got = rows(made.select(F.col("child"), learn.labels(F.col("config"), genes).alias("config"), "x", F.col("counts")[0].alias("n")), "child", "config", "x", "n")
    for x in (7, 64, 499):
        cands = sorted(p for _, p, child in edges if child == genes[x])
        want = pack.select(F.array_intersect(F.array(*[F.lit(g) for g in cands]), "muts.gene_id").alias("config"), F.array_contains("muts.gene_id", genes[x]).cast("int").alias("x"))
        want = {(tuple(r.config), r.x): r["count"] for r in want.groupBy("config", "x").count().collect()}
        want[(), 0] += 100_000 - pack.count()
        assert {(tuple(c_), x_): k for child, c_, x_, k in got if child == x} == want
    pack.unpersist()
