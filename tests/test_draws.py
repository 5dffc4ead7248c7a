"""Draws by bins and by tree shape: same distribution, same totals, whatever the partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.functions import draws
from antecede.functions.tally import Tally, Weights, between_tiers, ordered_arcs
from antecede.jobs import inference
from antecede.operators import learn, resample


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(("a", "b", "c"), [(20, 30, 2), (1, 49, 1), (30, 20, 1), (1, 1, 1), (400, 3, 1)])
def test_bins_have_the_distribution_of_clamped_draws(a, b, c):
    n, rng = 400_000, draws.Streams(5).of(7)
    columns, coins = draws.short(rng, 2, n)
    columns &= draws.BINS - 1
    places = draws.binned(a, b, c).place(rng, columns, coins)
    one = np.ones(n)
    value, left = draws.within(a * one, b * one, c * one, places, rng.random((2, 6, n)))
    want = np.minimum(1, c * np.random.default_rng(1).beta(a, b, n))
    value = value[~np.isnan(value)]
    assert left < n / 1000 and (value == 1).sum() == (places == draws.BINS - 1).sum()
    at = np.linspace(0, 1, 400)
    apart = np.abs(np.searchsorted(np.sort(value), at) / len(value) - np.searchsorted(np.sort(want), at) / n).max()
    assert apart < 2.2 * (2 / n) ** 0.5  # Kolmogorov-Smirnov


def test_a_sample_drawn_by_bins_and_one_by_one():
    """Two rounds of 3,000 replicates of four mutations: shares of each arc both ways."""
    known, reps, its = [(0, 45.0, 5.0, 2.0), (1, 20.0, 30.0, 2.0), (2, 22.0, 28.0, 2.0), (4, 9.0, 41.0, 1.0)], 3000, np.array([0, 2])
    sums, tally = Weights(3, reps, 5), Tally(3, reps, 5)
    bins = resample._Bins(3, reps, sums, tally)
    bins.add(11, known, its)
    bins.settle()
    got = np.zeros((3, 5, 5))
    for part in [*sums.rows(), *tally.rows()]:
        np.add.at(got, (part["iter"], part["parent"], part["child"]), part["weights"].sum(1))
    place, a, b, c = np.array(known).T
    value = np.clip(c * draws.beta(draws.stream(1), a, b, 200_000), 0, 1)
    want = np.zeros((5, 5))
    for row, parent, child, _ in ordered_arcs(np.tile(place.astype(int), (200_000, 1)), value, "tiers"):
        np.add.at(want, (parent, child), 1)
    assert not got[1].any()
    assert np.abs(got[its].sum(0) / 6000 - want / 200_000).max() < 0.03


def test_arcs_between_tiers_are_the_ordered_ones():
    rng = np.random.default_rng(3)
    for k in (2, 3, 5):
        value = rng.integers(1, 5, (k, 300)) / 4
        arcs, _ = between_tiers(value)
        want = np.zeros(arcs.shape, bool)
        for row, parent, child, _ in ordered_arcs(np.tile(np.arange(k), (300, 1)), value.T, "tiers"):
            want[parent, child, row] = True
        assert (arcs == want).all()


@pytest.mark.parametrize("most", [1, 9, 40])
def test_weighted_multinomial(most):
    """Totals are exact; means and variances those of the multinomial, for light and heavy rows."""
    weight = np.random.default_rng(2).integers(1, most + 1, 500)
    n, reps = weight.sum(), 2000
    many = draws.multinomial(draws.stream(4), np.full(reps, n), weight).astype(np.int64)
    assert (many.sum(0) == n).all()
    share = weight / n
    sigma = np.sqrt(n * share * (1 - share))
    assert np.abs((many.mean(1) - weight) / sigma).max() < 5 / reps**0.5
    assert abs((many.var(1) / sigma**2).mean() - 1) < 0.02
    assert abs(np.corrcoef(many)[~np.eye(500, dtype=bool)].mean() + 1 / 499) < 0.001


def test_common_kinds_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(resample, "DENSE_CELLS", 1)
    vaf = spark.range(900).select((F.col("id") % 300).cast("string").alias("sample_id"), F.concat(F.lit("g"), (F.col("id") / 300).cast("int")).alias("gene_id"), (F.col("id") % 7 * 3).cast("int").alias("alt_count"), F.lit(20).alias("ref_count"), F.lit(1).alias("copy_number"), F.lit(2).alias("normal_ploidy"))
    kinds = resample.common_kinds(vaf, ["alt_count", "ref_count", "copy_number", "normal_ploidy"])
    assert kinds.count() == 900 and kinds.where("common").count() == 900
    key = ["rep", "parent", "child", "weight"]
    got = rows(resample.replicate_arcs(vaf, 5, 1), *key)
    assert got and got == rows(resample.replicate_arcs(vaf.repartition(9), 5, 1), *key)


def test_equal_trees_are_one_row(spark):
    """Long and nested trees give the same job, and equal trees are counted, not copied: a patient is never a row of each gene."""
    patients = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("sample_id"))
    genes = spark.createDataFrame([(g,) for g in "ABC"], "gene_id string")
    nested = patients.select("sample_id", F.expr("array('A', 'B', 'C', 'Z')").alias("nodes"), F.expr("array(named_struct('parent', 'A', 'child', 'B'), named_struct('parent', 'B', 'child', 'C'), named_struct('parent', 'A', 'child', 'Z'))").alias("edges"))
    alike = resample.trees_alike(nested, patients)
    assert [(r.drawn, r.counts) for r in alike.collect()] == [(True, [3000])]
    nodes, edges = nested.select("sample_id", F.explode("nodes").alias("gene_id")), nested.select("sample_id", F.inline("edges"))
    seen = nodes.where("gene_id <> 'Z' AND pmod(xxhash64(sample_id, gene_id), 3) > 0")
    a = inference.tree_bootstrap(seen, nested, None, patients, genes, nsampling=3, restarts=0)
    b = inference.tree_bootstrap(seen, nodes, edges, patients, genes, nsampling=3, restarts=0)
    assert rows(a.poset, "parent", "child") == rows(b.poset, "parent", "child") == [("A", "B"), ("B", "C")]
    assert rows(a.ranking, "gene_id", "rank") == [("A", 0), ("B", 1), ("C", 2)]


def test_labels_are_literals(spark):
    """Names parsed from JSON were parsed again for each row and round."""
    rounds = resample.subsamples(spark.range(50).select(F.col("id").cast("string").alias("sample_id")), 5)
    words = spark.range(5).select(learn._words(F.array(F.lit("b")), ["a", "b"]).alias("w"))
    for df in (rounds.members, words):
        assert "from_json" not in df._jdf.queryExecution().executedPlan().toString().lower()
