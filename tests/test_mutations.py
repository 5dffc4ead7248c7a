"""Operators on hand-made tables; the registered queries are compared with SQL in test_queries.py."""

import itertools
import math

import coxref
import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.functions import climb, lasso
from antecede.jobs import inference
from antecede.operators import coxpath, learn, order, probabilities, ranking, resample, shaping, survival
from antecede.operators.rounds import rounds_of
from antecede.sources import tables
from antecede.sources.tables import read_arcs, stored, wide_to_long, write_edges


def ccf(spark, text):
    """`s1: A .9, B .5; s2: ...`"""
    rows = [(s.split(":")[0].strip(), g.split()[0], float(g.split()[1])) for s in text.split(";") for g in s.split(":")[1].split(",") if g.strip()]
    return spark.createDataFrame(rows, "sample_id string, gene_id string, ccf double")


def frame(spark, names, kind):
    return spark.createDataFrame([(x,) for x in names], f"{kind} string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(
    ("text", "mode", "arcs"),
    [
        ("s1: A .9, B .5, C .2", "tiers", [("A", "B", 1), ("B", "C", 1)]),
        ("s1: A .9, B .9, C .2", "tiers", [("A", "C", 1), ("B", "C", 1)]),
        ("s1: A .9, B .9, C .2", "compat", [("A", "B", 2)]),
        ("s1: A .9", "tiers", []),
        ("s1: A .9", "compat", []),
        ("s1: A .9, B 0, C nan", "tiers", []),
    ],
)
def test_arcs(spark, text, mode, arcs):
    assert rows(order.arcs(ccf(spark, text), mode), "parent", "child", "weight") == arcs


def test_probabilities(spark):
    genes, samples = frame(spark, "AB", "gene_id"), frame(spark, ["s1", "s2", "s3", "s4"], "sample_id")
    n = probabilities.sample_counts(samples)
    model = lambda text: rows(probabilities.p_model_ccf(probabilities.packed(ccf(spark, text)), genes, n), "gene_i", "gene_j", "p_model")
    assert model("s1: A .5, B .5; s2: A .9, B .5") == [("A", "B", 0.5), ("B", "A", 0.0)]
    assert model("s1: A .5; s2: B .9") == [("A", "B", 0.0), ("B", "A", 0.0)]
    pack = probabilities.packed(ccf(spark, "s1: A .5"))
    assert rows(probabilities.marginals(pack, n), "gene_id", "p") == [("A", 0.25)]
    assert rows(probabilities.p_null(pack, genes, n), "gene_i", "gene_j", "p_null") == [("A", "B", 0.25), ("B", "A", 0.0)]


def test_shaping(spark, tmp_path):
    wide = spark.createDataFrame([("s1", 0.5, 0.0), ("s2", None, float("nan"))], "s string, A double, B double")
    assert rows(wide_to_long(wide, "s"), "sample_id", "gene_id", "ccf") == [("s1", "A", 0.5)]
    (tmp_path / "arcs.txt").write_text("A B\nA  B 4\n\nA A\n1 2 3\n")
    assert rows(order.weighed(read_arcs(spark, str(tmp_path / "arcs.txt"))), "parent", "child", "weight") == [("1", "2", 3), ("A", "B", 5)]
    vaf = spark.createDataFrame([("s", "A", 1, 0.1), ("s", "A", 2, 0.7), ("s", "B", 1, float("nan"))], "sample_id string, gene_id string, row_id long, vaf_estimate double")
    vaf = vaf.withColumns({"normal_ploidy": F.lit(2), "copy_number": F.lit(2)})
    assert rows(shaping.with_ccf(shaping.latest_rows(vaf)), "gene_id", "ccf")[0] == ("A", 1.0)
    assert rows(shaping.observed(shaping.with_ccf(vaf)), "gene_id", "row_id") == [("A", 1), ("A", 2)]
    edges = spark.createDataFrame([("aic", "A", "B")], "regularization string, parent string, child string")
    write_edges(edges, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "regularization", "parent", "child") == [("aic", "A", "B")]
    assert rows(shaping.adjacency(edges, ["A", "B"]), "parent", "A", "B") == [("A", 0, 1), ("B", 0, 0)]


def test_ranks(spark):
    arcs = spark.createDataFrame([("A", "B", 3), ("B", "A", 1), ("A", "A", 9)], "parent string, child string, weight long")
    assert rows(inference.rank_arcs(arcs), "gene_id", "rank", "agony") == [("A", 0, 2), ("B", 1, 2)]
    chain = spark.createDataFrame([("A", "B", 1), ("B", "C", 1), ("A", "C", 1)], "parent string, child string, weight long")
    assert rows(ranking.dag_ranks(chain), "gene_id", "rank") == [("A", 0), ("B", 1), ("C", 2)]
    with pytest.raises(ValueError, match="cycle"):
        ranking.dag_ranks(arcs)


def test_mean_rank_halves_to_even(spark):
    genes, iters = frame(spark, "ABC", "gene_id"), spark.range(1).select(F.lit(0).alias("iter"))
    r = spark.createDataFrame([(0, 0, "A", 0), (0, 1, "A", 1), (0, 0, "B", 1), (0, 1, "B", 2)], "iter int, rep int, gene_id string, rank int")
    assert rows(ranking.mean_ranks(r, genes, iters), "gene_id", "rank") == [("A", 0), ("B", 2), ("C", 0)]
    assert rows(ranking.mean_ranks(r.limit(0), genes, iters), "gene_id", "rank") == [("A", 0), ("B", 0), ("C", 0)]


def test_no_arcs(spark):
    genes, iters = frame(spark, "AB", "gene_id"), spark.range(1).select(F.lit(0).alias("iter"))
    none = spark.createDataFrame([], "iter int, rep int, parent string, child string, weight long")
    assert rows(ranking.single_poset(none, genes, iters), "parent", "child") == [("A", "B"), ("B", "A")]
    samples = frame(spark, ["s1", "s2"], "sample_id")
    out = inference.ccf_inference(ccf(spark, "s1: A .5; s2: B .5"), samples, genes, restarts=0)
    assert rows(out.poset, "parent") == rows(out.inference, "parent") == []


def test_subsample_and_bootstrap_do_not_depend_on_partitions(spark):
    samples = frame(spark, [f"s{k}" for k in range(501)], "sample_id")
    a = rows(resample.memberships(resample.subsamples(samples, 3, seed=5)), "iter", "sample_id")
    b = rows(resample.memberships(resample.subsamples(samples.repartition(7), 3, seed=5)), "iter", "sample_id")
    assert a == b and len(a) == 3 * round(0.8 * 501) == len(set(a))
    a = rows(resample.bootstrap(samples, 2), "rep", "sample_id", "multiplicity")
    assert a == rows(resample.bootstrap(samples.repartition(5), 2), "rep", "sample_id", "multiplicity")
    assert sum(x[2] for x in a) == 2 * 501


def planted(spark, n=400, seed=2):
    """A before B before C in time; D is unrelated."""
    rng, out, vaf = np.random.default_rng(seed), [], []
    for k in range(n):
        depth = int(rng.choice(4, p=[0.2, 0.3, 0.3, 0.2]))  # A, then A and B, then all three
        has = list("ABC"[:depth]) + ["D"] * int(rng.random() < 0.3)
        for g in has:
            alt = int({"A": 45, "B": 28, "C": 10, "D": 25}[g] + rng.integers(-4, 5))
            out.append((f"s{k}", g, alt / 50))
            vaf.append((f"s{k}", g, 50 - alt, alt, 1, 2, alt / 50, alt / 50, 1))
    names = "sample_id string, gene_id string, ref_count int, alt_count int, copy_number int, normal_ploidy int, vaf_estimate double, ccf_estimate double, row_id long"
    return spark.createDataFrame(out, "sample_id string, gene_id string, ccf double"), spark.createDataFrame(vaf, names), frame(spark, [f"s{k}" for k in range(n)], "sample_id"), frame(spark, "ABCD", "gene_id")


def test_replicates_do_not_depend_on_partitions(spark):
    _, vaf, _, _ = planted(spark, 60)
    key = ["rep", "parent", "child", "weight"]
    assert rows(resample.replicate_arcs(vaf, 3, 1), *key) == rows(resample.replicate_arcs(vaf.repartition(9), 3, 1), *key)


def test_planted_order_and_search(spark):
    c, vaf, samples, genes = planted(spark)
    out = inference.ccf_resampling(c, vaf, samples, genes, nsampling=4, restarts=2)
    rank = dict(rows(out.ranking, "gene_id", "rank"))
    assert rank["A"] < rank["B"] < rank["C"]
    poset = rows(out.poset, "parent", "child")
    assert ("A", "B") in poset and ("C", "A") not in poset
    inferred = rows(out.inference.where("regularization = 'bic'"), "parent", "child")
    assert ("A", "B") in inferred and set(inferred) <= set(poset)
    # every subset of the candidates of each child bounds hill climbing and tabu search
    pack, n = probabilities.packed(c), probabilities.sample_counts(samples)
    data = [(set(r.genes), r.n) for r in learn.profiles(pack, n).collect()]
    total = sum(k for _, k in data)

    def score(child, parents):
        counts = {}
        for g, k in data:
            x = counts.setdefault(tuple(p in g for p in parents), [0, 0])
            x[child in g] += k
        ll = sum(v * math.log(v / sum(x)) for x in counts.values() for v in x if v)
        return ll - math.log(total) / 2 * 2 ** len(parents)

    tabu_ = rows(learn.tabu_search(learn.profiles(pack, n), out.poset, n, ("bic",)), "parent", "child")
    for child in "ABCD":
        cands = [p for p, x in poset if x == child]
        best = max(score(child, s) for k in range(len(cands) + 1) for s in itertools.combinations(cands, k))
        for found in (inferred, tabu_):
            assert score(child, [p for p, x in found if x == child]) == pytest.approx(best)


def test_confidence(spark):
    c, vaf, samples, genes = planted(spark, 150)
    out = inference.ccf_confidence(c, samples, genes, vaf, niterations=2, nsampling=2, restarts=0)
    freq = {(p, x): f for p, x, f in rows(out.poset, "parent", "child", "frequency")}
    assert freq["A", "B"] == 1.0 and all(f in (0.5, 1.0) for f in freq.values())
    plain = inference.ccf_confidence(c, samples, genes, None, niterations=2, restarts=0)
    assert plain.ranking is None and dict(((p, x), f) for p, x, f in rows(plain.poset, "parent", "child", "frequency"))["A", "B"] == 1.0


def test_trees(spark):
    nodes = spark.createDataFrame([("t1", "A"), ("t1", "B"), ("t1", "C"), ("t2", "A"), ("t2", "B"), ("t3", "B")], "sample_id string, gene_id string")
    edges = spark.createDataFrame([("t1", "A", "B"), ("t1", "B", "C"), ("t2", "A", "B"), ("t2", "A", "Z")], "sample_id string, parent string, child string")
    samples, genes = frame(spark, ["t1", "t2", "t3"], "sample_id"), frame(spark, "ABC", "gene_id")
    n = probabilities.sample_counts(samples)
    p = {(a, b): x for a, b, x in rows(probabilities.p_model_trees(nodes, edges, genes, n), "gene_i", "gene_j", "p_model")}
    assert p["A", "B"] == 1.0 and p["B", "C"] == 1.0 and p["A", "C"] == 0.0 and len(p) == 6
    assert rows(order.tree_arcs(edges, genes), "parent", "child", "weight") == [("A", "B", 2), ("B", "C", 1)]
    out = inference.tree_bootstrap(nodes, nodes, edges, samples, genes, nsampling=3, restarts=0)
    assert ("A", "B") in rows(out.poset, "parent", "child")
    plain = inference.tree_inference(nodes, nodes, edges, samples, genes, restarts=0)
    assert ("B", "C") in rows(plain.poset, "parent", "child")


def test_forbidden_two_way(spark):
    c, _, samples, _ = planted(spark, 20)
    two = spark.createDataFrame([(0, "A", "B"), (0, "B", "A")], "iter int, parent string, child string")
    with pytest.raises(ValueError, match="both directions"):
        learn.hill_climb(learn.profiles(probabilities.packed(c), probabilities.sample_counts(samples)), two, probabilities.sample_counts(samples))


def test_tabu_helper_finds_an_interaction():
    masks = np.arange(8).repeat(2)
    child = np.tile([0, 1], 8)
    counts = np.where((masks & 1) ^ ((masks >> 1) & 1) == child, 90, 10)  # exclusive or: no single parent gains
    bits = (masks[:, None] >> np.arange(3)) & 1
    assert climb.tabu(climb.Table(bits.astype(np.uint8), child, counts[:, None]), 2.0) & 3 == 3


def test_both_ways_of_the_climb_give_the_same_parents(spark):
    rng = np.random.default_rng(3)
    names = [f"g{k}" for k in range(8)]
    has = rng.random((500, 8)) < 0.35
    for k in range(3, 8):
        has[:, k] |= has[:, rng.integers(k)] & (rng.random(500) < 0.6)
    c = spark.createDataFrame([(f"s{i}", names[k], 0.5) for i in range(500) for k in range(8) if has[i, k]], "sample_id string, gene_id string, ccf double")
    samples = frame(spark, [f"s{i}" for i in range(500)], "sample_id")
    n = probabilities.sample_counts(samples)
    profiles = learn.profiles(probabilities.packed(c), n)
    edges = spark.createDataFrame([(0, names[i], names[j]) for j in range(8) for i in range(j)], "iter int, parent string, child string")
    key = ["regularization", "parent", "child"]
    for most in (1, 200):
        ways = [rows(learn.hill_climb(profiles, edges, n, restarts=2, most=most, max_cells=cells), *key) for cells in (10**9, 60, 0)]
        assert ways[0] == ways[1] == ways[2] and ways[0]


def test_salted_joins_give_the_same_counts(spark, monkeypatch):
    c, _, samples, _ = planted(spark, 80)
    n = probabilities.sample_counts(samples)
    profiles = learn.profiles(probabilities.packed(c), n)
    families = spark.createDataFrame([(0, "C", ["A", "B"]), (0, "C", []), (0, "B", ["A"])], "iter int, child string, parents array<string>")
    get = lambda: sorted(str(r) for r in learn.family_counts(profiles, families).collect())
    plain = get()
    monkeypatch.setattr(tables, "MAX_LABELS", 0)
    assert get() == plain and len(plain) == 6


def test_rounds_of_a_sample_meet_its_arcs_last(spark):
    c, _, samples, _ = planted(spark, 60)
    member = samples.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("iter"))).where("pmod(xxhash64(sample_id, iter), 4) > 0")
    for mode in ("tiers", "compat"):
        got = rows(order.arcs(c, mode, rounds_of(member, 3)), "iter", "parent", "child", "weight")
        want = [(k, *r) for k in range(3) for r in rows(order.arcs(c.join(member.where(F.col("iter") == k), "sample_id"), mode), "parent", "child", "weight")]
        assert got == sorted(want) and got


def test_hinges(spark):
    cut = lambda *x: sorted(r[0] for r in survival.hinges(spark.createDataFrame([(float(v),) for v in x], "beta double")).collect())
    assert cut(1, 2, 3, 4) == [1.5, 2.5, 3.5]
    assert cut(1, 1, 1) == [1.0]
    assert cut(5, 1, 3, 2, 4) == [2.0, 3.0, 4.0]


def test_lasso_is_optimal():
    rng = np.random.default_rng(4)
    x = rng.random((300, 6)) < 0.4
    x[:, 5] = True  # constant: never enters
    time = np.ceil(rng.exponential(20 * np.exp(-1.2 * x[:, 0]))) + 1
    status, weight = (rng.random(300) < 0.7).astype(float), rng.integers(1, 4, 300).astype(float)
    cox = lasso.Cox([np.flatnonzero(r) for r in x], 6, time, status, weight)
    dense = coxref.Cox(x.astype(float), time, status, weight)
    grid = lasso.lambdas(cox, 100)
    assert grid[0] == pytest.approx(np.abs(dense.value(np.zeros(6))[1]).max())
    none = np.zeros(0, int)
    for lam, b in zip(grid, lasso.path(cox, grid), strict=True):
        gradient = cox.slopes(b, none)[0]
        assert lasso.distance(b, gradient, cox.scale, lam).max() <= lasso.KKT * lam and b[5] == 0
    for k in (30, 99):
        b = lasso.path(cox, grid)[k]
        want = coxref.fit(dense, grid[k], np.zeros(6), tolerance=1e-10)
        assert np.allclose(b[:5], (want / dense.scale)[:5], atol=1e-6) and ((b != 0) == (want != 0)).all()
    block = np.array([0, 2, 4])
    gradient, h = cox.slopes(b, block)
    for k, j in enumerate(block):
        step = 1e-6 * np.eye(6)[j]
        assert np.isclose((cox.value(b + step) - cox.value(b - step)) / 2e-6, gradient[j], atol=1e-7)
        assert np.allclose((cox.slopes(b + step, none)[0] - cox.slopes(b - step, none)[0])[block] / 2e-6, -h[k], atol=1e-6)


def survived(spark, n=200, p=6):
    """survival and steps of n patients; steps 0 and 3 matter, step 5 is everyone's."""
    rng = np.random.default_rng(3)
    x = rng.random((n, p)) < np.linspace(0.1, 0.5, p)
    x[:, -1] = True
    time = np.ceil(rng.exponential(10 / np.exp(1.2 * x[:, 0] - x[:, 3])))
    end = np.ceil(rng.exponential(20, n))
    surv = spark.createDataFrame([(f"s{i}", int(time[i] <= end[i]), float(min(time[i], end[i]))) for i in range(n)], "sample_id string, status int, time double")
    return surv, spark.createDataFrame([(f"s{i}", f"g{j}") for i in range(n) for j in np.flatnonzero(x[i])], "sample_id string, step string")


def test_lasso_rounds_reach_the_optimum(spark):
    surv, steps = survived(spark)
    one = survival.select_steps(surv, steps, 2, 1, 3).toPandas()
    many = survival.select_steps(surv, steps, 2, 1, 3, max_cells=0).toPandas()
    assert list(one.step) == list(many.step) and "g5" not in set(one.step) and {"g0", "g3"} <= set(one.step)
    assert np.allclose(one.coef, many.coef, atol=1e-5)
    rows = survival.compacted(surv, steps, survival.step_names(steps), 2, 1).persist()
    whole, _ = coxpath.fit(rows, 6, 2, 2, block=2)  # steps that do not fit a round take turns
    part = rows.toPandas()
    cox = lasso.Cox(list(part.steps), 6, part.time.to_numpy(float), part.status.to_numpy(float), part.weight.to_numpy(float))
    assert np.allclose(whole, lasso.path(cox, lasso.lambdas(cox, 2)), atol=1e-5)


def test_both_ways_select_the_same_steps_over_the_whole_path(spark):
    surv, steps = survived(spark, 300, 8)
    rows = stored(survival.compacted(surv, steps, survival.step_names(steps), 2, 1))
    part = rows.toPandas()
    cox = lasso.Cox(list(part.steps), 8, part.time.to_numpy(float), part.status.to_numpy(float), part.weight.to_numpy(float))
    one = lasso.path(cox, lasso.lambdas(cox, 100))
    work = coxpath.Path(rows, 8, 2)
    many = np.array([b for b, _ in coxpath.fitted(work, 100)])
    assert ((one != 0) == (many != 0)).all() and np.allclose(one, many, atol=1e-5)
    assert work.passes <= 3 * 100


def test_lasso_rounds_with_many_times(spark, monkeypatch):
    monkeypatch.setattr(tables, "MAX_LABELS", 0)
    surv, steps = survived(spark)
    rows = stored(survival.compacted(surv, steps, survival.step_names(steps), 3, 1))
    b, block, found = np.linspace(-1, 1, 24).reshape(6, 4), np.array([0, 2, 5]), []
    model = np.arange(4)
    monkeypatch.setattr(coxpath, "MAX_TIED", 0)
    for most in (1000, 0):
        path = coxpath.Path(rows, 6, 3, most)
        hazards = path.hazards(b, model)
        slopes = path.slopes(b, model, hazards, block)
        found.append([hazards["value"], hazards["full"], slopes["gradient"], slopes["curved"], slopes["curvature"]])
    for few, many in zip(*found, strict=True):
        assert np.allclose(few, many)
    monkeypatch.setattr(coxpath, "MAX_TIED", 1 << 22)
    path = coxpath.Path(rows, 6, 3)
    exact = path.slopes(b, model, path.hazards(b, model), block)["curvature"]
    pd = rows.toPandas()
    for m in range(4):  # against the one-task likelihood
        part = pd[pd.fold != m - 1]
        cox = lasso.Cox(list(part.steps), 6, part.time.to_numpy(float), part.status.to_numpy(float), part.weight.to_numpy(float))
        gradient, h = cox.slopes(b[:, m], block)
        assert np.isclose(cox.value(b[:, m]) * cox.n, found[0][0][m]) and np.allclose(gradient * cox.n, found[0][2][:, m])
        assert np.allclose(h * cox.n, exact[m])


def test_signatures(spark):
    rng = np.random.default_rng(7)
    has = rng.random((400, 4)) < 0.4
    time = np.ceil(rng.exponential(20 * np.exp(-1.5 * has[:, 0]))) + 1
    surv = spark.createDataFrame([(f"p{k}", int(rng.random() < 0.8), float(t)) for k, t in enumerate(time)], "sample_id string, status int, time double")
    steps = spark.createDataFrame([(f"p{k}", f"step{j}") for k in range(400) for j in range(4) if has[k, j]], "sample_id string, step string")
    out = inference.signatures(surv, steps, folds=4)
    chosen = dict(rows(out.steps, "step", "coef"))
    assert chosen["step0"] > 0.5 and chosen["step0"] == max(chosen.values())
    assert out.prevalence.where("selected").count() and out.patients.count() == 400
    assert {c for (c,) in rows(out.patients.select("cluster").distinct(), "cluster")} >= {"C1", "C2"}
    noise = inference.signatures(surv.withColumn("time", F.lit(1.0)), steps, folds=4)
    assert noise.prevalence.count() == noise.patients.count() == noise.steps.count() == 0
    with pytest.raises(ValueError, match="missing"):
        inference.signatures(surv.withColumn("time", F.lit(None).cast("double")), steps)
