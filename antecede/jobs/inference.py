"""End-to-end jobs (P1-P8). Replicates and cross-validation rounds are key columns of one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.operators import learn, order, probabilities, ranking, resample, shaping, strong, survival
from antecede.operators.rounds import Rounds, size_of
from antecede.sources.tables import spread, stored


@dataclass
class Result:
    """poset (iter, parent, child), inference (iter, regularization, parent, child) and, where made, ranking (iter, gene_id, rank)."""

    poset: DataFrame
    inference: DataFrame
    ranking: DataFrame | None = None


def _infer(pack: DataFrame, names: list[str], n: DataFrame, poset: DataFrame, regularization: tuple[str, ...], command: str, restarts: int, count: int) -> DataFrame:
    profiles = learn.bit_profiles(pack, names, n, count)
    if command == "hc":
        return learn.hill_climb(profiles, poset, n, regularization, restarts)
    if command == "tabu":
        return learn.tabu_search(profiles, poset, n, regularization)
    raise ValueError(command)


def _names(genes: DataFrame) -> list[str]:
    return sorted({r[0] for r in genes.select("gene_id").collect()})  # a row for each gene


def _observed(dataset: DataFrame, genes: DataFrame, rounds: Rounds | None) -> DataFrame:
    """The packed table of a binary dataset (sample_id, gene_id)."""
    seen = shaping.keep_genes(dataset, genes, "gene_id").select("sample_id", "gene_id", F.lit(1.0).alias("ccf"))
    return stored(probabilities.packed(seen, rounds, once=True))


@dataclass
class _Tables:
    """What a CCF job reads several times: mutations with a ccf, the packed ccfs, the packed dataset, sample counts and pairs."""

    ccf: DataFrame
    pack: DataFrame
    seen: DataFrame
    n: DataFrame
    names: list[str]
    genes: DataFrame
    rounds: Rounds | None

    @classmethod
    def of(cls, ccf: DataFrame, samples: DataFrame, genes: DataFrame, dataset: DataFrame | None, rounds: Rounds | None) -> _Tables:
        ccf = shaping.keep_genes(ccf, genes, "gene_id")
        pack = stored(probabilities.packed(ccf, rounds))
        seen = pack if dataset is None else _observed(dataset, genes, rounds)
        return cls(ccf, pack, seen, stored(probabilities.sample_counts(samples, rounds)), _names(genes), genes, rounds)

    def raised(self, poset: DataFrame) -> DataFrame:
        """Precedence from the ccfs, the null model from the dataset."""
        count = size_of(self.rounds)
        pairs = stored(probabilities.pair_counts(self.pack, count))  # genes ** 2 rows for each round
        theirs = pairs if self.seen is self.pack else stored(probabilities.pair_counts(self.seen, count))
        p_model = probabilities.p_model_ccf(self.pack, self.genes, self.n, pairs, count)
        return stored(ranking.probability_raising(poset, p_model, probabilities.p_null(self.seen, self.genes, self.n, theirs, count)))

    def infer(self, poset: DataFrame, regularization: tuple[str, ...], command: str, restarts: int) -> DataFrame:
        return _infer(self.seen, self.names, self.n, poset, regularization, command, restarts, size_of(self.rounds))


def ccf_inference(ccf: DataFrame, samples: DataFrame, genes: DataFrame, regularization=("aic", "bic"), command: str = "hc", restarts: int = 10, arc_mode: str = "tiers", dataset: DataFrame | None = None, rounds: Rounds | None = None) -> Result:
    """P1. dataset: (sample_id, gene_id) mutations observed, from which the null model and the parents come; by default those
    with a ccf."""
    t = _Tables.of(ccf, samples, genes, dataset, rounds)
    poset = ranking.single_poset(order.arcs(t.ccf, arc_mode, rounds), genes, t.n.select("iter"))
    poset = t.raised(poset)
    return Result(poset, t.infer(poset, regularization, command, restarts))


def ccf_resampling(ccf: DataFrame, vaf: DataFrame, samples: DataFrame, genes: DataFrame, nsampling: int = 100, regularization=("aic", "bic"), command: str = "hc", restarts: int = 10, seed: int = 1, arc_mode: str = "tiers", dataset: DataFrame | None = None, rounds: Rounds | None = None) -> Result:
    """P2. dataset: as in ccf_inference()."""
    t = _Tables.of(ccf, samples, genes, dataset, rounds)
    vaf = shaping.keep_genes(shaping.latest_rows(vaf), genes, "gene_id")
    blocks = stored(resample.replicate_blocks(vaf, t.names, nsampling, seed, rounds, arc_mode))
    ranks = stored(ranking.mean_ranks(ranking.minimum_agony_blocks(blocks, t.names), genes, t.n.select("iter")))
    poset = t.raised(ranking.poset(ranks))
    return Result(poset, t.infer(poset, regularization, command, restarts), ranks)


def tree_inference(dataset: DataFrame, nodes: DataFrame, edges: DataFrame | None, samples: DataFrame, genes: DataFrame, regularization=("aic", "bic"), command: str = "hc", restarts: int = 10, rounds: Rounds | None = None) -> Result:
    """P3. dataset: (sample_id, gene_id) mutations observed. nodes, edges: long tables; or nodes: nested trees (sample_id, nodes, edges)
    and edges: None."""
    return _trees(dataset, nodes, edges, samples, genes, 0, regularization, command, restarts, 1, rounds)


def tree_bootstrap(dataset: DataFrame, nodes: DataFrame, edges: DataFrame | None, samples: DataFrame, genes: DataFrame, nsampling: int = 100, regularization=("aic", "bic"), command: str = "hc", restarts: int = 10, seed: int = 1, rounds: Rounds | None = None) -> Result:
    """P4. As many trees as there are (samples with a node) are drawn with replacement in each replicate. Trees as in tree_inference()."""
    return _trees(dataset, nodes, edges, samples, genes, nsampling, regularization, command, restarts, seed, rounds)


def _trees(dataset, nodes, edges, samples, genes, nsampling, regularization, command, restarts, seed, rounds) -> Result:
    seen, n, names, count = _observed(dataset, genes, rounds), stored(probabilities.sample_counts(samples, rounds)), _names(genes), size_of(rounds)
    nested = nodes if edges is None else shaping.nested_trees(nodes, edges)
    alike = stored(spread(shaping.known_genes(resample.trees_alike(nested, samples, rounds), names, count), "nodes", "edges"))
    p_model = probabilities.p_model_shapes(alike, genes, n, count)
    p_null = probabilities.p_null(seen, genes, n, stored(probabilities.pair_counts(seen, count)), count)
    ranks = None
    if nsampling:
        drawn = alike.where("drawn").select("nodes", F.col("edges").alias("arcs"), "counts")  # a tree whose genes are all unknown is drawn too
        blocks = stored(resample.tree_blocks(drawn, ["nodes", "arcs"], names, nsampling, seed, count))
        ranks = stored(ranking.mean_ranks(ranking.minimum_agony_blocks(blocks, names), genes, n.select("iter")))
        poset = ranking.poset(ranks)
    else:
        poset = ranking.single_poset(probabilities.shape_arcs(alike, count), genes, n.select("iter"))
    poset = stored(ranking.probability_raising(poset, p_model, p_null))
    return Result(poset, _infer(seen, names, n, poset, regularization, command, restarts, count), ranks)


@dataclass
class Confidence:
    """poset and inference frequencies over the iterations; ranking: mean ranks, where replicates were drawn."""

    poset: DataFrame
    inference: DataFrame
    ranking: DataFrame | None = None


def _confidence(result: Result, niterations: int) -> Confidence:
    mean = resample.mean_over_iterations(result.ranking, niterations) if result.ranking is not None else None
    return Confidence(resample.frequencies(result.poset, niterations), resample.frequencies(result.inference, niterations), mean)


def _rounds(samples: DataFrame, niterations: int, seed: int) -> Rounds:
    held = resample.subsamples(samples, niterations, 0.8, seed)
    return Rounds(stored(held.members), held.count)


def ccf_confidence(ccf: DataFrame, samples: DataFrame, genes: DataFrame, vaf: DataFrame | None = None, niterations: int = 100, nsampling: int = 100, regularization=("aic", "bic"), restarts: int = 10, seed: int = 1, dataset: DataFrame | None = None) -> Confidence:
    """P5: 80 % of the samples in each iteration; without a VAF table (F6) no replicates are drawn. dataset: as in ccf_inference()."""
    niterations = max(1, niterations)
    rounds = _rounds(samples, niterations, seed)
    if vaf is None or not nsampling:
        return _confidence(ccf_inference(ccf, samples, genes, regularization, "hc", restarts, dataset=dataset, rounds=rounds), niterations)
    return _confidence(ccf_resampling(ccf, vaf, samples, genes, nsampling, regularization, "hc", restarts, seed, dataset=dataset, rounds=rounds), niterations)


def tree_confidence(dataset: DataFrame, nodes: DataFrame, edges: DataFrame | None, samples: DataFrame, genes: DataFrame, niterations: int = 100, nsampling: int = 100, regularization=("aic", "bic"), restarts: int = 10, seed: int = 1) -> Confidence:
    """P6. Trees as in tree_inference()."""
    niterations = max(1, niterations)
    return _confidence(_trees(dataset, nodes, edges, samples, genes, nsampling, regularization, "hc", restarts, seed, _rounds(samples, niterations, seed)), niterations)


def rank_arcs(arcs: DataFrame, by_parts: bool = False) -> DataFrame:
    """Ranking of any arc table (parent, child[, weight]). by_parts: the same ranks, each strong part in a task of its own."""
    if "weight" not in arcs.columns:
        arcs = arcs.withColumn("weight", F.lit(1).cast("long"))
    return (strong if by_parts else ranking).minimum_agony(order.weighed(arcs))


@dataclass
class Signatures:
    """steps (step, coef, direction), patients (with beta and cluster), prevalence (cluster, step, prevalence, selected)."""

    steps: DataFrame
    patients: DataFrame
    prevalence: DataFrame


def signatures(survival_: DataFrame, steps: DataFrame, folds: int = 10, seed: int = 1) -> Signatures:
    """P7. With fewer than two clusters all three tables are empty (H11). Bad input (null time or status) stops the job."""
    if not survival_.where("status IS NULL OR time IS NULL").isEmpty():
        raise ValueError("survival holds missing values")
    chosen = stored(survival.select_steps(survival_, steps, folds, seed))
    clustered = stored(survival.clusters(survival.risk_scores(survival_, steps, chosen.select("step", "coef"))))
    if not clustered.agg(survival.gate(clustered)).first()[0]:
        chosen, clustered, steps = chosen.limit(0), clustered.limit(0), steps.limit(0)
    shares = survival.prevalence(clustered, steps)
    shares = shares.join(F.broadcast(chosen.select("step", F.lit(True).alias("selected"))), "step", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    return Signatures(chosen, clustered, shares.select("cluster", "step", "prevalence", "selected"))
