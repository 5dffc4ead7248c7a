"""Parent selection by penalised likelihood.

The poset is acyclic and everything outside it is forbidden, so the score is a sum over children that do not touch each
other: greedy search on the network is greedy search for each child. Data enter once, as counts of distinct mutation
profiles: bits over the genes, each with a vector of counts by round of cross-validation. They are counted again for each child on
its own candidates: at most 2 ** (candidates + 1) rows for a child, whatever the samples. A child whose table has up to
MAX_CELLS cells is climbed in one task, with all rounds, restarts and regularizations; the others go through DataFrame
rounds, each of which scores all one-arc changes in one job. Both ways make the same moves.

What depends on genes and iterations alone is broadcast up to a number of labels; beyond, the join is salted.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.functions import climb
from antecede.operators.rounds import WORD, added, unrolled, vectors, words_for
from antecede.sources.tables import beside, spread, stored

PENALTIES = ("aic", "bic")
#: Rows x (candidates + rounds) of one child's table that are climbed in one task at most.
MAX_CELLS = 100_000_000


@dataclass(frozen=True)
class Profiles:
    """rows: words (the genes a sample shows, bit k % 64 of word k // 64 for names[k]), counts (samples in each round)."""

    rows: DataFrame
    names: list[str]
    count: int


def bit_profiles(pack: DataFrame, names: list[str], n: DataFrame, count: int = 1) -> Profiles:
    """G2 for all rounds: distinct profiles as bits, each with a vector of counts; samples without a mutation are the empty one."""
    seen = vectors(pack.select("rounds", _words(F.col("muts.gene_id"), names).alias("words")), ["words"], count)
    held = added(seen.select(F.lit(0).alias("one"), "counts"), ["one"], count).select(F.col("counts").alias("held"))
    every = n.agg(F.map_from_entries(F.collect_list(F.struct("iter", "n"))).alias("n"))  # a row for each round
    held = every.join(F.broadcast(held), F.lit(True), "left")
    rest = F.array(*[F.coalesce(F.try_element_at("n", F.lit(k)), F.lit(0)) - F.coalesce(F.col("held")[k], F.lit(0)) for k in range(count)])
    empty = held.select(F.array_repeat(F.lit(0).cast("long"), words_for(len(names))).alias("words"), rest.alias("counts"))
    return Profiles(seen.unionByName(empty.where(F.exists("counts", lambda c: c > 0))), names, count)


def _words(genes: Column, names: list[str]) -> Column:
    """An array of labels as bits over names; others are left out."""
    places = _places(names)
    at = F.filter(F.transform(genes, lambda g: F.try_element_at(places, g)), lambda k: k.isNotNull())
    none = F.lit(0).cast("long")

    def word(w: int) -> Column:
        bit = lambda k: F.when(F.floor(k / WORD) == w, F.call_function("shiftleft", F.lit(1).cast("long"), k % WORD)).otherwise(none)
        return F.aggregate(at, none, lambda acc, k: acc.bitwiseOR(bit(k)))

    return F.array(*[word(w) for w in range(words_for(len(names)))])


def labels(words: Column, names: list[str]) -> Column:
    """The labels of the bits, in order."""
    every = F.lit(names)
    at = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.getbit(F.get(words, F.floor(k / WORD).cast("int")), k % WORD) == 1)
    return F.transform(at, lambda k: F.get(every, k)) if names else F.array().cast("array<string>")


def profiles(pack: DataFrame, n: DataFrame, count: int = 1) -> DataFrame:
    """Iter, genes (sorted), n; samples without a mutation are the empty profile."""
    names = sorted(r[0] for r in pack.select(F.explode("muts.gene_id").alias("g")).distinct().collect())  # a row for each gene
    return long_profiles(bit_profiles(pack, names, n, count))


def long_profiles(held: Profiles) -> DataFrame:
    return unrolled(held.rows.select(labels(F.col("words"), held.names).alias("genes"), "counts"), "n").select("iter", "genes", "n")


def from_long(rows: DataFrame, edges: DataFrame) -> Profiles:
    """From rows (iter, genes, n); the names are those of the edges' genes."""
    names = sorted({g for r in edges.select("parent", "child").distinct().collect() for g in r})  # genes ** 2 rows at most
    count = (edges.agg(F.max("iter")).first()[0] or 0) + 1
    at = [F.sum(F.when(F.col("iter") == k, F.col("n")).otherwise(0)) for k in range(count)]
    return Profiles(rows.select("iter", _words(F.col("genes"), names).alias("words"), "n").groupBy("words").agg(F.array(*at).alias("counts")), names, count)


def forbidden(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """G1: ordered pairs outside the poset."""
    g = genes.select("gene_id")
    every = g.select(F.col("gene_id").alias("parent")).crossJoin(g.select(F.col("gene_id").alias("child"))).where("parent <> child")
    rounds = edges.select("iter").distinct()
    return rounds.crossJoin(F.broadcast(every)).join(edges, ["iter", "parent", "child"], "left_anti")


def projected(profiles_: DataFrame, candidates: DataFrame) -> DataFrame:
    """G2 for each child: iter, child, cands, config (the candidates present), x (whether the child is) and n.
    candidates: (iter, child, cands), a row for each child."""
    rows = beside(profiles_, candidates, F.size("cands") + 1, ["iter"], F.col("genes"))
    rows = rows.select("iter", "child", "cands", F.array_intersect("cands", "genes").alias("config"), F.array_contains("genes", F.col("child")).cast("int").alias("x"), "n")
    return rows.groupBy("iter", "child", "cands", "config", "x").agg(F.sum("n").alias("n"))


def _counted(tables: DataFrame, families: DataFrame) -> DataFrame:
    rows = beside(tables, families, F.size("parents") + 1, ["iter", "child"], F.col("config"))
    rows = rows.withColumn("config", F.array_intersect("parents", "config"))
    one = F.when(F.col("x") > 0, F.col("n")).otherwise(0)
    return rows.groupBy("iter", "child", "parents", "config").agg(F.sum("n").alias("n"), F.sum(one).alias("n1"))


def family_counts(profiles_: DataFrame, families: DataFrame) -> DataFrame:
    """Iter, child, parents, config (the parents present), n, n1 (with the child). families: (iter, child, parents)."""
    families = stored(families)
    used = families.groupBy("iter", "child").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("parents")))).alias("cands"))
    return _counted(projected(profiles_, used), families)


def log_likelihoods(counts: DataFrame) -> DataFrame:
    """Iter, child, parents, loglik; 0 * ln 0 = 0."""
    part = lambda x: F.when(x > 0, x * F.log(x / F.col("n"))).otherwise(0.0)
    return counts.groupBy("iter", "child", "parents").agg(F.sum(part(F.col("n1")) + part(F.col("n") - F.col("n1"))).alias("loglik"))


def penalty(regularization: Column, n: Column) -> Column:
    """Per parameter, 1 (aic) or ln(n) / 2 (bic)."""
    return F.when(regularization == "aic", F.lit(1.0)).when(regularization == "bic", F.log(n) / 2)


def scores(logliks: DataFrame, regularizations: DataFrame, n: DataFrame) -> DataFrame:
    """Loglik - penalty * 2 ** parents, for each regularization."""
    rows = logliks.crossJoin(F.broadcast(regularizations)).join(F.broadcast(n), "iter")
    return rows.select("iter", "regularization", "child", "parents", (F.col("loglik") - penalty(F.col("regularization"), F.col("n")) * F.pow(F.lit(2.0), F.size("parents"))).alias("score"))


def one_arc_moves(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Parent sets one poset arc away from the state's: adds and drops, with the gene that changes."""
    rows = state.join(edges.select("iter", "child", F.col("parent").alias("gene")), ["iter", "child"])
    held = F.array_contains("parents", F.col("gene"))
    changed = F.when(held, F.array_remove("parents", F.col("gene"))).otherwise(F.sort_array(F.array_append("parents", F.col("gene"))))
    return rows.withColumn("moved", changed)


def _regularizations(edges: DataFrame, names: tuple[str, ...]) -> DataFrame:
    if unknown := set(names) - set(PENALTIES):
        raise ValueError(f"unknown regularization: {sorted(unknown)}")
    return edges.sparkSession.createDataFrame([(r,) for r in names], "regularization string")


def _checked(edges: DataFrame) -> DataFrame:
    edges = stored(edges.select("iter", "parent", "child").distinct())
    back = edges.select("iter", F.col("child").alias("parent"), F.col("parent").alias("child"))
    if not edges.join(back, ["iter", "parent", "child"], "left_semi").isEmpty():
        raise ValueError("the poset holds an arc in both directions")
    return edges


def _starts(edges: DataFrame, restarts: int, seed: int) -> DataFrame:
    """iter, child, cands, restart, parents: none for restart 0, else each candidate by one chance in five, the same one in every
    iteration that has it."""
    cands = edges.groupBy("iter", "child").agg(F.sort_array(F.collect_set("parent")).alias("cands"))
    held = lambda r: F.filter("cands", lambda p: (r > 0) & (F.pmod(F.xxhash64(F.lit(seed), r, p, F.col("child")), F.lit(5)) == 0))
    return cands.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts)))).withColumn("parents", held(F.col("restart")))


def tables(held: Profiles, edges: DataFrame) -> DataFrame:
    """G2 for each child: child, cands (places of its candidates in any round), config (their bits), x (whether the child is there)
    and counts. At most 2 ** (candidates + 1) rows for a child, whatever the samples."""
    at = {g: k for k, g in enumerate(held.names)}
    cands: dict[int, set[int]] = {}
    for r in edges.select("parent", "child").distinct().collect():  # genes ** 2 rows at most
        cands.setdefault(at[r.child], set()).add(at[r.parent])
    width = words_for(len(held.names))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(0, c, sorted(ps), [signed(sum(1 << (p % WORD) for p in ps if p // WORD == w)) for w in range(width)]) for c, ps in cands.items()]
    small = held.rows.sparkSession.createDataFrame(rows, "one int, child int, cands array<int>, mask array<bigint>")
    both = beside(held.rows.withColumn("one", F.lit(0)), small, F.size("cands") + width, ["one"], F.col("words"))
    x = F.getbit(F.get("words", F.floor(F.col("child") / WORD).cast("int")), F.col("child") % WORD).cast("int")
    both = both.select("child", "cands", F.zip_with("words", "mask", lambda w, m: w.bitwiseAND(m)).alias("config"), x.alias("x"), "counts")
    return added(both, ["child", "cands", "config", "x"], held.count)


def _in_tasks(tables_: DataFrame, starts: DataFrame, n: DataFrame, held: Profiles, regularizations: tuple[str, ...], search) -> DataFrame:
    """iter, regularization, parent, child by search(table, starts, penalty, allowed), one task for each child."""
    names, count = held.names, held.count
    at = {g: k for k, g in enumerate(names)}
    starts = starts.join(F.broadcast(n.select("iter", F.col("n").alias("total"))), "iter").select(_place("child", names).alias("child"), "iter", "restart", "parents", "cands", "total")

    def best(key: tuple, part: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(part) and len(begin):
            cands = part.cands.iat[0].tolist()
            words = np.stack(part.config.to_numpy()).astype("<i8").view(np.uint8)
            bits = np.unpackbits(words, axis=1, bitorder="little")[:, cands]
            table = climb.Table(bits, part.x.to_numpy(), np.stack(part.counts.to_numpy()))
            bit = {names[k]: 1 << b for b, k in enumerate(cands)}
            mask = lambda genes: sum(bit[g] for g in genes)
            allowed, total, masks = np.zeros(count, object), np.ones(count), {}
            for r in begin.sort_values(["iter", "restart"]).itertuples():
                allowed[r.iter], total[r.iter] = mask(r.cands), r.total
                masks.setdefault(r.iter, []).append(mask(r.parents))
            for name in regularizations:
                penalty = np.ones(count) if name == "aic" else np.log(total) / 2
                for it, found in search(table, masks, penalty, allowed).items():
                    out += [(it, name, g, names[key[0]]) for g in bit if found & bit[g]]
        return pd.DataFrame(out, columns=["iter", "regularization", "parent", "child"])

    both = spread(tables_, "child").groupBy("child").cogroup(spread(starts, "child").groupBy("child"))
    return both.applyInPandas(best, "iter int, regularization string, parent string, child string")


def _place(column: str, names: list[str]) -> Column:
    return F.try_element_at(_places(names), F.col(column))


def _places(names: list[str]) -> Column:
    """The place of each name, as a literal: one that is parsed from JSON would be parsed for each row."""
    return F.map_from_arrays(F.lit(names), F.lit(list(range(len(names))))) if names else F.create_map().cast("map<string,int>")


def best_moves(state: DataFrame, edges: DataFrame, value) -> DataFrame:
    """One round: the move of most gain of each state (iter, regularization, child, restart, parents, score) that gains more
    than 1e-8, equal gains to the smallest gene; with its gene and gain. value(families): their scores."""
    key = ["iter", "regularization", "child", "restart"]
    moves = one_arc_moves(state, edges).select(*key, "gene", "score", F.col("moved").alias("parents"))
    gains = moves.withColumnRenamed("score", "old").join(value(moves), ["iter", "regularization", "child", "parents"])
    gains = gains.withColumn("gain", F.round(F.col("score") - F.col("old"), 9)).where("score - old > 1e-8").groupBy(*key)
    best = gains.agg(F.min(F.struct((-F.col("gain")).alias("g"), "gene", "parents", "score", "gain")).alias("m"))
    return best.select(*key, "m.parents", "m.score", "m.gene", "m.gain")


def _rounds(tables: DataFrame, starts: DataFrame, edges: DataFrame, n: DataFrame, regs: DataFrame, most: int) -> DataFrame:
    """iter, regularization, parent, child by DataFrame rounds over the children's counts."""

    def value(families: DataFrame) -> DataFrame:
        return scores(log_likelihoods(_counted(tables, stored(families.select("iter", "child", "parents").distinct()))), regs, n)

    key = ["iter", "regularization", "child", "restart"]
    state = stored(starts.join(value(starts), ["iter", "child", "parents"]).select(*key, "parents", "score"))
    done = []
    for _ in range(most):
        best = stored(best_moves(state, edges, value).drop("gene", "gain"))
        done.append(state.join(best, key, "left_anti"))
        state = best
        if best.isEmpty():
            break
    ended = functools.reduce(DataFrame.unionByName, [*done, state])
    final = ended.groupBy("iter", "regularization", "child").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "restart", "parents")).alias("m"))
    return final.select("iter", "regularization", F.explode("m.parents").alias("parent"), "child")


def _searched(profiles_: DataFrame | Profiles, edges: DataFrame, n: DataFrame, regularizations: tuple[str, ...], restarts: int, seed: int, search, max_cells: int, rounds=None) -> DataFrame:
    edges = _checked(edges)
    _regularizations(edges, regularizations)
    held = profiles_ if isinstance(profiles_, Profiles) else from_long(profiles_, edges)
    if not held.names:
        return edges.sparkSession.createDataFrame([], "iter int, regularization string, parent string, child string")
    starts, tables_ = _starts(edges, restarts, seed), stored(tables(held, edges))
    sizes = tables_.groupBy("child").agg((F.count("*") * (F.size(F.first("cands")) + held.count)).alias("cells"))
    large = [held.names[r.child] for r in sizes.where(F.col("cells") > max_cells).select("child").collect()] if rounds else []  # a row for each gene
    small = _in_tasks(tables_, starts.where(~F.col("child").isin(large)) if large else starts, n, held, tuple(regularizations), search)
    if not large:
        return small
    theirs = tables_.select(_label(F.col("child"), held.names).alias("child"), F.transform("cands", lambda k: _label(k, held.names)).alias("cands"), labels(F.col("config"), held.names).alias("config"), "x", "counts")
    theirs = stored(unrolled(theirs.where(F.col("child").isin(large)), "n"))
    return small.unionByName(rounds(theirs, stored(starts.where(F.col("child").isin(large)).drop("cands")), edges.where(F.col("child").isin(large))))


def _label(at: Column, names: list[str]) -> Column:
    return F.get(F.lit(names), at)


def hill_climb(profiles_: DataFrame | Profiles, edges: DataFrame, n: DataFrame, regularizations: tuple[str, ...] = PENALTIES, restarts: int = 10, seed: int = 1, most: int = 200, max_cells: int = MAX_CELLS) -> DataFrame:
    """Iter, regularization, parent, child. A move must gain more than 1e-8; equal gains go to the smallest gene."""
    regs = _regularizations(edges, regularizations)
    search = lambda table, starts, penalty, allowed: climb.restarted(table, starts, penalty, allowed, most)
    return _searched(profiles_, edges, n, regularizations, restarts, seed, search, max_cells, lambda tables_, starts, few: _rounds(tables_, starts, few, n, regs, most))


def tabu_search(profiles_: DataFrame | Profiles, edges: DataFrame, n: DataFrame, regularizations: tuple[str, ...] = PENALTIES) -> DataFrame:
    """As hill_climb(), by tabu search per child, one task for each child."""
    search = lambda table, starts, penalty, allowed: {it: climb.tabu(table, penalty[it], masks[0], it=it, allowed=int(allowed[it])) for it, masks in starts.items()}
    return _searched(profiles_, edges, n, regularizations, 0, 0, search, MAX_CELLS)


def best_parents(profiles_: DataFrame | Profiles, edges: DataFrame, n: DataFrame, regularizations: tuple[str, ...] = PENALTIES) -> DataFrame:
    """As hill_climb(), the parents of the highest score there is, by branch and bound: a certificate for the searches."""
    search = lambda table, starts, penalty, allowed: {it: climb.exact(table, penalty[it], it, int(allowed[it])) for it in starts}
    return _searched(profiles_, edges, n, regularizations, 0, 0, search, MAX_CELLS)


def network_scores(profiles_: DataFrame | Profiles, found: DataFrame, edges: DataFrame, n: DataFrame, regularizations: tuple[str, ...] = PENALTIES) -> DataFrame:
    """iter, regularization, child, parents, score of an inference (iter, regularization, parent, child) at each child with a candidate."""
    regs = _regularizations(edges, regularizations)
    every = edges.select("iter", "child").distinct().crossJoin(F.broadcast(regs))  # two names
    held = found.groupBy("iter", "regularization", "child").agg(F.sort_array(F.collect_set("parent")).alias("parents"))
    held = every.join(held, ["iter", "regularization", "child"], "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    long = long_profiles(profiles_) if isinstance(profiles_, Profiles) else profiles_
    scored = scores(log_likelihoods(family_counts(long, held.select("iter", "child", "parents").distinct())), regs, n)
    return held.join(scored, ["iter", "regularization", "child", "parents"])
