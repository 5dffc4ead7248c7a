"""Survival signatures: Cox risk sets, lasso selection, risk clusters and prevalence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antecede.functions import lasso
from antecede.operators import coxpath
from antecede.operators.running import running
from antecede.sources.tables import beside, spread, stored

#: Steps shown in all compacted rows up to which the lasso path runs in one task for each fold: some 400 MB.
MAX_CELLS = 10_000_000


def risk_scores(survival: DataFrame, steps: DataFrame, coefs: DataFrame) -> DataFrame:
    """H6: survival columns with beta = sum of coefficients of the patient's steps, to 1e-9; 0 without any."""
    held = beside(steps, coefs, F.lit(1), ["step"], F.col("sample_id")).groupBy("sample_id").agg(F.sum("coef").alias("b"))
    return survival.join(held, "sample_id", "left").withColumn("beta", F.round(F.coalesce("b", F.lit(0.0)), 9) + F.lit(0.0)).drop("b")


def risk_sets(scored: DataFrame) -> DataFrame:
    """H2: per distinct time: events d, at_risk, s0 = sum of exp(beta) over those still at risk (Breslow)."""
    per = scored.groupBy("time").agg(F.sum("status").alias("d"), F.count("*").alias("n"), F.sum(F.exp("beta")).alias("e"))
    return running(per, "time", {"n": "at_risk", "e": "s0"}, descending=True).select("time", "d", "at_risk", "s0")


def cox_gradient(scored: DataFrame, steps: DataFrame) -> DataFrame:
    """H2: derivative of the log partial likelihood for each step at the scores' coefficients."""
    hazard = risk_sets(scored).withColumn("h", F.col("d") / F.col("s0"))
    hazard = running(hazard.select("time", "h"), "time", {"h": "hazard"})
    rest = scored.join(hazard, "time").select("sample_id", (F.col("status") - F.exp("beta") * F.col("hazard")).alias("r"))
    return steps.join(rest, "sample_id").groupBy("step").agg(F.sum("r").alias("gradient"))


def compacted(survival: DataFrame, steps: DataFrame, names: list[str], folds: int, seed: int) -> DataFrame:
    """steps (places in names, ascending), time, status, fold and weight, the number of such patients."""
    numbered = steps.sparkSession.createDataFrame(list(enumerate(names)), "at int, step string")
    held = beside(steps, numbered, F.lit(1), ["step"], F.col("sample_id")).groupBy("sample_id").agg(F.sort_array(F.collect_set("at")).alias("steps"))
    rows = survival.join(held, "sample_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<int>")))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "sample_id"), F.lit(folds)).cast("int"))
    return rows.groupBy("steps", "time", "status", "fold").agg(F.count("*").alias("weight"))


def step_names(steps: DataFrame) -> list[str]:
    return sorted(r[0] for r in steps.select("step").distinct().collect())  # one row for each step: genes ** 2 at most


def select_steps(survival: DataFrame, steps: DataFrame, folds: int = 10, seed: int = 1, count: int = 100, max_cells: int = MAX_CELLS) -> DataFrame:
    """H3-H5: step, coef, direction of the non-zero coefficients at the lambda of least cross-validated deviance.

    Patients of equal steps, time and status become one weighted row first. Up to max_cells steps shown in these rows each fold's
    path is a task of its own; beyond, all folds go through the rounds of coxpath.fit(), which settle by the same rule.
    """
    names = step_names(steps)
    if not names:
        return steps.sparkSession.createDataFrame([], "step string, coef double, direction string")
    rows = stored(compacted(survival, steps, names, folds, seed))
    if (rows.agg(F.sum(F.size("steps") + 1)).first()[0] or 0) > max_cells:
        whole, loss = coxpath.fit(rows, len(names), folds, count)
        return _chosen(steps, names, whole[int(np.argmin(loss))])

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["time", "status", "fold", "weight"], kind="stable")
        columns = [part.time.to_numpy(float), part.status.to_numpy(float), part.weight.to_numpy(float)]
        whole = lasso.Cox(list(part.steps), len(names), *columns)
        grid = lasso.lambdas(whole, count)
        out, k = key[0], np.arange(len(grid))
        if out < 0:
            return pd.DataFrame({"fold": out, "k": k, "deviance": 0.0, "coefs": list(lasso.path(whole, grid))})
        inner = part.fold.to_numpy() != out
        if not (columns[1][inner] > 0).any() or inner.all():
            return pd.DataFrame({"fold": out, "k": k, "deviance": 0.0, "coefs": [np.zeros(0)] * len(k)})
        train = lasso.Cox(list(part.steps[inner]), len(names), *[x[inner] for x in columns])
        # deviance of the held-out fold: that of all rows less that of the training rows, at the same coefficients
        value = [-2 * (whole.value(b) * whole.n - train.value(b) * train.n) for b in lasso.path(train, grid)]
        return pd.DataFrame({"fold": out, "k": k, "deviance": value, "coefs": [np.zeros(0)] * len(k)})

    tasks = rows.withColumn("task", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1))))
    fits = spread(tasks, "task").groupBy("task").applyInPandas(run, "fold int, k int, deviance double, coefs array<double>").toPandas()  # folds x lambdas rows
    loss = fits[fits.fold >= 0].groupby("k").deviance.sum()
    best = int(loss.idxmin()) if len(loss) else 0
    coefs = fits[(fits.fold < 0) & (fits.k == best)].coefs.iat[0]
    return _chosen(steps, names, coefs)


def _chosen(steps: DataFrame, names: list[str], coefs: np.ndarray) -> DataFrame:
    chosen = [(names[k], float(c), "positive" if c > 0 else "negative") for k, c in enumerate(coefs) if c != 0]
    return steps.sparkSession.createDataFrame(chosen, "step string, coef double, direction string").orderBy("step")


def hinges(scored: DataFrame) -> DataFrame:
    """H7: the distinct values among lower hinge, median and upper hinge of beta (at most three rows: cut)."""
    counts = scored.groupBy("beta").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    ranked = running(counts, "beta", {"c": "upto"}).crossJoin(F.broadcast(total))
    quarter = F.floor((F.col("n") + 3) / 2) / 2
    depths = F.array(quarter, (F.col("n") + 1) / 2, F.col("n") + 1 - quarter)
    wanted = ranked.select("beta", "c", "upto", F.posexplode(depths).alias("which", "depth"))
    inside = lambda d: (F.col("upto") >= d) & (F.col("upto") - F.col("c") < d)
    low = wanted.where(inside(F.floor("depth"))).select("which", F.col("beta").alias("v"))
    high = wanted.where(inside(F.ceil("depth"))).select("which", F.col("beta").alias("v"))
    return low.union(high).groupBy("which").agg((F.sum("v") / 2).alias("cut")).select("cut").distinct()


def clusters(scored: DataFrame) -> DataFrame:
    """H8, H9: scored with cluster C1.. by the hinges passed, numbered densely."""
    cuts = hinges(scored).agg(F.collect_list("cut").alias("cuts"))  # one row
    passed = F.size(F.filter("cuts", lambda c: F.col("beta") >= c))
    rows = scored.crossJoin(F.broadcast(cuts)).withColumn("level", passed).drop("cuts")
    names = rows.select("level").distinct().withColumn("cluster", F.concat(F.lit("C"), F.row_number().over(Window.orderBy("level"))))  # four rows at most
    return rows.join(F.broadcast(names), "level").drop("level")


def prevalence(clustered: DataFrame, steps: DataFrame) -> DataFrame:
    """Share of each cluster's patients that show each step, zeros included."""
    size = clustered.groupBy("cluster").agg(F.count("*").alias("size"))
    grid = size.crossJoin(F.broadcast(steps.select("step").distinct()))  # four clusters at most
    seen = clustered.join(steps.distinct(), "sample_id").groupBy("cluster", "step").agg(F.count("*").alias("c"))
    return grid.join(seen, ["cluster", "step"], "left").select("cluster", "step", (F.coalesce("c", F.lit(0)) / F.col("size")).alias("prevalence"))


def kaplan_meier(clustered: DataFrame) -> DataFrame:
    """Per cluster and time of an event: events, at_risk, survival."""
    per = clustered.groupBy("cluster", "time").agg(F.sum("status").alias("events"), F.count("*").alias("n"))
    per = running(per, "time", {"n": "at_risk"}, descending=True, keys=("cluster",)).where("events > 0")
    per = per.withColumns({"fall": F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0), "end": (F.col("events") == F.col("at_risk")).cast("int")})
    per = running(per, "time", {"fall": "sum", "end": "ended"}, keys=("cluster",))
    return per.select("cluster", "time", "events", "at_risk", F.when(F.col("ended") > 0, 0.0).otherwise(F.exp("sum")).alias("survival"))


def gate(clustered: DataFrame) -> Column:
    """Whether there are at least two clusters (an aggregate)."""
    return F.count_distinct(clustered["cluster"]) >= 2


def patient_steps(ccf: DataFrame, inference: DataFrame) -> DataFrame:
    """Bridge: (sample_id, step) where a patient has both genes and the parent's ccf is larger. inference: distinct (parent, child)."""
    edges = inference.select("parent", "child").distinct()
    a = ccf.select("sample_id", F.col("gene_id").alias("parent"), F.col("ccf").alias("cp"))
    b = ccf.select("sample_id", F.col("gene_id").alias("child"), F.col("ccf").alias("cc"))
    rows = beside(a, stored(edges), F.lit(2), ["parent"], F.col("sample_id")).join(b, ["sample_id", "child"]).where("cp > cc")
    return rows.select("sample_id", F.concat("parent", F.lit("->"), "child").alias("step"))
