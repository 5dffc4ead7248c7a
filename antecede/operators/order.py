"""Order of a sample's mutations and the arcs it implies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.operators.rounds import Rounds, joined, unrolled, vectors

KEYS = ["iter", "rep"]


def total_order(ccf: DataFrame) -> DataFrame:
    """Position (ties by gene) and tier (distinct ccf) of each mutation, the largest ccf first; per sample."""
    per = Window.partitionBy("sample_id")
    rows = ccf.where((F.col("ccf") > 0) & ~F.isnan("ccf"))
    return rows.withColumns(
        {"position": F.row_number().over(per.orderBy(F.desc("ccf"), "gene_id")), "tier": F.dense_rank().over(per.orderBy(F.desc("ccf")))}
    )


def sample_arcs(ccf: DataFrame, mode: str = "tiers") -> DataFrame:
    """The arcs of each sample: sample_id, parent, child, weight. tiers: every gene of a tier to every gene of the next.
    compat: the gene at position j to the one at j + 1, weighted by the sizes of tiers j and j + 1."""
    per = Window.partitionBy("sample_id")
    rows = total_order(ccf)
    if mode == "tiers":
        # the genes of a tier once for each (sample, tier); the next tier is the next row, so no self-join
        tiers = rows.groupBy("sample_id", "tier").agg(F.collect_list("gene_id").alias("genes"))
        pairs = tiers.withColumn("next", F.lead("genes").over(per.orderBy("tier"))).where("next is not null")
        return pairs.select("sample_id", F.explode("genes").alias("parent"), "next").select("sample_id", "parent", F.explode("next").alias("child"), F.lit(1).cast("long").alias("weight"))
    if mode != "compat":
        raise ValueError(mode)
    sizes = rows.groupBy("sample_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "gene_id"))), lambda x: x["gene_id"]).alias("genes"),
        F.max("tier").alias("tiers"),
        F.sort_array(F.collect_list("tier")).alias("t"),
    )
    sizes = sizes.where("tiers > 1").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("tiers") - 1)))
    many = lambda j: F.size(F.filter("t", lambda t: t == j))
    return sizes.select("sample_id", F.element_at("genes", F.col("j")).alias("parent"), F.element_at("genes", F.col("j") + 1).alias("child"), (many(F.col("j")) * many(F.col("j") + 1)).cast("long").alias("weight"))


def arcs(ccf: DataFrame, mode: str = "tiers", rounds: Rounds | None = None) -> DataFrame:
    """Weighted arcs (parent, child, weight); with rounds, for each iter. A sample is put in order once; its arcs are
    summed for all its rounds at once, on the map side."""
    return by_round(sample_arcs(ccf, mode), rounds)


def by_round(pairs: DataFrame, rounds: Rounds | None) -> DataFrame:
    """Arcs of samples (sample_id, parent, child, weight) summed; with rounds, for each iter."""
    if rounds is None:
        return weighed(pairs.drop("sample_id"))
    pairs = joined(pairs.where("parent <> child"), rounds)
    return unrolled(vectors(pairs, ["parent", "child"], rounds.count, F.col("weight")), "weight")


def tree_arcs(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """D3: tree edges between known genes as weighted arcs, multiplicity kept."""
    known = F.broadcast(genes.select("gene_id"))
    rows = edges.join(known.withColumnRenamed("gene_id", "parent"), "parent", "left_semi").join(known.withColumnRenamed("gene_id", "child"), "child", "left_semi")
    return weighed(rows.withColumn("weight", F.lit(1).cast("long")))


def weighed(arcs_: DataFrame) -> DataFrame:
    """Equal arcs summed within their keys, self-loops dropped."""
    keys = [k for k in KEYS if k in arcs_.columns]
    return arcs_.where("parent <> child").groupBy(*keys, "parent", "child").agg(F.sum("weight").alias("weight"))
