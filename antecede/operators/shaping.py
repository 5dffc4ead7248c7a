"""Filters, recodings and audits of mutation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.operators.rounds import added


def latest_rows(vaf: DataFrame) -> DataFrame:
    """Of repeated (sample, gene) rows, the one of the largest row_id."""
    rest = [c for c in vaf.columns if c not in ("sample_id", "gene_id")]
    last = vaf.groupBy("sample_id", "gene_id").agg(F.max_by(F.struct(*rest), "row_id").alias("r"))
    return last.select("sample_id", "gene_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def with_ccf(vaf: DataFrame, vaf_col: str = "vaf_estimate") -> DataFrame:
    """ccf = copies of the mutated locus times vaf, clamped to [0, 1]; undefined stays null."""
    raw = (F.col("normal_ploidy") + (F.col("copy_number") - F.col("normal_ploidy"))) * F.col(vaf_col)
    return vaf.withColumn("ccf", F.when(~F.isnan(raw), F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))))


def observed(ccf: DataFrame) -> DataFrame:
    """B1: rows with ccf > 0; null and NaN are unobserved."""
    return ccf.where((F.col("ccf") > 0) & ~F.isnan("ccf"))


def gene_index(mutations: DataFrame) -> DataFrame:
    """Genes with their 1-based index by label; one row for each gene, so the single window is small."""
    return mutations.select("gene_id").distinct().withColumn("gene_index", F.row_number().over(Window.orderBy("gene_id")))


def states(mutations: DataFrame, samples: DataFrame, genes: DataFrame) -> DataFrame:
    """Every sample x gene as observed or missing."""
    grid = samples.select("sample_id").crossJoin(F.broadcast(genes.select("gene_id")))  # genes: one row for each gene
    seen = observed(mutations).select("sample_id", "gene_id", F.lit(1).alias("seen"))
    return grid.join(seen, ["sample_id", "gene_id"], "left").select(
        "sample_id", "gene_id", F.when(F.col("seen") == 1, "observed").otherwise("missing").alias("state")
    )


def keep_samples(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """B7."""
    return rows.join(samples.select("sample_id"), "sample_id", "left_semi")


def keep_genes(rows: DataFrame, genes: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns all hold known genes."""
    for c in columns:
        rows = rows.join(F.broadcast(genes.select(F.col("gene_id").alias(c))), c, "left_semi")
    return rows


def nested_trees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A3 backwards: sample_id, nodes (distinct, sorted), edges (sorted, repeats kept); edges of samples without a node are kept, with
    no nodes."""
    arc = "struct<parent:string,child:string>"
    rows = nodes.select("sample_id", "gene_id", F.lit(None).cast(arc).alias("e")).unionByName(edges.select("sample_id", F.lit(None).cast("string").alias("gene_id"), F.struct("parent", "child").cast(arc).alias("e")))
    return rows.groupBy("sample_id").agg(F.sort_array(F.collect_set("gene_id")).alias("nodes"), F.sort_array(F.collect_list("e")).alias("edges"))


def known_genes(alike: DataFrame, names: list[str], count: int = 1) -> DataFrame:
    """B8 for trees counted by shape: their known genes, distinct and sorted, and the edges between these, sorted; shapes that are
    the same then are added up."""
    known = F.lit(names).cast("array<string>")
    inside = F.filter("edges", lambda e: F.array_contains(known, e["parent"]) & F.array_contains(known, e["child"]))
    none = F.array().cast("array<struct<parent:string,child:string>>")
    rows = alike.select(F.sort_array(F.array_intersect("nodes", known)).alias("nodes"), F.coalesce(F.sort_array(inside), none).alias("edges"), "drawn", "counts")
    return added(rows, ["nodes", "edges", "drawn"], count)


def consistency_audit(dataset: DataFrame, ccf: DataFrame, vaf: DataFrame) -> DataFrame:
    """(sample, gene, reason) where the three tables disagree."""
    key = ["sample_id", "gene_id"]
    d, c, v = (x.select(*key).distinct() for x in (dataset, observed(ccf), vaf))
    say = lambda rows, reason: rows.withColumn("reason", F.lit(reason))
    return (
        say(d.join(c, key, "left_anti"), "mutation without ccf")
        .unionByName(say(c.join(d, key, "left_anti"), "ccf without mutation"))
        .unionByName(say(d.join(v, key, "left_anti"), "mutation without vaf"))
    )


def adjacency(edges: DataFrame, genes: list[str]) -> DataFrame:
    """Edges as a 0/1 matrix, one row for each parent, one column for each gene (presentation of a small table)."""
    marked = edges.select("parent", "child", F.lit(1).alias("x"))
    wide = marked.groupBy("parent").pivot("child", genes).agg(F.max("x"))
    every = edges.sparkSession.createDataFrame([(g,) for g in genes], "parent string")
    return every.join(wide, "parent", "left").fillna(0)


def bind_survival(survival: DataFrame, steps: DataFrame) -> DataFrame:
    """A5, H1: every patient with the array of its steps, empty if none."""
    per = steps.groupBy("sample_id").agg(F.sort_array(F.collect_set("step")).alias("steps"))
    out = survival.join(per, "sample_id", "left")
    return out.withColumn("steps", F.coalesce("steps", F.array().cast("array<string>")))
