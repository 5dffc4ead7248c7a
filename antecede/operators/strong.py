"""Strongly connected parts, and the hierarchy ranking of one large graph part by part.

An arc between two parts is in no cycle: it carries no circulation, costs no agony and only puts its child above its parent.
So each part is a problem of its own, solved in a task apart from the others or with a few, and what is left of the whole graph are ranks that rise
along the arcs between parts. The result is that of ranking.minimum_agony(), where the whole graph is one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.functions import agony
from antecede.operators.ranking import KEYS, with_keys
from antecede.sources.tables import spread, stored

#: Steps along the arcs between two tables written.
HOPS = 3
#: Arcs of a bucket of whole parts, about.
BUCKET_ARCS = 4096
_PART = "iter int, rep int, part string, nodes array<string>, ranks array<long>, low array<long>, high array<long>, gap array<long>, agony long, circulation long"
_RANK = "iter int, rep int, gene_id string, part string, rank long, moved boolean, many boolean"


def _marked(arcs: DataFrame) -> DataFrame:
    """Per node of the arcs: ahead, the largest label among the nodes that reach it, and behind, among those it reaches."""
    way = lambda a, b, kind: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(kind).alias("way"))
    steps = arcs.select(*KEYS, F.explode(F.array(way("parent", "child", "down"), way("child", "parent", "up"), way("parent", "parent", "own"), way("child", "child", "own"))).alias("w"))
    steps = stored(steps.select(*KEYS, "w.*").distinct())
    own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("name"))  # by hash, so that paths break up evenly
    marks = steps.where("way = 'own'").select(*KEYS, F.col("a").alias("gene_id"), own.alias("ahead"), own.alias("behind"), F.lit(True).alias("moved"))
    stays = F.col("way") == "own"
    while True:
        for _ in range(HOPS):
            sent = steps.join(marks.withColumnRenamed("gene_id", "a"), [*KEYS, "a"]).groupBy(*KEYS, F.col("b").alias("gene_id"))
            ahead, behind = F.max(F.when(F.col("way") != "up", F.col("ahead"))), F.max(F.when(F.col("way") != "down", F.col("behind")))
            marks = sent.agg(ahead.alias("ahead"), behind.alias("behind"), F.max(F.when(stays, F.struct("ahead", "behind"))).alias("before"))
            marks = marks.select(*KEYS, "gene_id", "ahead", "behind", (F.struct("ahead", "behind") != F.col("before")).alias("moved"))
        marks = stored(marks)
        if marks.where("moved").isEmpty():
            return marks.drop("moved")


def strong_parts(arcs: DataFrame) -> DataFrame:
    """iter, rep, gene_id, part: the least label of the genes that a gene reaches and is reached from, its own included.

    Forward-backward reachability by labels: a gene whose largest label ahead is its largest behind lies on a cycle with that
    label's gene. Such parts are taken out, arcs between genes of different labels are in no cycle and go, and the rest is
    marked again. The rounds of one marking grow with the longest shortest path, the markings about with the logarithm of the
    genes. No row is larger than two labels, and a gene of many arcs is summed on the map side.
    """
    arcs = stored(with_keys(arcs).where("parent <> child and weight > 0").select(*KEYS, "parent", "child").distinct())
    nodes, live, found = arcs.select(*KEYS, F.explode(F.array("parent", "child")).alias("gene_id")).distinct(), arcs, []
    while True:
        for end, other in (("parent", "child"), ("child", "parent")):  # a gene without arcs on both sides is in no cycle
            live = live.join(live.select(*KEYS, F.col(other).alias(end)).distinct(), [*KEYS, end], "left_semi")
        live = stored(live.select(*KEYS, "parent", "child"))
        if live.isEmpty():
            break
        marks = _marked(live)
        found.append(marks.where("ahead = behind").select(*KEYS, "gene_id", F.col("ahead.name").alias("root")))
        open_ = marks.where("ahead <> behind").select(*KEYS, "gene_id", F.struct("ahead", "behind").alias("m"))
        both = live.join(open_.withColumnsRenamed({"gene_id": "parent", "m": "mp"}), [*KEYS, "parent"]).join(open_.withColumnsRenamed({"gene_id": "child", "m": "mc"}), [*KEYS, "child"])
        live = both.where("mp = mc").select(*KEYS, "parent", "child")
    if not found:
        return nodes.withColumn("part", F.col("gene_id"))
    of = found[0]
    for more in found[1:]:
        of = of.union(more)
    of = stored(of)
    least = of.groupBy(*KEYS, "root").agg(F.min("gene_id").alias("part"))
    of = of.join(least, [*KEYS, "root"]).select(*KEYS, "gene_id", "part")
    return nodes.join(of, [*KEYS, "gene_id"], "left").select(*KEYS, "gene_id", F.coalesce("part", "gene_id").alias("part"))


def _solve(arcs: pd.DataFrame) -> pd.DataFrame:
    """One row for each part of the bucket. Parts share no gene, so together they are one graph whose optimum is theirs."""
    keys = [*KEYS, "part"]
    arcs = arcs.assign(at=arcs.groupby(keys).ngroup())
    names, code = np.unique(np.concatenate([arcs.parent, arcs.child]).astype(object), return_inverse=True)
    genes, ends = np.unique(np.tile(arcs["at"].to_numpy(np.int64), 2) * len(names) + code, return_inverse=True)
    u, v = np.split(ends, 2)
    w = arcs.weight.to_numpy(np.int64)
    flow = agony.circulation(len(genes), u, v, w)
    low, high, gap = agony.constraints(u, v, w, flow)
    rank = agony.least(np.zeros(len(genes), np.int64), low, high, gap)
    out = arcs.drop_duplicates("at").sort_values("at")[keys].reset_index(drop=True)
    first = np.searchsorted(genes // len(names), np.arange(len(out) + 1))
    by_part = np.argsort(genes[low], kind="stable")
    low, high, gap = low[by_part], high[by_part], gap[by_part]
    own = np.searchsorted(low, first)
    cut = lambda x, at, less=None: [x[a:b] - (0 if less is None else less[k]) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
    out["nodes"] = [names[genes[a:b] % len(names)] for a, b in zip(first[:-1], first[1:], strict=True)]
    out["ranks"], out["low"], out["high"], out["gap"] = cut(rank, first), cut(low, own, first), cut(high, own, first), cut(gap, own)
    cost = w * np.maximum(rank[u] - rank[v] + 1, 0)
    for name, x in (("agony", cost), ("circulation", flow)):
        out[name] = np.bincount(arcs["at"], x, len(out)).astype(np.int64) if x.sum() < 1 << 53 else [int(x[arcs["at"] == k].sum()) for k in range(len(out))]
    return out


def _raise(batches):
    """Rows of a part with its genes' ranks in order of label: the least ranks from these upwards, for a batch of parts at once."""
    for parts in batches:
        first = np.r_[0, np.cumsum([len(g) for g in parts.genes], dtype=np.int64)]
        genes = [g for p in parts.genes for g in p]
        given = np.array([g["rank"] for g in genes], np.int64)
        many = [len(x) for x in parts.low]
        low, high, gap = (np.concatenate([np.zeros(0, np.int64), *parts[k]]).astype(np.int64) for k in ("low", "high", "gap"))
        rank = agony.least(given, low + np.repeat(first[:-1], many), high + np.repeat(first[:-1], many), gap)
        out = parts[[*KEYS, "part"]].loc[parts.index.repeat(np.diff(first))].reset_index(drop=True)
        moved = (rank > given) | np.array([g["moved"] for g in genes], bool)
        yield out.assign(gene_id=[g["gene_id"] for g in genes], rank=rank, moved=moved, many=True)[["iter", "rep", "gene_id", "part", "rank", "moved", "many"]]


def minimum_agony(arcs: DataFrame) -> DataFrame:
    """As ranking.minimum_agony(), for graphs of any number of genes whose strong parts each fit in a task.

    Parts of two genes and more are solved in buckets, a part whole in one; their number grows with the arcs. Then ranks rise in rounds, one for each step of the
    longest chain of parts: only genes that moved send theirs along the arcs between parts, and parts raise their other genes by
    the constraints that their optimal flow left.
    """
    arcs = stored(with_keys(arcs).where("parent <> child").groupBy(*KEYS, "parent", "child").agg(F.sum("weight").alias("weight")))
    of = strong_parts(arcs)
    nodes = arcs.select(*KEYS, F.explode(F.array("parent", "child")).alias("gene_id")).distinct()  # an arc of weight 0 has genes and no say
    of = stored(nodes.join(of, [*KEYS, "gene_id"], "left").select(*KEYS, "gene_id", F.coalesce("part", "gene_id").alias("part")))
    ends = arcs.where("weight > 0")
    for end in ("parent", "child"):
        ends = ends.join(of.withColumnsRenamed({"gene_id": end, "part": f"{end}_part"}), [*KEYS, end])
    ends = stored(ends)
    inside = ends.where("parent_part = child_part").select(*KEYS, F.col("parent_part").alias("part"), "parent", "child", "weight")
    buckets = 2 * int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")) + inside.count() // BUCKET_ARCS
    bucket = F.pmod(F.xxhash64(*KEYS, "part"), F.lit(buckets)).alias("bucket")
    solved = stored(spread(inside.withColumn("bucket", bucket), "bucket").groupBy("bucket").applyInPandas(lambda x: _solve(x), _PART))
    between = stored(ends.where("parent_part <> child_part").select(*KEYS, F.col("parent").alias("gene_id"), "child"))

    first = solved.select(*KEYS, F.explode(F.arrays_zip("nodes", "ranks")).alias("x")).select(*KEYS, F.col("x.nodes").alias("gene_id"), F.col("x.ranks").alias("rank"))
    rules = solved.select(*KEYS, "part", "low", "high", "gap")
    ranks = of.join(first, [*KEYS, "gene_id"], "left").select(*KEYS, "gene_id", "part", F.coalesce("rank", F.lit(0).cast("long")).alias("rank"), F.lit(True).alias("moved"), F.col("rank").isNotNull().alias("many"))
    ranks = stored(ranks)
    while not ranks.where("moved").isEmpty():
        up = ranks.where("moved").join(between, [*KEYS, "gene_id"]).groupBy(*KEYS, F.col("child").alias("gene_id")).agg((F.max("rank") + 1).alias("up"))
        raised = F.coalesce(F.col("up") > F.col("rank"), F.lit(False))
        new = ranks.join(up, [*KEYS, "gene_id"], "left").select(*KEYS, "gene_id", "part", F.greatest("rank", "up").alias("rank"), raised.alias("moved"), "many")
        genes = new.where("many").groupBy(*KEYS, "part").agg(F.sort_array(F.collect_list(F.struct("gene_id", "rank", "moved"))).alias("genes"))  # a part, which one task has solved
        closed = genes.join(rules, [*KEYS, "part"]).mapInPandas(_raise, _RANK)
        ranks = stored(new.where("not many").union(closed))
    total = solved.groupBy(*KEYS).agg(F.sum("agony").alias("agony"), F.sum("circulation").alias("circulation"))
    none = F.lit(0).cast("long")
    out = ranks.join(total, KEYS, "left")
    return out.select(*KEYS, "gene_id", F.col("rank").cast("int").alias("rank"), F.coalesce("agony", none).alias("agony"), F.coalesce("circulation", none).alias("circulation"))
