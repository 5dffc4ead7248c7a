"""Embedding near-deduplication by a robust-pruned flat graph.

Vectors are compared only within their label (and length), by cosine in double precision.

(1) Equal vectors of a label form a class with a multiplicity; only its smallest vec_id goes on. (2) Overlapping shards: the
vectors of a label get centroids by k-means on a sample of about SAMPLE vectors for each centroid (by a hash of vec_id; a
documented bound), one for about `shard` vectors and at most MAX_CENTROIDS; of centroids nearer to each other than the threshold one is
kept. A vector goes to every centroid whose cut with its nearest one is near: a partner at the threshold lies tan(angle) away,
in a direction of which 1 / sqrt(dimension) falls on the normal of a cut, the dimension being the effective one of the sample;
all cuts nearer than REACH times that are crossed. So the chance that two near vectors share no shard depends neither on the
dimension nor on the number of centroids, and does not grow with the table. A shard of more than SPLIT times `shard` vectors
is split again in the same way, so long as that makes it smaller, up to LEVELS times; what is then above `shard` vectors
is dealt into blocks by a hash, so no group is larger. (3) In each block a flat graph is built: each vector's
nearest neighbours, pruned robustly (a neighbour is dropped if an already chosen one is ALPHA times nearer to it), at
most DEGREE of them, to which LONG far ones drawn by a hash are added, so that tight groups of copies stay reachable.
(4) The adjacency lists of a vector from all its shards are united. (5) Search: for each pair of blocks of a shard, all
vectors of one are queries against the graph of the other: a greedy search with a beam starts at the block's medoid, then
the range expands from what it found: every vector within SLACK of the threshold has its neighbours looked at, until nothing
new is in range. What either side finds is a link of both, verified by cosine. A pair that meets in several shards counts in
the first. A task returns numbers of links and a spanning forest, not pairs. (6) The recall is audited: about AUDIT vectors
drawn from all and as many planted partners of theirs, at a cosine just above the threshold in a random direction, which go
through all steps and add nothing to the result. Their links are compared with brute force against all different vectors
(in blocks), and the mean recall of a vector must reach `recall`, else the job stops. As partners are planted, there is
always something to measure.

Vectors of one label that are all near each other, yet different, share a shard that no split makes smaller: their
blocks are compared pair by pair, as each vector's number of links must be counted.

Vectors that are null, empty or zero, hold null or non-finite components or have no label link with nothing. Repeated rows of
a vec_id count as one vector (the least label and values). Rows without vec_id are left out. Empty table: empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import components, saved

COSINE = 0.93
SAMPLE, SHARD, MAX_CENTROIDS, REACH = 48, 1000, 256, 1.0
SPLIT, LEVELS, PORTION = 16, 4, 8192
DEGREE, LONG, CANDIDATES, ALPHA, BEAM, SLACK = 16, 8, 64, 1.2, 24, 0.05
AUDIT, RECALL = 200, 0.9


def _matrix(column: pd.Series | list) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def kmeans(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Unit centroids, started from distinct rows of x at even steps."""
    x = np.unique(x, axis=0)
    x = x[np.argsort(C.mix(np.arange(len(x), dtype=np.uint64) + np.uint64(5)))]
    centre = x[: max(1, min(k, len(x)))].copy()
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-300), centre)
    return centre


def centroids(x: np.ndarray, k: int, least: float) -> tuple[np.ndarray, float]:
    """At most k centroids of the sample x, the fullest first, no two nearer than the threshold; and how near a cut is crossed."""
    centre = kmeans(x, k)
    full = np.bincount((x @ centre.T).argmax(1), minlength=len(centre))
    centre = centre[np.argsort(-full, kind="stable")]
    kept: list[int] = []
    cos = centre @ centre.T
    for i in range(len(centre)):
        if not kept or cos[i, kept].max() < least:
            kept.append(i)
    away = x - x.mean(0)
    spread = away.T @ away
    dimension = max(1.0, np.trace(spread) ** 2 / max((spread**2).sum(), 1e-300))
    angle = math.acos(min(1.0, max(0.0, least)))
    return centre[kept], min(math.sin(angle), REACH * math.tan(min(angle, 1.5)) / math.sqrt(dimension))


def reached(x: np.ndarray, centre: np.ndarray, margin: float) -> np.ndarray:
    """Boolean matrix (vector, centroid): the nearest one, and those whose cut with it is at most margin away."""
    cos = x @ centre.T
    home = cos.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (centre @ centre.T), 1e-12))
    out = cos.max(1)[:, None] - cos <= margin * apart[home]
    out[np.arange(len(x)), home] = True
    return out


def robust_prune(x: np.ndarray) -> np.ndarray:
    """Neighbour numbers of each row of x (units), DEGREE at most, -1 where fewer: chosen from the CANDIDATES nearest."""
    n = len(x)
    take = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1, np.int32)
    if take < 1:
        return out
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(n, lo + 256))
        cos = x[rows] @ x.T
        cos[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-cos, take - 1, axis=1)[:, :take]
        own = np.take_along_axis(cos, near, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
        far = np.maximum(2 - 2 * own, 0)  # squared distances
        alive = np.ones_like(far, bool)
        for k in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            chosen = near[np.arange(len(rows)), pick]
            out[rows[some], k] = chosen[some]
            between = np.maximum(2 - 2 * np.einsum("rcd,rd->rc", x[near], x[chosen]), 0)
            alive &= ALPHA**2 * between > far
            alive[np.arange(len(rows)), pick] = False
    return out


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    ids = rows.id.to_numpy()
    n = len(ids)
    far = (C.stream(71, n * LONG) % np.uint64(n)).astype(np.int32).reshape(n, LONG)
    graph = np.concatenate([robust_prune(_matrix(rows.unit)), np.where(far == np.arange(n)[:, None], -1, far)], 1)
    # undirected: a vector no one chose is still reached through those it chose
    a = np.repeat(ids, DEGREE + LONG)[graph.reshape(-1) >= 0]
    b = ids[graph.reshape(-1)[graph.reshape(-1) >= 0]]
    pairs = pd.DataFrame({"id": np.r_[a, b], "to": np.r_[b, a]}).drop_duplicates().sort_values(["id", "to"])
    lists = pairs.groupby("id").to.apply(list)
    return pd.DataFrame({"id": ids, "neighbours": [lists.get(i, []) for i in ids]})


def search(queries: np.ndarray, nodes: np.ndarray, graph: list[np.ndarray], least: float) -> np.ndarray:
    """Boolean matrix (query, node) of what range-expanding greedy search finds at cosine >= least."""
    nq, n = len(queries), len(nodes)
    degree = max(1, max(len(g) for g in graph))
    table = np.full((n, degree), -1, np.int64)
    for i, g in enumerate(graph):
        table[i, : len(g)] = g
    medoid = int((nodes @ nodes.mean(0)).argmax())
    cos = np.full((nq, n), -2.0)
    cos[:, medoid] = queries @ nodes[medoid]
    expanded = np.zeros((nq, n), bool)

    def expand(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Looks at the neighbours of node v for query q; returns the flat places seen anew."""
        new = []
        for lo in range(0, len(q), 20_000):
            qq, to = q[lo : lo + 20_000], table[v[lo : lo + 20_000]]
            places = (qq[:, None] * n + to)[to >= 0]
            places = np.unique(places[cos.reshape(-1)[places] == -2.0])
            a, b = places // n, places % n
            cos.reshape(-1)[places] = np.einsum("rd,rd->r", queries[a], nodes[b])
            new.append(places)
        return np.concatenate(new) if new else np.zeros(0, np.int64)

    width = min(BEAM, n)
    for _ in range(4 * BEAM):  # greedy: each query expands the best of its beam that it has not
        open_ = np.where(expanded, -3.0, cos)
        best = open_.argmax(1)
        value = open_[np.arange(nq), best]
        bar = np.partition(cos, n - width, axis=1)[:, n - width]
        go = np.flatnonzero((value >= bar) & (value > -2))
        if not len(go):
            break
        expanded[go, best[go]] = True
        expand(go, best[go])
    while True:  # the range: all that is near enough shows its neighbours
        q, v = np.nonzero((cos >= least - SLACK) & ~expanded)
        if not len(q):
            return cos >= least
        expanded[q, v] = True
        expand(q, v)


def _links(least: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, cell, i, j = key
        rows = rows.sort_values(["block", "id"])
        ids, copies = rows.id.to_numpy(), rows.copies.to_numpy()
        x = _matrix(rows.unit)
        left, right = np.flatnonzero(rows.block == i), np.flatnonzero(rows.block == j)
        place = {v: k for k, v in enumerate(ids.tolist())}
        graph = [[place[v] for v in g if v in place] for g in rows.neighbours]
        # the shards before this one that each vector is in as well: a pair counts in its first
        size = rows.cells.str.len().to_numpy()
        before, owner = np.concatenate(rows.cells.to_numpy()), np.repeat(np.arange(len(ids)), size)
        owner, before = owner[before < cell], before[before < cell]
        shards, at = np.unique(before, return_inverse=True)
        earlier = np.zeros((len(ids), len(shards)), np.float32)
        earlier[owner, at] = 1

        def found(queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            number = np.full(len(ids), -1)
            number[nodes] = np.arange(len(nodes))
            inner = [np.array([number[v] for v in graph[k] if number[v] >= 0], np.int64) for k in nodes]
            return search(x[queries], x[nodes], inner, least)

        if i == j:
            hit = found(left, left)
            hit |= hit.T
            np.fill_diagonal(hit, False)
        elif len(left) and len(right):
            hit = found(left, right) | found(right, left).T
        else:
            hit = np.zeros((len(left), len(right)), bool)
        hit &= earlier[left] @ earlier[right].T == 0
        a, b = np.nonzero(hit)
        a, b = left[a], right[b]
        n = np.bincount(a, copies[b], len(ids))
        if i != j:
            n += np.bincount(b, copies[a], len(ids))
        real = (copies[a] > 0) & (copies[b] > 0)  # planted partners connect nothing
        a, b = a[real], b[real]
        group, edges = np.arange(len(ids)), []
        for u in np.unique(a):
            for v in np.unique(group[b[a == u]]):
                if v != group[u]:
                    edges.append((ids[u], ids[v]))
                    group[group == v] = group[u]
        out = pd.DataFrame({"id": ids, "links": n.astype(np.int64), "other": pd.array([None] * len(ids), "Int64")})
        tree = np.array(edges, np.int64).reshape(-1, 2)  # typed also when empty: large ids must not become floats
        forest = pd.DataFrame({"id": tree[:, 0], "links": np.zeros(len(tree), np.int64), "other": pd.array(tree[:, 1], "Int64")})
        return pd.concat([out[out.links > 0], forest])

    return run


KEY = ["label", "size", "cell"]


def shards(members: DataFrame, least: float, shard: int, split: int = SPLIT) -> DataFrame:
    """members (label, size, id, copies, unit) with the cell of each shard that they are in; see the module, step 2."""
    kind = dict(members.dtypes)["label"]
    members = members.withColumns({"cell": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")})

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        centre, margin = centroids(_matrix(rows.unit), int(rows.k.iat[0]), least)
        return pd.DataFrame({"label": [key[0]], "size": [key[1]], "cell": [key[2]], "centres": [centre.reshape(-1)], "margin": [margin]})

    def assign(key: tuple, rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=["k", "portion"]).rename(columns={"n": "parent"})
        if not len(rows) or not len(model):
            return rows
        centre = np.asarray(model.centres.iat[0]).reshape(-1, int(key[1]))
        at, to = np.nonzero(reached(_matrix(rows.unit), centre, float(model.margin.iat[0])))
        cell = C.mix(np.uint64(np.int64(key[2]).view(np.uint64)) + (to + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
        return rows.iloc[at].assign(cell=cell.astype(np.int64))

    done = None
    for level in range(LEVELS):
        members = saved(members)
        most = shard if level == 0 else shard * split
        sizes = saved(members.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("parent").alias("parent")))
        large = sizes.where((F.col("n") > most) & (F.col("parent").isNull() | (2 * F.col("n") < F.col("parent"))))
        large = large.select(*KEY, "n", F.least(F.lit(MAX_CENTROIDS), F.ceil(F.col("n") / shard)).cast("int").alias("k"))
        rest = members.join(large, KEY, "left_anti").drop("parent")
        done = rest if done is None else done.union(rest)
        if large.isEmpty():
            return done
        portions = F.ceil(F.col("n") / PORTION).cast("int")
        inside = members.drop("parent").join(large, KEY)
        drawn = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < F.least(F.lit(1.0), SAMPLE * F.col("k") / F.col("n")) * (1 << 30)
        centres = inside.where(drawn).select(*KEY, "k", "unit").groupBy(*KEY).applyInPandas(learn, f"label {kind}, size int, cell long, centres array<double>, margin double")
        centres = centres.join(large, KEY).withColumn("portion", F.explode(F.sequence(F.lit(0), portions - 1))).select(*KEY, "portion", "centres", "margin")
        inside = inside.withColumn("portion", F.pmod(F.xxhash64("id"), portions).cast("int"))
        both = inside.groupBy(*KEY, "portion").cogroup(centres.groupBy(*KEY, "portion"))
        members = both.applyInPandas(assign, f"label {kind}, size int, id long, copies long, unit array<double>, cell long, parent long")
    return done.unionByName(members.drop("parent"))


def _partners(least: float):
    """For each vector a partner at a cosine just above the threshold, with no copies of its own."""
    aim = min(1.0, least + 0.005)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = list(rows.unit)
            for k, v in enumerate(x):
                v = np.asarray(v, np.float64)
                z = np.random.default_rng(int(rows.twin.iat[k]) & 0x7FFFFFFFFFFFFFFF).normal(size=len(v))
                z -= (z @ v) * v
                norm = np.linalg.norm(z)
                x[k] = aim * v + math.sqrt(1 - aim * aim) * z / norm if norm > 1e-9 else v
            yield pd.DataFrame({"label": rows.label, "size": rows["size"], "unit": [v / np.linalg.norm(v) for v in x], "id": rows.twin, "copies": np.zeros(len(rows), np.int64)})

    return run


def near_duplicates(vectors: DataFrame, least: float = COSINE, shard: int = SHARD, audit: int = AUDIT, recall: float = RECALL, split: int = SPLIT) -> DataFrame:
    """vec_id, n_links, component_id, kept; see the module."""
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    # the largest component goes first, so that squares neither overflow nor vanish
    top = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & (top > 0), F.lit(False))).withColumn("top", top)
    scaled = F.transform("v", lambda x: x / F.col("top"))
    rows = rows.withColumn("v", F.when(F.col("ok"), scaled)).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    rows = saved(rows.select("vec_id", "label", "ok", F.transform("v", lambda x: x / F.col("norm")).alias("unit")))
    usable = rows.where("ok").withColumn("size", F.size("unit"))
    classes = saved(usable.groupBy("label", "size", "unit").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))

    kind = dict(classes.dtypes)["label"]
    share = F.lit(min(1.0, audit / max(1, classes.count())) * (1 << 30)).cast("long")
    chosen = classes.where(F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1 << 30)) < share)
    planted = chosen.select("label", "size", "unit", F.xxhash64("id", F.lit("planted")).alias("twin"))
    planted = saved(planted.mapInPandas(_partners(least), f"label {kind}, size int, unit array<double>, id long, copies long"))

    order = ["label", "size", "id", "copies", "unit"]
    members = saved(shards(classes.select(*order).union(planted.select(*order)), least, shard, split))
    blocks = members.groupBy(*KEY).agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks"))
    members = members.join(blocks, KEY).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    lists = members.select(*KEY, "block", "id", "unit").groupBy(*KEY, "block").applyInPandas(_build, "id long, neighbours array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))  # a list for each of its shards
    cells = members.groupBy("id").agg(F.collect_set("cell").alias("cells"))
    known = saved(united.join(cells, "id"))
    pairs = members.join(known, "id").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o", "blocks")
    found = saved(pairs.groupBy(*KEY, "i", "j").applyInPandas(_links(least), "id long, links long, other long"))

    links = saved(found.groupBy("id").agg(F.sum("links").alias("links")))
    if audit:
        _audit(classes, chosen.select(*order).union(planted.select(*order)), links, least, recall)
    linked = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    per = classes.join(links, "id", "left").join(linked, "id", "left")
    per = per.select("label", "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = usable.join(per, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("not ok").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _audit(classes: DataFrame, chosen: DataFrame, links: DataFrame, least: float, recall: float) -> float:
    """Mean recall of the chosen vectors' links (about twice AUDIT of them), by brute force over all different vectors."""
    chosen = chosen.join(links, "id", "left").select("id", "label", "size", "unit", F.coalesce("links", F.lit(0)).alias("links")).toPandas()
    groups = {k: (g.id.to_numpy(), _matrix(g.unit)) for k, g in chosen.groupby(["label", "size"])}
    shared = classes.sparkSession.sparkContext.broadcast(groups)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(["label", "size"]):
                if key in shared.value:
                    ids, x = shared.value[key]
                    near = (_matrix(part.unit) @ x.T >= least) & (part.id.to_numpy()[:, None] != ids[None])
                    yield pd.DataFrame({"id": ids, "n": part.copies.to_numpy() @ near})

    exact = classes.select("id", "label", "size", "unit", "copies").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    both = chosen.merge(exact[exact.n > 0], on="id")
    reached_ = float((np.minimum(both.links, both.n) / both.n).mean()) if len(both) else 1.0  # none: the table is empty
    if reached_ < recall:
        raise RuntimeError(f"recall {reached_:.3f} is below {recall}")
    return reached_
