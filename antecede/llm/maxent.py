"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, then one end token for each text. The model is

    P(w | history) = P(class(w) | history) * P(w | class(w), history)

Both factors are softmaxes over sums of hashed feature weights. Classes group word endings (the last three bytes, in ENDINGS
buckets) by the words they follow; the end token has one of its own. Their features: the word before (n-gram), the word before
that (skip), the two last words' endings (n-gram) and the classes of the three last words. Within a class,

    P(w | class, history) = (c(w) + 0.1) * exp(u[column(w)]) / sum of the same over all words w' of the class,

where u sums the weight rows of (class, word before), (class, word before that) and (class, the two last endings), and
column() hashes the words of a class into COLUMNS columns: the OWN most frequent words of each class have one to themselves,
the others share the rest by a hash. The sum over a class's words is exact, as words of one column have one weight: it is a
sum over columns of their counts. Unknown words take c = 0; each shared column of a class keeps room for one.

Two passes of counting and learning, both over all training texts: (1) counts c of all words and of what endings follow,
grouped on Spark; they choose classes, columns and the number of weight rows, which grows with the root of the number of
training tokens (2 ** LEAST_BITS to 2 ** MOST_BITS rows for each factor). (2) Distributed gradient updates: in each of `rounds` rounds
tasks make Adagrad steps on their part of the training texts from the common weights, and the differences are averaged,
weighted by tokens, in two levels. The rounds split the training texts by a hash of doc_id, so each is learned from once.
A task of learning takes texts of about TASK_TOKENS tokens where there are that many, and enough for LEAST_STEPS steps.

Scoring reads every whole text in numpy batches. Counts of the at most HEAD words that are most frequent in all texts, those
scored included, are broadcast; the other tokens find theirs by a join on the word, in which no word is hot.

base_score: the sum over tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))). score: log10 P(text) of the model. Null text
counts as empty: the end token alone. A very long text is one like others. Repeated rows are scored each and counted each.
Rows without doc_id are scored but not learned from. No training rows: uniform classes, c = N = V = 0. Empty table: empty
result. Other columns are not looked at.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import saved

ENDINGS, CLASSES, HEAD = 1024, 32, 1 << 17
#: Columns of a class, as many as classes, since both kinds of rows are kept in one table; own ones, shared ones.
COLUMNS, OWN = 32, 24
SHARED = COLUMNS - OWN
LEAST_BITS, MOST_BITS, TASK_TOKENS = 14, 17, 1 << 25
ROUNDS, LEAST_STEPS, PART, RATE = 2, 8, 8192, 0.5
#: The end token: the only one of ending 0 and of the last class.
END = np.uint64(1 << 20)
BLOCKS = 16

_MIX = C.stream(83, 8) | np.uint64(1)
_ONES = np.ones(CLASSES, np.float32)
_SPREAD = np.arange(CLASSES)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each followed by END, and the n + 1 offsets. The low 10 bits hold the ending's bucket."""
    starts, ends = C.spans(data, offsets)
    words, at = C.words(data, offsets)
    low = C._LOWER[data].astype(np.uint64)
    tail = np.zeros(len(words), np.uint64)
    for k in range(1, 4):
        tail += np.where(ends - k >= starts, low[np.maximum(ends - k, 0)] + np.uint64(1), np.uint64(0)) * _MIX[k] if len(words) else np.uint64(0)
    bucket = C.mix(tail) % np.uint64(ENDINGS - 1) + np.uint64(1)
    words = (words & ~np.uint64(ENDINGS - 1)) | bucket
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = C.utf8(batch.column(column))
        for lo, hi in C.chunks(offsets):
            yield batch, lo, hi, *tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _before(w: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The token k places before each, 0 before a text's first."""
    out = np.zeros(len(w), np.uint64)
    out[k:] = w[:-k] if k < len(w) else w[:0]
    for j in range(k):
        place = at[:-1] + j
        out[place[place < at[1:]]] = 0
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text and learned. Rows (what, w, c, n): what 0: word w, c times in texts learned from, n in all; what 1: an
    ending after one of 64 groups of endings, w = ending * 64 + group, c times."""
    words, counts = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    follows = np.zeros(ENDINGS * 64, np.int64)

    def merged() -> tuple[np.ndarray, np.ndarray]:
        w, n = np.concatenate([words, *(p[0] for p in parts)]), np.concatenate([counts, *(p[1] for p in parts)])
        parts.clear()
        w, back = np.unique(w, return_inverse=True)
        return w, np.stack([np.bincount(back, n[:, k], len(w)) for k in (0, 1)], 1).astype(np.int64)

    def out(what: int, w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(w), what, np.int32)), pa.array(w.astype(np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(n[:, k])) for k in (0, 1))], names=["what", "w", "c", "n"])

    for batch, lo, hi, w, at in _texts(batches, 0):
        of = np.repeat(batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
        for learned in (True, False):
            if (of == learned).any():
                some, n = np.unique(w[of == learned], return_counts=True)
                parts.append((some, np.stack([n * learned, n], 1)))
        group = C.mix(_before(w, at, 1) & np.uint64(ENDINGS - 1)) >> np.uint64(58)
        follows += np.bincount(((w & np.uint64(ENDINGS - 1)) * np.uint64(64) + group)[of].astype(np.int64), minlength=len(follows))
        if len(parts) >= 16:
            words, counts = merged()
        if len(words) > 1_000_000:
            yield out(0, words, counts)
            words, counts = words[:0], counts[:0]
    yield out(0, *merged())
    cell = np.flatnonzero(follows)
    yield out(1, cell, np.stack([follows[cell], follows[cell]], 1))


def classes(table: np.ndarray) -> np.ndarray:
    """Class of each ending: weighted k-means over what it follows; the end token's is the last."""
    n = table.sum(1)
    root = np.sqrt((table + 0.01) / (table + 0.01).sum(1, keepdims=True))
    order = np.argsort(-n, kind="stable")
    order = order[order != 0]
    centre = root[order[: CLASSES - 1]]
    for _ in range(12):
        near = (root @ centre.T).argmax(1)
        weight = np.zeros((CLASSES - 1, ENDINGS))
        weight[near, np.arange(ENDINGS)] = n + 1e-3
        weight[:, 0] = 0
        moved = weight @ root
        norm = np.linalg.norm(moved, axis=1, keepdims=True)
        centre = np.where(norm > 0, moved / np.maximum(norm, 1e-12), centre)
    near = (root @ centre.T).argmax(1)
    near[0] = CLASSES - 1
    return near.astype(np.uint8)


class Model:
    """kinds: class of each ending; own, place: words with a column to themselves, sorted, and their columns; mass: the sums of
    c + 0.1 by class and column; weights: rows of the classes' features, then as many of the columns' features. The first row of
    the first half is the classes' bias; the first CLASSES rows of the second are the columns' biases by class."""

    def __init__(self, kinds: np.ndarray, own: np.ndarray, place: np.ndarray, mass: np.ndarray, bits: int):
        self.kinds, self.own, self.place = kinds, own, place
        self.log_mass = np.log(mass.sum(1))
        self.share = (mass / mass.sum(1, keepdims=True)).astype(np.float32)
        self.rows = 1 << bits
        self.weights = np.zeros((2 * self.rows, CLASSES), np.float32)

    def moved_to(self, weights: np.ndarray) -> Model:
        other = copy.copy(self)
        other.weights = weights
        return other

    def column(self, w: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, w), max(len(self.own) - 1, 0))
        shared = OWN + ((w >> np.uint64(10)) & np.uint64(SHARED - 1)).astype(np.int64)
        return np.where(self.own[at] == w, self.place[at], shared) if len(self.own) else shared

    def features(self, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Class and column of each token, its rows for the class and its rows for the column."""
        one, two, three = (_before(w, at, k) for k in (1, 2, 3))
        mask = np.uint64(ENDINGS - 1)
        class_of = lambda x: np.where(x == 0, np.uint64(CLASSES), self.kinds[(x & mask).astype(np.int64)].astype(np.uint64))
        kind = class_of(w)
        endings = (one & mask) * np.uint64(ENDINGS) + (two & mask)
        outer = (one * _MIX[0], two * _MIX[1], endings * _MIX[2] + np.uint64(1), ((class_of(one) * np.uint64(64) + class_of(two)) * np.uint64(64) + class_of(three)) * _MIX[3] + np.uint64(2))
        inner = (one * _MIX[4] + kind, two * _MIX[5] + kind, endings * _MIX[6] + kind)
        hashed = lambda x, first: (C.mix(x) % np.uint64(self.rows - first)).astype(np.int64) + first
        kind = kind.astype(np.int64)
        return kind, self.column(w), [hashed(x, 1) for x in outer], [self.rows + hashed(x, CLASSES) for x in inner] + [self.rows + kind]

    def sums(self, rows: list[np.ndarray]) -> np.ndarray:
        z = self.weights.take(rows[0], 0)
        for r in rows[1:]:
            z += self.weights.take(r, 0)
        return z

    def class_sums(self, outer: list[np.ndarray]) -> np.ndarray:
        return np.clip(self.sums(outer) + self.weights[0], -60, 60)

    def column_sums(self, inner: list[np.ndarray]) -> np.ndarray:
        return np.clip(self.sums(inner), -60, 60)

    def log_p(self, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log of P(w | history) / (c + 0.1) of each token."""
        kind, column, outer, inner = self.features(w, at)
        out = np.zeros(len(w))
        for lo in range(0, len(w), PART):
            cut = slice(lo, lo + PART)
            k, s = kind[cut], column[cut]
            row = np.arange(len(k))
            z, u = self.class_sums([r[cut] for r in outer]), self.column_sums([r[cut] for r in inner])
            total = (np.exp(u) * self.share.take(k, 0)) @ _ONES
            out[cut] = z[row, k] - np.log(np.exp(z) @ _ONES) + u[row, s] - np.log(total) - self.log_mass[k]
        return out


class Learner:
    """Adagrad steps from a model's weights, one after about as many tokens as a factor has rows, so that steps over all rows
    cost the same for each token in a table of any size."""

    def __init__(self, model: Model):
        self.model = model
        self.gradient = np.zeros_like(model.weights)
        self.squares = np.ones(len(model.weights), np.float32)
        self.waiting = self.seen = 0

    def _add(self, rows: list[np.ndarray], gradient: np.ndarray) -> None:
        flat, values = self.gradient.reshape(-1), gradient.reshape(-1)
        for r in rows:
            np.add.at(flat, (r[:, None] * CLASSES + _SPREAD).reshape(-1), values)

    def learn(self, w: np.ndarray, at: np.ndarray) -> None:
        model = self.model
        kind, column, outer, inner = model.features(w, at)
        for lo in range(0, len(w), PART):
            cut = slice(lo, lo + PART)
            k, s = kind[cut], column[cut]
            row = np.arange(len(k))
            o, i = [r[cut] for r in outer], [r[cut] for r in inner]
            p = np.exp(model.class_sums(o))
            p /= (p @ _ONES)[:, None]
            p[row, k] -= 1
            self._add(o, p)
            self.gradient[0] += p.sum(0)
            q = np.exp(model.column_sums(i)) * model.share.take(k, 0)
            q /= (q @ _ONES)[:, None]
            q[row, s] -= 1
            self._add(i, q)
            self.waiting += len(k)
            if self.waiting >= model.rows:
                self.step()
        self.seen += len(w)

    def step(self) -> None:
        self.squares += (self.gradient**2) @ (_ONES / CLASSES)
        self.model.weights -= (RATE / 4) * self.gradient / np.sqrt(self.squares)[:, None]
        self.gradient[:] = 0
        self.waiting = 0


def _row(block: int, group: int, n: int, moved: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([block], pa.int32()), pa.array([group], pa.int32()), pa.array([n], pa.int64()), pa.array([moved.astype(np.float32).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "group", "n", "moved"])


def _update(shared, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        learner = Learner(shared.value.moved_to(shared.value.weights.copy()))
        for _, _, _, w, at in _texts(batches, 0):
            learner.learn(w, at)
        if learner.seen:
            learner.step()
            group = TaskContext.get().partitionId() % groups
            for b, (old, new) in enumerate(zip(*(m.weights.reshape(BLOCKS, -1) for m in (shared.value, learner.model)), strict=True)):
                yield _row(b, group, learner.seen, (new - old) * np.float32(learner.seen))

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each (block, group), which come one after the other; one row in memory beside the sum."""
    key, total, n = None, None, 0
    for batch in batches:
        for b, g, m, moved in zip(*(batch.column(k) for k in range(4)), strict=True):
            if (b.as_py(), g.as_py()) != key:
                if key is not None:
                    yield _row(*key, n, total)
                key, total, n = (b.as_py(), g.as_py()), 0.0, 0
            total = total + np.frombuffer(moved.as_buffer(), np.float32).astype(np.float64)
            n += m.as_py()
    if key is not None:
        yield _row(*key, n, total)


def _summed(moved: DataFrame, partitions: int) -> DataFrame:
    return moved.repartition(partitions, "block", "group").sortWithinPartitions("block", "group").mapInArrow(_add_up, "block int, group int, n long, moved binary")


def counted(docs: DataFrame) -> DataFrame:
    """docs: text, learned. The table of _count(), summed."""
    return saved(docs.mapInArrow(_count, "what int, w long, c long, n long").groupBy("what", "w").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))


def _head_bar(words: DataFrame) -> int:
    """The least count above which at most HEAD words lie."""
    bucket = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["b"], r["m"], r["k"]) for r in words.groupBy(bucket.alias("b")).agg(F.max("n").alias("m"), F.count("*").alias("k")).collect()), reverse=True)  # 8 rows for each power of two
    held = 0
    for _, most, k in sizes:
        held += k
        if held > HEAD:
            return most
    return 0


def prepared(table: DataFrame, head: pd.DataFrame, total: int) -> Model:
    """The untrained model of the counted words."""
    kinds = np.r_[CLASSES - 1, np.arange(1, ENDINGS) % (CLASSES - 1)].astype(np.uint8)
    mass = np.zeros((CLASSES, COLUMNS))
    mass[:, OWN:] = 0.1
    words = table.where("what = 0 and c > 0")
    if total:
        follows = np.zeros(ENDINGS * 64)
        for r in table.where("what = 1").select("w", "c").collect():  # ENDINGS * 64 rows at most
            follows[r["w"]] = r["c"]
        kinds = classes(follows.reshape(ENDINGS, 64))
    low = F.col("w").bitwiseAND(F.lit(ENDINGS * SHARED - 1).cast("long"))
    for r in words.groupBy(low.alias("e")).agg((F.sum("c") + 0.1 * F.count("*")).alias("m")).collect():  # ENDINGS * SHARED rows at most
        mass[kinds[r["e"] % ENDINGS], OWN + r["e"] // ENDINGS] += float(r["m"])
    head = head[head.c > 0]
    w, c = head.w.to_numpy(np.int64).view(np.uint64), head.c.to_numpy(float)
    kind = kinds[(w & np.uint64(ENDINGS - 1)).astype(np.int64)].astype(np.int64)
    order = np.lexsort((w, -c, kind))
    w, c, kind = w[order], c[order], kind[order]
    nth = np.arange(len(w)) - np.searchsorted(kind, kind)
    w, c, kind, nth = (x[nth < OWN] for x in (w, c, kind, nth))
    np.add.at(mass, (kind, OWN + ((w >> np.uint64(10)) & np.uint64(SHARED - 1)).astype(np.int64)), -(c + 0.1))
    mass[kind, nth] = c + 0.1
    by_word = np.argsort(w)
    bits = min(MOST_BITS, max(LEAST_BITS, round(np.log2(max(total, 1)) / 2) + 2))
    return Model(kinds, w[by_word], nth[by_word], np.maximum(mass, 0), bits)


def train(docs: DataFrame, model: Model, total: int, rounds: int = ROUNDS) -> Model:
    """The weights, learned from all documents (doc_id, text), each in one of the rounds."""
    spark = docs.sparkSession
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    few = min(2 * spark.sparkContext.defaultParallelism, total // rounds // (LEAST_STEPS * model.rows))
    tasks = max(1, few, -(-total // TASK_TOKENS // rounds))
    groups = max(1, round(tasks**0.5))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        part = docs.where("doc_id is not null").where(turn == k).select(F.col("text").cast("string"))
        moved = part.coalesce(tasks).mapInArrow(_update(shared, groups), "block int, group int, n long, moved binary")
        moved = _summed(moved, groups * BLOCKS).withColumn("group", F.lit(0))
        weights = model.weights.reshape(BLOCKS, -1).copy()
        for b, _, n, x in _summed(moved, BLOCKS).collect():  # BLOCKS rows, together as large as the weights
            weights[b] += np.frombuffer(x, np.float32) / n
        model = model.moved_to(weights.reshape(model.weights.shape))
    return model


def score(docs: DataFrame, training: Column | DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score; learns from training, which is a table or a
    condition on docs (and then read with them)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    if isinstance(training, Column):
        both, training = docs.select(text, F.coalesce(training & F.col("doc_id").isNotNull(), F.lit(False)).alias("learned")), docs.where(training)
    else:
        both = docs.select(text, F.lit(False).alias("learned")).union(training.where("doc_id is not null").select(text, F.lit(True)))
    table = counted(both)
    words = table.where("what = 0")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = sums["c"], sums["v"]
    bar = _head_bar(words)
    head = words.where(F.col("n") > bar).select("w", "c").toPandas().sort_values("w", key=lambda s: s.to_numpy().view(np.uint64))  # HEAD rows at most
    model = prepared(table, head, total)
    if total:
        model = train(training, model, total, rounds)
    parts = spark.sparkContext.broadcast((model, head.w.to_numpy(np.int64).view(np.uint64), head.c.to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, count = parts.value
        log_count = np.log10(count + 0.1)
        for batch, lo, hi, w, at in _texts(batches, 2):
            place = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
            inside = words[place] == w if len(words) else np.zeros(len(w), bool)
            known = inside & (count[place] > 0) if len(words) else inside
            weight = np.where(inside, log_count[place], 0.0) if len(words) else np.zeros(len(w))
            add = lambda x: np.diff(np.r_[0, np.cumsum(x, dtype=np.float64)][at])
            ends = np.r_[0, np.cumsum(~inside)][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                + [pa.array(np.diff(at)), pa.array(add(known).astype(np.int64)), pa.array(add(weight)), pa.array(add(model.log_p(w, at)) / np.log(10))]
                + [pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(w[~inside].view(np.int64))).cast(pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_tokens", "known", "weight", "logp", "tail"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text)
    rows = saved(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, weight double, logp double, tail array<long>"))
    rare = rows.select("row", F.explode("tail").alias("w")).join(words.where((F.col("c") > 0) & (F.col("n") <= bar)).select("w", "c"), "w")
    rare = rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 0.1)).alias("extra"))
    out = rows.withColumn("size", F.size("tail")).drop("tail").join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0))
    weight = F.col("weight") + F.coalesce("extra", F.lit(0.0)) - (F.col("size") - more)  # log10(0.1) for each unknown word
    all_ = float(np.log10(total + 0.1 * (distinct + 1)))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (weight - F.col("n_tokens") * all_).alias("base_score"),
        (weight + F.col("logp")).alias("score"),
    )
