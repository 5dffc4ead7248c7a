"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's probability is a logistic function of its distinct hashed words and their stems (first four bytes, as compounds
and endings vary); a document's is the noisy-or of its
sentences, 1 - prod(1 - p). The weights are fitted to document labels alone, by gradient steps on the noisy-or likelihood,
over at most `max_positive` and `max_negative` labelled documents (those of the least hash of their id; a documented bound,
all of them where there are fewer). Which words and stems are features is decided before, by counts over this sample,
grouped on Spark; only these features of it, as numbers, go to the driver. Every whole text is
then scored, and the sentences of high probability are located as spans of characters. A final logistic map of the
document's log-odds is fitted so that the probability is calibrated and `threshold` separates the labels best, on log-odds
that each document gets from weights fitted without it (FOLDS folds), its class weighted as in all labelled documents.

A sentence ends after . ! ? or a line break; words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, without ASCII
punctuation at their ends. Null or empty text, or one without words: the prior, as of a sentence without known words.
Repeated rows are scored each; a label that contradicts another of the same doc_id counts as toxic. Rows without doc_id are
scored. A very long text is one like others. No labelled rows: score 0. Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import saved

BITS, STEM = 18, 4
THRESHOLD = 0.3
MAX_POSITIVE, MAX_NEGATIVE = 2000, 4000
EPOCHS, FOLDS = 60, 3
#: A feature is used if it is in so many documents of the sample and its rates in the two classes differ by so many standard errors.
MIN_DOCS, MIN_Z = 3, 4.0

_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and stems as bucket numbers, the sentence of each, the text of each sentence, and the first byte of each sentence."""
    starts, ends = C.spans(data, offsets)
    # the edges of a word: punctuation on the left, then on the right; words of punctuation alone vanish
    raw_starts, raw_ends = starts, ends
    if len(starts):
        edge, place = _EDGE[data], np.arange(len(data))
        after = np.minimum.accumulate(np.where(edge, len(data), place)[::-1])[::-1]
        before = np.maximum.accumulate(np.where(edge, -1, place))
        starts = np.minimum(after[starts], ends)
        ends = np.maximum(before[ends - 1] + 1, starts)
    power, inverse = C._power_tables(max(len(data), 1))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(C._BYTE[C._LOWER[data]] * power[: len(data)], out=total[1:])
    base = inverse[np.minimum(starts, len(inverse) - 1)]
    word, stem = ((total[to] - total[starts]) * base for to in (ends, np.minimum(starts + STEM, ends)))
    bucket = (C.mix(np.concatenate([word, stem])) >> np.uint64(64 - BITS)).astype(np.int64)
    text = np.searchsorted(offsets, raw_starts, "right") - 1
    last = _END[data[raw_ends - 1]] if len(data) else np.zeros(0, bool)
    broken = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=broken[1:])
    new = np.ones(len(starts), bool)
    if len(starts):
        new[1:] = last[:-1] | (text[1:] != text[:-1]) | (broken[raw_starts[1:]] != broken[raw_starts[:-1]])
    sentence = np.cumsum(new) - 1
    keep = np.tile(ends > starts, 2)
    return bucket[keep], np.tile(sentence, 2)[keep], text[new], raw_starts[new]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns toxic and text: in how many documents of each label a bucket is, summed over the task."""
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        data, offsets = C.utf8(batch.column(1))
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in C.chunks(offsets):
            bucket, sentence, text, _ = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            held = np.unique((text[sentence] << BITS) | bucket) if len(bucket) else bucket
            for label in (0, 1):
                total[label] += np.bincount(held[toxic[lo:hi][held >> BITS] == label] & ((1 << BITS) - 1), minlength=1 << BITS)
    held = np.flatnonzero(total.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(held), *(pa.array(total[label][held]) for label in (0, 1))], names=["bucket", "clean", "toxic"])


def telling(counts: DataFrame, clean: int, toxic: int) -> np.ndarray:
    """The buckets whose rates of documents in the two classes differ by MIN_Z standard errors: few, 2 ** BITS at most."""
    n0, n1 = float(max(clean, 1)), float(max(toxic, 1))
    rate = (F.col("clean") + F.col("toxic")) / F.lit(float(max(clean + toxic, 1)))
    error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    rows = counts.where((F.col("clean") + F.col("toxic") >= MIN_DOCS) & (F.abs(F.col("toxic") / n1 - F.col("clean") / n0) >= MIN_Z * error))
    return np.sort(np.array([r["bucket"] for r in rows.select("bucket").collect()], np.int64))


def _gather(chosen: np.ndarray):
    """Columns toxic, fold, text: those, the number of sentences, and (sentence, bucket) of the chosen buckets, distinct."""
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.utf8(batch.column(2))
            for lo, hi in C.chunks(offsets):
                bucket, sentence, text, _ = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                many = np.bincount(text, minlength=hi - lo)
                use = wanted[bucket]
                pairs = np.unique((sentence[use] << BITS) | bucket[use])
                owner = text[pairs >> BITS] if len(pairs) else pairs
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                pairs = pairs - (np.r_[0, np.cumsum(many)][owner] << BITS)  # sentences numbered from each document's first
                lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(pairs, pa.int64())).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), pa.array(many, pa.int64()), lists], names=["toxic", "fold", "sentences", "pairs"])

    return run


class Model:
    """weights by bucket, bias of a sentence, and the map of a document's log-odds."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def sentences(self, bucket: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of each sentence. A word counts once: words repeated in a sentence weigh no more."""
        pairs = np.unique((sentence << BITS) | bucket)
        return np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], n) + self.bias

    def documents(self, logit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        clean = -np.logaddexp(0, logit)  # log(1 - p)
        total = np.bincount(text, clean, n)
        total = np.where(np.bincount(text, minlength=n) == 0, -np.logaddexp(0, self.bias), total)
        odds = np.log(-np.expm1(total)) - total
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.shift, -40, 40)))


class Bags:
    """Documents as bags of sentences: labels, folds, sentences of each and (sentence, bucket) lists, over the chosen buckets."""

    def __init__(self, labels: np.ndarray, fold: np.ndarray, sentences: np.ndarray, pairs: list[np.ndarray], chosen: np.ndarray):
        self.y, self.fold, self.chosen = labels.astype(float), fold, chosen
        docs = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        flat = np.concatenate(pairs) if len(docs) else np.zeros(0, np.int64)
        self.row = np.r_[0, np.cumsum(sentences)][docs] + (flat >> BITS)
        self.column = np.searchsorted(chosen, flat & ((1 << BITS) - 1))
        self.document = np.repeat(np.arange(len(sentences)), sentences)

    def clean(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each sentence and log(1 - p) of each document."""
        logit = np.bincount(self.row, w[self.column], len(self.document)) + bias
        total = np.bincount(self.document, -np.logaddexp(0, logit), len(self.y))
        return logit, np.where(np.bincount(self.document, minlength=len(self.y)) == 0, -np.logaddexp(0, bias), total)

    def loss(self, w: np.ndarray, bias: float, share: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative noisy-or log-likelihood, documents weighted by share, and its gradient by w and bias."""
        logit, clean = self.clean(w, bias)
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        toxic = np.maximum(-np.expm1(clean), 1e-6)
        outer = share * np.where(self.y > 0, np.exp(clean) / toxic, -1.0)  # by log(1 - p of the document)
        inner = outer[self.document] * -p
        empty = np.bincount(self.document, minlength=len(self.y)) == 0
        alone = (outer[empty] * -1 / (1 + np.exp(-bias))).sum()
        value = -(share * np.where(self.y > 0, np.log(toxic), clean)).sum()
        return value, np.r_[np.bincount(self.column, inner[self.row], len(w)), inner.sum() + alone]

    def fit(self, inside: np.ndarray) -> tuple[np.ndarray, float]:
        """Adam on the likelihood of the documents inside, classes weighted alike, with an L2 penalty."""
        y = self.y
        share = inside * np.where(y > 0, 0.5 / max((y * inside).sum(), 1), 0.5 / max(((1 - y) * inside).sum(), 1)) * inside.sum()
        w, bias = np.zeros(len(self.chosen)), -4.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for epoch in range(1, EPOCHS + 1):
            grad = self.loss(w, bias, share)[1]
            grad[:-1] += 0.05 * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = 0.3 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
            w, bias = w - step[:-1], bias - step[-1]
        return w, float(bias)

    def odds(self, w: np.ndarray, bias: float) -> np.ndarray:
        clean = self.clean(w, bias)[1]
        return np.log(np.maximum(-np.expm1(clean), 1e-300)) - clean


def fit(bags: Bags, clean: int, toxic: int, threshold: float = THRESHOLD) -> Model:
    """The model of the documents; clean and toxic: how many there are of each label in all."""
    y = bags.y
    odds = np.zeros(len(y))
    for k in range(FOLDS):
        if (bags.fold == k).any():
            odds[bags.fold == k] = bags.odds(*bags.fit(bags.fold != k))[bags.fold == k]
    w, bias = bags.fit(np.ones(len(y), bool))
    weights = np.zeros(1 << BITS, np.float32)
    weights[bags.chosen] = w
    share = np.where(y > 0, toxic / max(y.sum(), 1), clean / max((1 - y).sum(), 1))
    return Model(weights, bias, *_calibrate(odds, y, share, threshold))


def _calibrate(odds: np.ndarray, y: np.ndarray, share: np.ndarray, threshold: float) -> tuple[float, float]:
    """Slope by likelihood; shift such that the threshold falls on the cut of best F1, between its neighbours."""
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum((y * share)[order])
    f1 = 2 * hits / (np.cumsum(share[order]) + max((y * share).sum(), 1e-9))
    best = int(np.flatnonzero(f1 == f1.max()).mean()) if len(f1) else 0
    nxt = order[min(best + 1, len(order) - 1)]
    cut = (odds[order[best]] + odds[nxt]) / 2
    z = np.clip(odds - cut, -60, 60)
    slopes = np.geomspace(0.02, 3, 30)
    base = np.log(threshold / (1 - threshold))
    loss = [np.average(np.logaddexp(0, s * z + base) - y * (s * z + base), weights=share) for s in slopes]
    s = float(slopes[int(np.argmin(loss))])
    return s, float(base - s * cut)


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            for lo, hi in C.chunks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                bucket, sentence, text, first = features(part, at)
                logit = model.sentences(bucket, sentence, len(text))
                score = model.documents(logit, text, hi - lo)
                bad = np.flatnonzero(logit > 0)
                spans = [[] for _ in range(hi - lo)]
                for k in bad:
                    i = text[k]
                    stop = first[k + 1] if k + 1 < len(text) and text[k + 1] == i else at[i + 1]
                    lead = len(part[at[i] : first[k]].tobytes().decode("utf-8", "replace"))
                    spans[i].append((lead, lead + len(part[first[k] : stop].tobytes().decode("utf-8", "replace").rstrip())))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(score),
                        pa.array((score >= threshold).astype(np.int32)),
                        pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    ],
                    names=["doc_id", "score", "predicted", "sentences"],
                )

    return run


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, threshold: float = THRESHOLD) -> Model:
    """Chooses features by and fits to at most max_positive and max_negative of the labelled documents, by the least hash of doc_id."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = saved(marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if not sizes:
        return Model(np.zeros(1 << BITS, np.float32), -40.0, 1.0, 0.0)
    sample = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, max_positive), (0, max_negative))]
    sample = saved(sample[0].union(sample[1]))  # at most max_positive + max_negative rows
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    few = saved(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("toxic", fold.alias("fold"), "text"))
    counts = few.select("toxic", "text").mapInArrow(_seen, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    part = {r["toxic"]: r["n"] for r in few.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = telling(counts, part.get(0, 0), part.get(1, 0))
    rows = few.mapInArrow(_gather(chosen), "toxic int, fold int, sentences long, pairs array<bigint>").toArrow()
    column = lambda name: rows.column(name).to_numpy()
    bags = Bags(column("toxic"), column("fold"), column("sentences"), [np.asarray(x.values) for x in rows.column("pairs")], chosen)
    return fit(bags, sizes.get(0, 0), sizes.get(1, 0), threshold)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, score, predicted, sentences (spans of characters whose probability exceeds one half)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _score(model, threshold), "doc_id long, score double, predicted int, sentences array<struct<start:long,stop:long>>"
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, as they are."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.utf8(batch.column(place))
            for lo, hi in C.chunks(offsets):
                bucket, sentence, text, _ = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                score = model.documents(model.sentences(bucket, sentence, len(text)), text, hi - lo)
                yield batch.slice(lo, hi - lo).filter(pa.array(score < threshold))

    return C.numbered(docs).mapInArrow(run, docs.schema)


def held_out(modulus: int, remainder: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder
