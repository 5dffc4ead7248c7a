"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Texts are lower-cased; everything but letters becomes one space. Each language has a model of order ORDER: absolute
discounts estimated per order as n1 / (n1 + 2 n2), continuation counts below the highest order, and a uniform base over the
letters seen. All languages share one sorted array of 64-bit n-gram hashes per order, with a column of log probabilities
for each language, so that one binary search serves them all; contexts' back-off weights are stored in the same way. The
language of least length-normalised cross-entropy wins.

Bounds: the n-gram counts come from about `per_language` labelled documents of each language and the calibration from about
`calibration` others, chosen by a hash of doc_id, never the same: where a language has fewer, a fifth at most calibrates
and the rest is counted. Every text is scored whole.

Rejection: a text is rejected if its cross-entropy under the winner exceeds the 99.5 % quantile of the calibration texts
(at least 20 letters) by more than REJECT_NATS. score is the posterior of the winner, with a temperature fitted to the
calibration texts. Null text or text without a letter: `und`, score 0, rejected. No labelled rows: everything is `und`.
A very long text is one like others. Repeated rows are scored each; rows without doc_id are scored and never learned from. Empty table: empty result. Only the
columns doc_id, text and, for learning, lang are looked at.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER = 4
PER_LANGUAGE, CALIBRATION = 1500, 400
REJECT_NATS = 1.0
UNKNOWN = "und"

_STEP = C.stream(53, 8) | np.uint64(1)
#: 1 for the code points below 0x3000 that are letters.
_LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x3000)])


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, other than letters as single spaces, each text between two spaces; and the n + 1 offsets.
    A text without letters has none at all."""
    parts = [np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    at = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    cp = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    letter = np.zeros(len(cp), bool)
    low = cp < 0x3000
    letter[low] = _LETTER[cp[low]]
    if not low.all():
        high = np.flatnonzero(~low)
        kinds, back = np.unique(cp[high], return_inverse=True)
        letter[high] = np.array([unicodedata.category(chr(int(c)))[0] == "L" for c in kinds])[back]
    keep = letter.copy()
    keep[1:] |= ~letter[1:] & letter[:-1]  # a space after a letter
    if len(at) > 1:
        count = np.r_[0, np.cumsum(letter)]
        lettered = count[at[1:]] > count[at[:-1]]
        keep[at[:-1]] = lettered  # and the first of each text
    out = np.where(letter, cp, np.uint32(32))[keep]
    return out, np.r_[0, np.cumsum(keep)][at]


def _windows(cp: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each position from n - 1 on."""
    size = max(0, len(cp) - n + 1)
    h = np.zeros(size, np.uint64)
    wide = cp.astype(np.uint64)
    for k in range(n):
        h += wide[k : k + size] * _STEP[k]
    return C.mix(h + np.uint64(n))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        counts: dict[tuple[str, str], int] = {}
        for lang in sorted(set(langs)):
            cp, at = symbols([t.as_py() for t, x in zip(texts, langs, strict=True) if x == lang])
            h = _windows(cp, ORDER)
            ok = np.ones(len(h), bool)
            for a in at[1:-1]:  # no n-gram over the border of two texts
                ok[max(0, a - ORDER + 1) : a] = False
            where = np.flatnonzero(ok)
            _, first, n = np.unique(h[where], return_index=True, return_counts=True)
            grams = cp[where[first][:, None] + np.arange(ORDER)].astype("<u4").tobytes().decode("utf-32-le")
            for k, c in enumerate(n.tolist()):
                counts[lang, grams[k * ORDER : k * ORDER + ORDER]] = c
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "gram", "n"],
        )


class Model:
    """langs; for each order the sorted hashes and log probabilities of its n-grams, and those of its contexts' weights."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts.lang.unique())
        column = {x: k for k, x in enumerate(self.langs)}
        if not self.langs:
            return
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.limit = np.full(len(self.langs), np.inf)
        self.kappa = 20.0
        tables = {}
        table = counts
        for order in range(ORDER, 0, -1):
            tables[order] = table
            lower = table.assign(gram=table.gram.str[1:])
            table = lower.groupby(["lang", "gram"], as_index=False).n.size().rename(columns={"size": "n"})
        letters = max(2, tables[1].gram.nunique() + 1)
        self.base = np.full(len(self.langs), -np.log(letters))
        below = None
        for order in range(1, ORDER + 1):
            t = tables[order].copy()
            t["context"] = t.gram.str[:-1]
            ones, twos = ((t.n == k).groupby(t.lang).sum() for k in (1, 2))
            discount = ((ones + 0.5) / (ones + 2 * twos + 1)).to_dict()
            ctx = t.groupby(["lang", "context"], as_index=False).agg(total=("n", "sum"), kinds=("n", "size"))
            ctx["weight"] = ctx.lang.map(discount) * ctx.kinds / ctx.total
            t = t.merge(ctx[["lang", "context", "total", "weight"]], on=["lang", "context"])
            t["seen"] = (t.n - t.lang.map(discount)).clip(lower=0) / t.total
            names = sorted(t.gram.unique())
            prob = np.zeros((len(names), len(self.langs)))
            place = {g: k for k, g in enumerate(names)}
            row, col = t.gram.map(place).to_numpy(), t.lang.map(column).to_numpy()
            contexts = sorted(ctx.context.unique())
            cplace = {g: k for k, g in enumerate(contexts)}
            gamma = np.ones((len(contexts), len(self.langs)))
            gamma[ctx.context.map(cplace), ctx.lang.map(column)] = ctx.weight
            prob[row, col] = t.seen
            lower = np.exp(self.base)[None].repeat(len(names), 0) if order == 1 else np.exp(below(names))
            prob += gamma[[cplace[g[:-1]] for g in names]] * lower
            self.grams.append(self._sorted(names, np.log(prob)))
            self.contexts.append(self._sorted(contexts, np.log(gamma)))
            below = lambda names, order=order: self._logp(np.array([[ord(c) for c in g[1:]] for g in names], np.uint32), order)

    @staticmethod
    def _sorted(names: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(names[0]) if names else 0
        h = Model._hash(np.array([[ord(c) for c in g] for g in names], np.uint32).reshape(len(names), size))
        order = np.argsort(h)
        return h[order], values[order].astype(np.float32)

    @staticmethod
    def _hash(grams: np.ndarray) -> np.ndarray:
        h = np.zeros(len(grams), np.uint64)
        for k in range(grams.shape[1]):
            h += grams[:, k].astype(np.uint64) * _STEP[k]
        return C.mix(h + np.uint64(grams.shape[1]))

    def _logp(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of the last symbol of each n-gram, a column for each language."""
        return self._lookup(self._hash(grams), lambda rows, k: grams[rows, grams.shape[1] - k :], order)

    def _lookup(self, h: np.ndarray, tail, order: int) -> np.ndarray:
        keys, values = self.grams[order - 1]
        place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out = values[place]
        missing = np.flatnonzero(keys[place] != h)
        if len(missing):
            grams = tail(missing, order)
            if order == 1:
                lower = np.broadcast_to(self.base, (len(missing), len(self.langs)))
            else:
                lower = self._logp(np.ascontiguousarray(grams[:, 1:]), order - 1)
            ckeys, cvalues = self.contexts[order - 1]
            ch = self._hash(grams[:, :-1])
            cplace = np.minimum(np.searchsorted(ckeys, ch), len(ckeys) - 1)
            out[missing] = lower + np.where((ckeys[cplace] == ch)[:, None], cvalues[cplace], 0)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (nats) of each text under each language, and the number of symbols scored."""
        cp, at = symbols(texts)
        # each text's first space becomes ORDER - 1 of them, so that no n-gram looks back into another text
        size = np.diff(at)
        place = np.arange(len(cp)) + np.repeat(np.cumsum(size > 0), size) * (ORDER - 2)
        padded = np.full(len(cp) + int((size > 0).sum()) * (ORDER - 2) + 1, 32, np.uint32)
        padded[place] = cp
        total = np.zeros((len(texts), len(self.langs)))
        n = np.maximum(np.diff(at) - 1, 0)
        if len(cp):
            first = np.maximum(place - (ORDER - 1), 0)
            h = _windows(padded, ORDER)[first]
            logp = self._lookup(h, lambda rows, k: padded[first[rows][:, None] + np.arange(ORDER)], ORDER)
            logp[at[:-1][size > 0]] = 0  # the first space is given
            sums = np.zeros((len(cp) + 1, len(self.langs)))
            np.cumsum(logp, axis=0, dtype=np.float64, out=sums[1:])
            total = sums[at[1:]] - sums[at[:-1]]
        return -total / np.maximum(n, 1)[:, None], n

    def calibrate(self, entropy: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        long_ = n >= 20
        for k in range(len(self.langs)):
            own = entropy[long_ & (truth == k), k]
            if len(own):
                self.limit[k] = np.quantile(own, 0.995) + REJECT_NATS
        if len(truth):
            gap = entropy - entropy.min(1, keepdims=True)
            grid = np.geomspace(1, 200, 40)
            loss = [np.mean(k * gap[np.arange(len(truth)), truth] + np.log(np.exp(-k * gap).sum(1))) for k in grid]
            self.kappa = float(grid[int(np.argmin(loss))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        entropy, n = self.entropies(texts)
        best = entropy.argmin(1)
        least = entropy.min(1)
        score = 1 / np.exp(-self.kappa * (entropy - least[:, None])).sum(1)
        none = n == 0
        rejected = none | ((n >= 20) & (least > self.limit[best]))
        lang = [UNKNOWN if x else self.langs[k] for x, k in zip(none, best, strict=True)]
        return lang, np.where(none, 0.0, np.clip(score, 0, 1)), np.where(none, np.nan, least), rejected


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, calibration: int = CALIBRATION) -> Model:
    """Learns from text and lang of the rows given."""
    docs = docs.where("lang is not null and doc_id is not null").select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return Model(pd.DataFrame({"lang": pd.Series(dtype=str), "gram": pd.Series(dtype=str), "n": pd.Series(dtype=int)}))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = lambda n: F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, n / k))) for x, k in sizes.items()])
    held = F.least(share(calibration), F.lit(0.2))
    counted = F.least(share(per_language), 1 - held)
    counts = docs.where(draw < counted).select("lang", "text").mapInArrow(_count, "lang string, gram string, n long")
    model = Model(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    near = docs.where(draw >= 1 - held).select("lang", "text")
    kinds = {x: k for k, x in enumerate(model.langs)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, n = model.entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([kinds.get(x) for x in batch.column(0).to_pylist()], pa.int32()), pa.array(n, pa.int64()), pa.array(list(entropy), pa.list_(pa.float64()))],
                names=["truth", "n", "entropy"],
            )

    rows = near.mapInArrow(measure, "truth int, n long, entropy array<double>").where("n > 0 and truth is not null").toPandas()
    if len(rows):
        model.calibrate(np.stack(rows.entropy.to_list()), rows.n.to_numpy(), rows.truth.to_numpy())
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score, cross_entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = C.utf8(batch.column(1))
            for lo, hi in C.chunks(offsets):
                lang, score, entropy, rejected = shared.value.predict(batch.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, from_pandas=True), pa.array(rejected)],
                    names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    )


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is identified and not rejected, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = C.utf8(batch.column(place))
            for lo, hi in C.chunks(offsets):
                part = batch.slice(lo, hi - lo)
                rejected = shared.value.predict(part.column(place).to_pylist())[3]
                yield part.filter(pa.array(~rejected))

    return C.numbered(docs).mapInArrow(run, docs.schema)
