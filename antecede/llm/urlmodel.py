"""URL filter: rules by host and path, and for the rest a ratio of two character models.

Rules decide first: a rule (host, path prefix) fits a URL whose host is the rule's or a subdomain of it and whose path
starts with the rule's; the longest wins. What the rules decide also teaches the method: two variable-order Markov models
of characters, one of the accepted and one of the rejected URLs. A context is kept while it was seen at least MIN_CONTEXT
times, up to ORDER characters; probabilities are interpolated from order to order with Witten-Bell weights. A URL is blocked
if log P(rejected) - log P(accepted), divided by its length, exceeds a cut calibrated on URLs that the counts leave out, so
that both kinds are wrong equally often (0 at least).

All URLs that a rule decides teach, none is left out: one of FOLDS parts, by a hash of the url so that equal URLs are on one
side, calibrates as a whole and all the rest is counted. If that leaves a kind without counts, everything is counted and the cut
is 0. Counts stay a table on Spark, however many there are: URLs are scored in parts of about PART_BYTES, each of which
meets the contexts that occur in it, and the cut is found by counts over ranges of scores. The driver receives sums and
at most BINS + 1 ranges at a time. All URLs are scored whole; only their letters' case is lowered, and digits count as one symbol.

Null URL, or one without `://`: host and path empty, no rule; the method scores the whole string, null as empty. An empty
string scores 0 and is allowed. No rule fits any URL, or only rules of one kind: the method allows. Repeated rows are judged
each. Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER, MIN_CONTEXT = 5, 2
FOLDS = 5
PART_BYTES = 1 << 18
BINS = 4096

_STEP = C.stream(61, 16) | np.uint64(1)
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, decision (allow, block or null). Built-in expressions alone."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    out = pages.select("page_id", "url", rest.alias("rest"))
    out = out.withColumn("host", F.expr(_LOW.format("regexp_extract(rest, '^[^/?#]*', 0)"))).withColumn(
        "path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    )
    rule, decision = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, kind in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, decision = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(decision)
    return out.select("page_id", "url", "host", "path", rule.alias("rule"), decision.alias("decision"))


_DIGITS = re.compile("[0-9]")


def symbols(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all URLs as seen by the models, each after ORDER zeros and before one zero; and the n + 1 offsets."""
    parts = [b"\0" * ORDER + _DIGITS.sub("0", u.lower()).encode("utf-8", "replace") + b"\0" if u else b"" for u in urls]
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def _hashes(data: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` bytes that end before each position."""
    h = np.full(len(ends), np.uint64(order + 1))
    for k in range(1, order + 1):
        h += data[ends - k].astype(np.uint64) * _STEP[k]
    return C.mix(h)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (class, context hash, next symbol) of every order."""
    for batch in batches:
        kinds = np.array(batch.column(0).to_pylist(), object)
        for kind in sorted(set(kinds)):
            urls = batch.column(1).filter(pa.array(kinds == kind))
            for lo, hi in C.chunks(C.utf8(urls)[1]):
                data, at = symbols(urls.slice(lo, hi - lo).to_pylist())
                ends, _, times = windows(data, positions(at))
                for order in range(ORDER + 1):
                    keys = np.stack([_hashes(data, ends, order), data[ends].astype(np.uint64)], 1)
                    grams, back = np.unique(keys, axis=0, return_inverse=True)
                    size, n = len(grams), np.bincount(back, times, len(grams)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * size, pa.string()), pa.array(np.full(size, order, np.int32)), pa.array(np.ascontiguousarray(grams[:, 0]).view(np.int64)), pa.array(grams[:, 1].astype(np.int32)), pa.array(n)],
                        names=["kind", "level", "context", "symbol", "n"],
                    )


def positions(at: np.ndarray) -> np.ndarray:
    """Places of the symbols to predict: all but the ORDER zeros before each URL."""
    size = np.maximum(np.diff(at) - ORDER, 0)
    return np.repeat(at[:-1] + ORDER - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def windows(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct symbol with the ORDER before it, which of them each place has, and how often they occur."""
    code = np.zeros(len(ends), np.uint64)
    for k in range(ORDER + 1):  # six bytes of eight
        code = code << np.uint64(8) | data[ends - k].astype(np.uint64)
    _, first, back, times = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    return ends[first], back, times


class Markov:
    """Sorted hash arrays of contexts and of their next symbols, per order."""

    def __init__(self, counts: pd.DataFrame):
        self.levels = []
        for level in range(ORDER + 1):
            t = counts[counts.level == level]
            context, symbol, n = t.context.to_numpy(np.int64).view(np.uint64), t.symbol.to_numpy(np.uint64), t.n.to_numpy(float)
            keys, back = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(back, n, len(keys)), np.bincount(back, minlength=len(keys))
            kept = total >= MIN_CONTEXT
            keep = kept[back] if len(back) else np.zeros(0, bool)
            pairs = C.mix(context[keep] + symbol[keep] * _STEP[9])
            order = np.argsort(pairs)
            self.levels.append((keys[kept], total[kept], kinds[kept].astype(float), pairs[order], n[keep][order]))

    def logp(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p = np.full(len(ends), 1 / 256)
        symbol = data[ends].astype(np.uint64)
        for level, (keys, total, kinds, pairs, n) in enumerate(self.levels):
            if not len(keys):
                continue
            h = _hashes(data, ends, level)
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[place] == h
            pair = C.mix(h + symbol * _STEP[9])
            where = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            count = np.where(pairs[where] == pair, n[where], 0.0)
            p = np.where(known, (count + kinds[place] * p) / (total[place] + kinds[place]), p)
        return np.log(p)


class Filter:
    """Two models and a cut; without both kinds, everything scores 0."""

    def __init__(self, counts: pd.DataFrame):
        kinds = set(counts.kind)
        self.models = [Markov(counts[counts.kind == k]) for k in ("block", "allow")] if kinds >= {"block", "allow"} else None
        self.cut = 0.0

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """Difference of log-likelihoods over the number of symbols."""
        out = np.zeros(len(urls))
        data, at = symbols(urls)
        ends = positions(at)
        if self.models is None or not len(ends):
            return out
        ends, back, _ = windows(data, ends)
        gain = (self.models[0].logp(data, ends) - self.models[1].logp(data, ends))[back]
        size = np.maximum(np.diff(at) - ORDER, 0)
        sums = np.r_[0, np.cumsum(gain)][np.r_[0, np.cumsum(size)]]
        return np.diff(sums) / np.maximum(size, 1)


@dataclass
class Trained:
    """A saved table with a row for each kind, level and context, which holds its next symbols and their counts, or None
    without both kinds; and the cut."""

    models: DataFrame | None
    cut: float


def _contexts(part: pa.Table) -> pa.Table:
    """The contexts of every order that occur in a part's URLs."""
    data, at = symbols(part.column("url").to_pylist())
    ends, _, _ = windows(data, positions(at))
    found = [np.unique(_hashes(data, ends, order)) for order in range(ORDER + 1)]
    sizes = [len(x) for x in found]
    return pa.table(
        {
            "part": pa.array(np.full(sum(sizes), part.column("part")[0].as_py(), np.int64)),
            "level": pa.array(np.repeat(np.arange(ORDER + 1, dtype=np.int32), sizes)),
            "context": pa.array(np.concatenate(found).view(np.int64)),
        }
    )


def _flat(held: pa.Table) -> pd.DataFrame:
    """Rows of kind, level, context, symbol and n, as Filter takes them."""
    grams = held.column("grams").combine_chunks()
    sizes, flat = pc.list_value_length(grams).to_numpy(zero_copy_only=False), pc.list_flatten(grams)
    out = {name: np.repeat(held.column(name).to_numpy(), sizes) for name in ("kind", "level", "context")}
    return pd.DataFrame(out | {name: pc.struct_field(flat, name).to_numpy(zero_copy_only=False) for name in ("symbol", "n")})


def scored(rows: DataFrame, models: DataFrame) -> DataFrame:
    """The rows with method_score in place of url. Each part of them meets the counts of its own contexts. Neither side of
    that join is broadcast, however small its size is estimated: both grow with the URLs."""
    rows = C.saved(rows.withColumn("part", F.xxhash64(F.monotonically_increasing_id())))  # copies are dealt out like others
    parts = 1 + (rows.agg(F.sum(F.octet_length("url"))).first()[0] or 0) // PART_BYTES
    rows = rows.withColumn("part", F.pmod("part", F.lit(parts)))
    needs = rows.select("part", "url").repartition(parts, "part").groupBy("part").applyInArrow(_contexts, "part long, level int, context long")
    held = needs.join(models.hint("merge"), ["level", "context"]).select("part", "kind", "level", "context", "grams")
    columns, build = [c for c in rows.columns if c not in ("url", "part")], Filter

    def run(part: pa.Table, held: pa.Table) -> pa.Table:
        urls, model = part.column("url").combine_chunks(), build(_flat(held))
        scores = [model.scores(urls.slice(lo, hi - lo).to_pylist()) for lo, hi in C.chunks(C.utf8(urls)[1])]
        return part.select(columns).append_column("method_score", pa.array(np.concatenate(scores) if scores else np.zeros(0)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in columns)
    sides = [x.repartition(parts, "part").groupBy("part") for x in (rows, held)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, f"{schema}, method_score double")


def balanced(seen: DataFrame) -> float:
    """The score at which the share of accepted above comes nearest to the share of rejected at or below it (of two as near,
    the larger); 0 without both kinds. Ranges of scores are counted and the one where the shares cross is divided again."""
    of = lambda kind: F.count_if(F.col("decision") == kind)
    top = seen.agg(of("allow"), of("block"), F.min("method_score"), F.max("method_score")).first()
    accepted, rejected, low, high = top
    if not accepted or not rejected:
        return 0.0
    goal, below, last = accepted * rejected, 0, None  # counted as if both kinds were as many
    while True:
        bin_ = F.floor((F.col("method_score") - low) / ((high - low) or 1.0) * BINS)
        inside = seen.where(F.col("method_score").between(low, high)).groupBy(bin_.alias("bin"))
        for _, a, b, least, most in sorted(inside.agg(of("allow"), of("block"), F.min("method_score"), F.max("method_score")).collect()):  # BINS + 1 rows
            upto = below + a * rejected + b * accepted
            if upto >= goal:
                break
            below, last = upto, most
        if least == most:
            return last if last is not None and goal - below < upto - goal else least
        low, high = least, most


def train(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> Trained:
    known = ruled(pages, rules).where("decision is not null").select("decision", "url", (F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0).alias("test"))
    sizes = {(r["decision"], r["test"]) for r in known.groupBy("decision", "test").count().collect()}  # four rows
    if len({kind for kind, _ in sizes}) < 2:
        return Trained(None, 0.0)
    split = len({kind for kind, test in sizes if not test}) == 2
    learn = (known.where("not test") if split else known).select("decision", "url")
    counts = learn.mapInArrow(_count, "kind string, level int, context long, symbol int, n long").groupBy("kind", "level", "context", "symbol").agg(F.sum("n").alias("n"))
    grams = counts.groupBy("kind", "level", "context").agg(F.sum("n").alias("total"), F.collect_list(F.struct("symbol", "n")).alias("grams"))
    models = C.saved(grams.where(F.col("total") >= MIN_CONTEXT).drop("total"))
    if not split:
        return Trained(models, 0.0)
    return Trained(models, max(0.0, balanced(C.saved(scored(known.where("test").select("decision", "url"), models)))))


def judge(pages: DataFrame, model: Trained, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, method_score."""
    rows = ruled(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")), rules)
    out = scored(rows, model.models) if model.models is not None else rows.withColumn("method_score", F.lit(0.0))
    verdict = F.coalesce("decision", F.when(F.col("method_score") > model.cut, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "method_score")
