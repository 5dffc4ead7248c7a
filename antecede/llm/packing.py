"""Best-fit packing of token sequences under several capacities at once (vector best-fit, decreasing).

A piece of L tokens asks for the vector (L tokens, 1 document, L * L attention cost); a sequence offers (capacity, max_docs,
max_cost). Pieces are taken by decreasing length; each goes to the open sequence in which it fits under every constraint
and whose weighted residual norm is then smallest, else to a new one.

As what a piece asks for depends on its length alone, the plan is made from the counts of the lengths (at most `capacity`
numbers, whatever the input): equal sequences are kept as one pattern with a multiplicity, and the run of equal pieces that
a pattern takes is found by division. The plan thus has a few thousand rules (length, ranks from-to -> sequences, offset);
pieces get a rank among those of their length by counting in buckets: the number of pieces in the buckets before goes
ahead of a bucket's pieces, which are then numbered in their order. A binary search finds the place. No piece passes
through the driver.

By default max_docs = capacity and max_cost = capacity ** 2, which no set of pieces that fits by its tokens can exceed, and
the weights of the two are close to nothing: the packing is then the scalar best fit by tokens. Tighter limits bind.

Documents of at most `capacity` tokens are never cut. Longer ones are cut into pieces of `capacity` tokens, of which the
first may be shorter. Null text counts as empty; an empty text is the end token alone. A very long text, or one with
millions of equal characters in a row, is encoded in parts and gives the ids of the whole. Repeated rows are packed each, in
the order of their texts' checksums. Rows without doc_id are packed too. Empty table: empty result. Other columns are not
looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

CAPACITY, END_ID = 1024, 2
#: Pieces of a bucket in which ranks are counted, about.
BUCKET_ROWS = 8_000
#: Fixed value: the pattern by which byte-level BPE splits texts first.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of a text that are encoded at a time, about, and blanks in a row that the fast engine gets at most.
PART, RUN = 1 << 18, 20_000
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(r"(?<=[^\s])[ \n]")
_RUN = re.compile(f"(?<![{_BLANK}])[{_BLANK}]{{{RUN},}}")


class Encoder:
    """Encodes as the byte-level BPE of the tokenizer file does. If the file's ids are its merge order, tiktoken applies
    them, several times as fast; texts that hold a special token's string, and other files, go through the tokenizer.

    A long text is encoded in parts of about PART characters, cut where a blank follows a character that is none, as the
    pattern always splits there. A run of more than RUN blanks, over which the fast engine's pattern would recurse, is a
    piece of its own but for its last blank and goes through the tokenizer, and what is left on either side does not."""

    def __init__(self, tokenizer_path: str):
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.slow = tokenizer_path, None
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._by_ranks(spec)

    def _by_ranks(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if model.get("type") != "BPE" or not plain or spec.get("normalizer"):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        if [vocab.get(m) for m in merges] != list(range(256, 256 + len(merges))) or not set("".join(vocab)) <= set(byte_of):
            return None
        import tiktoken

        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _slowly(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> array:
        out = array("I")
        if self.fast is None or any(s in text for s in self.special):
            out.extend(self._slowly(text))
            return out
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PART) if len(text) - at > PART else None
            part = text[at : cut.start() if cut else len(text)]
            at += len(part)
            done = 0
            for run in _RUN.finditer(part) if len(part) > RUN else ():
                stop = run.end() - (run.end() < len(part) or at < len(text))
                out.extend(self.fast(part[done : run.start()]))
                out.extend(self._slowly(part[run.start() : stop]))
                done = stop
            out.extend(self.fast(part[done:]))
        return out


_encoders: dict[str, Encoder] = {}


def _cut(tokenizer_path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = Encoder(tokenizer_path)
        encode = _encoders[tokenizer_path]
        for batch in batches:
            row, piece, start, length, crc = (array("q") for _ in range(5))
            for k, text in enumerate(batch.column(1)):
                data = encode(text.as_py() or "")
                data.append(end_id)
                n = len(data)
                view, at, nth = memoryview(data), 0, 0
                while at < n:
                    size = (n % capacity or capacity) if at == 0 else capacity
                    row.append(k)
                    piece.append(nth)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(view[at : at + size]))
                    at, nth = at + size, nth + 1
            columns = [np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (row, piece, start, length, crc)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0])), pa.array(columns[1].astype(np.int32)), *(pa.array(x) for x in columns[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float]) -> np.ndarray:
    """Rules (length, rank_from, rank_to, first_sequence, per_sequence, offset): pieces of a length with ranks from-to fill
    sequences first_sequence, first_sequence + 1, ... with per_sequence each, from that offset on."""
    limit = (capacity, max_docs, max_cost)
    rules, fresh = [], 0
    open_: list[list[int]] = []  # residual tokens, documents and cost, first sequence, how many

    def fits(residual: tuple | list, need: tuple[int, int, int]) -> int:
        return min(residual[k] // need[k] for k in range(3))

    for size in sorted(counts, reverse=True):
        need, left, at = (size, 1, size * size), counts[size], 0
        if fits(limit, need) < 1:
            raise ValueError(f"a piece of {size} tokens does not fit into an empty sequence")
        while left:
            able = [p for p in open_ if fits(p, need)]
            if able:
                best = min(able, key=lambda p: (sum(w * ((p[k] - need[k]) / limit[k]) ** 2 for k, w in enumerate(weights)), p[3]))
                open_.remove(best)
            else:
                best = [*limit, fresh, -(-left // fits(limit, need))]
                fresh += best[4]
            per = fits(best, need)  # the norm only falls as a sequence fills, so it takes all it can
            whole = min(best[4], left // per)
            used = 0
            for many, each in ((whole, per), (int(whole < best[4] and left > whole * per), left - whole * per)):
                if many:
                    rules.append((size, at, at + many * each, best[3] + used, each, capacity - best[0]))
                    open_.append([best[0] - each * size, best[1] - each, best[2] - each * size * size, best[3] + used, many])
                    at, left, used = at + many * each, left - many * each, used + many
            if used < best[4]:
                open_.append([*best[:3], best[3] + used, best[4] - used])
        open_ = [p for p in open_ if min(p[:3]) > 0]
    return np.array(sorted(rules), np.int64).reshape(-1, 6)


def _place(rules: np.ndarray):
    """Rows sorted by bucket, length and kind, the base of each (bucket, length) before its pieces: the pieces' places."""
    keys = (rules[:, 0] << 40) + rules[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = 0  # of the next piece, where a group goes on in the next batch
        for batch in batches:
            base = batch.column(5).to_numpy(zero_copy_only=False)
            row = np.arange(len(base))
            head = np.maximum.accumulate(np.where(base >= 0, row, -1))
            ranks = np.where(head >= 0, base[np.maximum(head, 0)] + row - head - 1, rank + row)
            if not len(base):
                continue
            rank = int(ranks[-1]) + 1
            piece = batch.filter(pa.array(base < 0))
            length, nth = piece.column(3).to_numpy(zero_copy_only=False), ranks[base < 0]
            chosen = rules[np.searchsorted(keys, (length << 40) + nth, "right") - 1] if len(length) else np.zeros((0, 6), np.int64)
            nth = nth - chosen[:, 1]
            per = np.maximum(chosen[:, 4], 1)
            columns = [piece.column(k) for k in range(5)]
            columns += [pa.array(chosen[:, 3] + nth // per), pa.array(chosen[:, 5] + nth % per * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    max_docs: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-7, 1e-7),
    end_id: int = END_ID,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; see the module. max_docs and max_cost
    default to what `capacity` tokens can never exceed."""
    pieces = saved(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            _cut(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"
        )
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    rules = plan(counts, capacity, max_docs or capacity, max_cost or capacity * capacity, weights)

    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    per = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # a group's base goes ahead of its pieces through the same shuffle, so that ranks need neither a join nor a window over pieces
    bases = per.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    rows = pieces.withColumn("base", F.lit(-1).cast("long")).unionByName(bases, allowMissingColumns=True)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "length", F.desc("base"), "doc_id", "piece", "ids_crc32")
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "base").mapInArrow(
        _place(rules), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
