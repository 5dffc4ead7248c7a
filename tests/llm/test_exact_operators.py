"""Importance resampling, centroid clustering and exact deduplication against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.llm import bitfilter, centroids, common, exactdup, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")


def odd_columns(df):
    """Extra columns whose names the operators use inside."""
    names = ["points", "norm", "len", "open", "sha", "salt", "best", "n", "v", "x", "cluster", "ids", "words", "h", "at", "part", "before", "a.b"]
    return df.select("*", *[F.lit(7).alias(c) for c in names])


TEXTS = [
    None, "", " \t\r\n\x0b\x0c", "One two", "onetwo", "O ne\ttwo", "One two", "One  two", "é É 漢字 😀 x\x85y\xa0z", "é É漢字😀x\x85y\xa0z", "a" * 70, "A" * 64 + "b",
    "x" * 200 + " " + "y" * 65 + " z", "same start of more than sixty-four characters in all of these texts, then 1", "same start of more than sixty-four characters in all of these texts, then 2",
    "word " * 30, "word " * 29 + "word", " ".join(random.Random(3).choices(["alpha", "beta9", "GAMMA", "naïve", "x-y_z"], k=20_000)),
]


def rows_of(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(50)] + ["Ünder", "A1", "don't"]
    texts = TEXTS + [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 19, 20, 21, 60]))) for _ in range(40)]
    texts += rng.choices(texts, k=30)
    rows = [(k if k % 11 else None, t) for k, t in enumerate(texts)]
    return rows + [(5, "One two"), (5, "One two"), (5, "another text for a repeated id")]


def test_exact_duplicates(spark):
    rows = rows_of(1)
    got = exactdup.exact_duplicates(odd_columns(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), digest_all=True).collect()
    assert len(got) == len(rows)
    norm = [BLANK.sub("", t or "") for _, t in rows]
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in norm]
    groups = {}
    for (doc, text), h in zip(rows, digest, strict=True):
        groups.setdefault(h, []).append((-len(text or ""), doc is None, doc))
    want = Counter()
    for h, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for k, m in enumerate(members):
            want[(m[2], members[0][2], len(members), k == 0, h)] += 1
    assert Counter(tuple(r) for r in got) == want


def test_only_open_groups_are_hashed(spark):
    rows = [(k, f"{'same start ' * 10}{k % 7}" if k < 20 else "x" * k) for k in range(100)]
    got = exactdup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.text_sha256 is not None for r in got) == 20
    assert {r.doc_id: r.keep_id for r in got} == {k: k % 7 if k < 20 else k for k in range(100)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exactdup.exact_duplicates(docs).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exactdup.exact_duplicates(docs).count() == 0
    assert resampling.resample(docs, docs).count() == 0
    vectors = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    assert centroids.with_inertia(*centroids.cluster(vectors)).count() == 0


def test_bits_hold_every_hash(spark):
    ids = spark.range(50_000).select(F.xxhash64("id").alias("h"))
    bits = bitfilter.bit_array(ids)
    held = spark.range(200_000).where(bitfilter.likely(bits, F.xxhash64("id")))
    assert held.where("id < 50000").count() == 50_000 and held.count() < 51_000
    assert spark.range(100).where(bitfilter.likely(bitfilter.bit_array(ids.limit(0)), F.xxhash64("id"))).count() == 0


def vectors(seed, scale):
    rng = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(rng.normal(0, scale, (60, 4)))]
    rows += [(int(k), list(rows[k][1])) for k in range(5)] + [(None, [0.5, -0.5, 1.5, 2.0]), (100, [0.001, -0.001, 0.0, -0.0])]
    return rows, rows + [(101, None), (102, [1.0]), (103, [1.0, None, 2.0, 3.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]), (106, [])]


def brute_clusters(rows, count, rounds):
    code = lambda x: x.as_integer_ratio()[0] * 256 // x.as_integer_ratio()[1]
    kept = [(i, [code(x) for x in v]) for i, v in rows]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(kept, key=key)[:count]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), k) for k, c in enumerate(centers)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for k in range(len(centers)):
            if own := [v for (_, v), (_, a) in zip(kept, of, strict=True) if a == k]:
                centers[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    of = assign()
    total = Counter()
    for d, k in of:
        total[k] += d
    most = (1 << 63) - 1
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, k, min(d, most), min(total[k], most), min(sum(total.values()), most), sha[k]) for (i, _), (d, k) in zip(kept, of, strict=True))


@pytest.mark.parametrize(("seed", "scale", "huge"), [(1, 1.0, []), (2, 1e5, []), (3, 1.0, [[2.0**15, 0.0, -(2.0**16), 3.0], [2.0**20, 1.0, 1.0, 1.0]]), (4, 1e3, [[1e300, -1e300, 0.0, 2.5], [1e18, 1e9, 0.0, 0.0]])])
@pytest.mark.parametrize("count", [6, 80])
def test_centroids(spark, seed, scale, huge, count):
    kept, rows = vectors(seed, scale)
    more = [(200 + k, v) for k, v in enumerate(huge * 3)]
    df = odd_columns(spark.createDataFrame(rows + more, "vec_id long, embedding array<double>").repartition(3))
    got = centroids.with_inertia(*centroids.cluster(df, count=count, dims=4)).collect()
    assert Counter(tuple(r) for r in got) == brute_clusters(kept + more, count, 5)


def test_every_way_gives_the_same_distances():
    rng = np.random.default_rng(5)
    top = 1 << 22
    for reach in (1000, top, 1 << 24, 1 << 30):
        rows = rng.integers(-reach, reach + 1, (50, 64))
        rows[0] = reach
        centers = rng.integers(-reach, reach + 1, (9, 64)).astype(object)
        centers[1], centers[2:4] = -reach, rows[5].astype(object)
        place, far = centroids.nearest(rows, centers)
        for i, r in enumerate(rows.tolist()):
            want = min((sum((a - b) ** 2 for a, b in zip(r, c, strict=True)), k) for k, c in enumerate(centers.tolist()))
            assert (far[i], place[i]) == want


def grams(text):
    w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return w, Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def brute_sample(rows, target):
    own, goal = Counter(), Counter()
    made = [grams(t) for _, t in rows]
    for _, c in made:
        own += c
    for _, t in target:
        goal += grams(t)[1]
    s, t = sum(own.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for (doc, _), (w, c) in zip(rows, made, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in c.items())
        out.append([doc, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    able = able[: 5 * len(able) // 100]
    ranks = {id(r): k + 1 for k, r in enumerate(able)}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


@pytest.mark.parametrize("piece", [1 << 22, 3000])
def test_resampling(spark, monkeypatch, piece):
    rows = [r for r in rows_of(2) if r[0] != 5] * 2
    target = [(1, "w1 w2 w3 A1"), (2, None), (None, "alpha beta9 gamma " * 20)]
    monkeypatch.setattr(resampling, "count_matrix", lambda *a, f=resampling.count_matrix: f(*a, piece=piece))
    docs = odd_columns(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = resampling.resample(docs, spark.createDataFrame(target, "item_id long, text string")).collect()
    want = brute_sample(rows, target)
    without_rank = Counter()
    for k, n in want.items():
        without_rank[k[:4]] += n
    assert Counter(tuple(r)[:4] for r in got) == without_rank
    assert sorted((r.rank, r.doc_id is None, r.doc_id or 0, r.score) for r in got if r.rank) == sorted((k[4], k[0] is None, k[0] or 0, k[3]) for k in want if k[4])


def test_resampling_with_an_empty_target(spark):
    rows = [(k, " ".join(f"w{k * j % 37}" for j in range(30))) for k in range(40)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == brute_sample(rows, [])


def test_registers_of_words_of_any_length():
    rng = random.Random(7)
    texts = ["".join(rng.choices("abc09é漢", k=n)).encode() for n in (1, 2, 63, 64, 65, 66, 200, 70_000, 3)]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    n, text, bucket, count = resampling.features(data, np.array([0, len(data)]), 10000)
    runs = [b" ".join(texts[i : i + k]) for k in (1, 2, 3) for i in range(len(texts) - k + 1)]
    assert dict(zip(bucket.tolist(), count.tolist(), strict=True)) == Counter(zlib.crc32(r) % 10000 for r in runs) and n[0] == len(texts)
    assert not text.any()


@pytest.mark.parametrize("piece", [10, 64, 1000])
def test_long_texts_in_pieces(piece):
    rng = random.Random(8)
    text = "".join(rng.choices("ab é-\n7", weights=[5, 5, 3, 1, 1, 1, 1], k=20_000)).encode() + b"x" * 5000
    data = common._LOWER[np.frombuffer(text, np.uint8)]
    n, total = resampling.long_features(data, 10000, piece)
    w, c = grams(text.decode())
    assert n == len(w) and {int(b): int(total[b]) for b in np.flatnonzero(total)} == dict(c)
