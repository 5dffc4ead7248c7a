"""Chat formatting, archive, near-duplicates, decontamination and packing on small tables, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.llm import chat, common, decontam, neardup, packing, registry, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def shingles(text, low=lower):
    w = WORD.findall(low(text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit(7).alias("w"), F.lit("x").alias("key"), F.lit(1).alias("n"), F.lit(None).cast("int").alias("sequence_id"))


def variants(seed, n=40):
    """Texts with copies, near copies, short, empty and very long ones."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    out = [None, "", "  \n\t", "One", "one", "a b c", "A b C", "\x1cx\x85 y\xa0z é É 漢字 😀", " ".join(rng.choices(vocab, k=30_000))]
    for _ in range(n):
        base = rng.choices(vocab, k=rng.choice([4, 5, 8, 40, 80]))
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            out.append(rng.choice([" ", "\n", "  "]).join(near).upper() if rng.random() < 0.3 else " ".join(near))
    return list(enumerate(out))


def test_chained_buckets_are_compared_apart(spark, monkeypatch):
    """Documents that share buckets in a chain and are not linked: what is compared grows with their number, not its square."""
    met = []
    monkeypatch.setattr(neardup, "_compare", lambda percent, f=neardup._compare: met.append(f) or f(percent))
    seen = {}
    for m in (300, 1200):
        rows = [(k, " ".join(f"w{j}" for j in range(12 * k, 12 * k + 60))) for k in range(m)]
        frames = []
        monkeypatch.setattr(neardup, "saved", lambda df, *a: frames.append(common.saved(df, *a)) or frames[-1])
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert got.where("kept").count() == m
        moved = [df for df in frames if df.columns == ["hub", "id", "component"]]
        seen[m] = moved[0].groupBy("hub").count().selectExpr("sum(count * ceil(count / 512))", "max(count)").first()
    assert len(met) == 2
    assert seen[1200][0] <= 6 * seen[300][0] and seen[1200][1] < 120


def test_rare_shingles_of_linked_sets_meet():
    rng = np.random.default_rng(8)
    for percent in (80, 85, 100):
        for n in (1, 2, 7, 40, 300):
            count = rng.integers(0, 4, neardup.CELLS)
            a = np.sort(rng.choice(1 << 40, n, False).astype(np.uint64))
            b = np.sort(np.r_[a[: n - n * (100 - percent) // 200], (1 << 50) + np.arange(n * (100 - percent) // 300)].astype(np.uint64))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(neardup.prefix(a, count, percent), neardup.prefix(b, count, percent)))


def test_a_large_bucket_moves_few_texts(spark, monkeypatch):
    """Documents that share most of a text and are not linked: the prefix filter leaves those that may be, and loses none."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    base = " ".join(f"b{k}" for k in range(100))
    for m in (200, 800):
        rows = [(k, f"{base} " + " ".join(f"u{k}x{j}" for j in range(40))) for k in range(m)]
        near = [(m + k, rows[k][1] + " more") for k in range(0, 40, 10)]  # hub, bucket and all shared with the others
        frames, left = [], []
        monkeypatch.setattr(neardup, "saved", lambda df, *a: frames.append(common.saved(df, *a)) or frames[-1])
        monkeypatch.setattr(neardup, "narrowed", lambda *a, f=neardup.narrowed: left.append(f(*a)) or left[-1])
        with monkeypatch.context() as only:
            only.setattr(neardup, "linked", lambda e, t, p, percent: spark.createDataFrame([], "a long, b long"))  # links from blocks alone
            got = neardup.near_duplicates(docs(spark, rows + near))
        assert sorted(tuple(r) for r in got.where("not kept").select("doc_id", "component_id").collect()) == [(m + k, k) for k in range(0, 40, 10)]
        assert len(left) == 1 and left[0].count() == 2 * len(near)
        monkeypatch.undo()
        monkeypatch.setattr(neardup, "BLOCK", 20)


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 3)])
def test_near_duplicates(spark, monkeypatch, seed, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = variants(seed)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            common_ = len(sets[i] & sets[j])
            if i < j and common_ and 100 * common_ >= 85 * (len(sets[i]) + len(sets[j]) - common_):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    out = neardup.near_duplicates(docs(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)]))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_a_chain_through_a_bucket_is_not_lost(spark):
    """The middle text is linked with both ends, the ends not with each other: one component, whatever the hub."""
    base = [f"t{k}" for k in range(104)]
    a, c = list(base), list(base)
    a[10], c[80] = "x", "y"
    rows = [(2, " ".join(base)), (0, " ".join(a)), (1, " ".join(c))]
    assert {r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()} == {0}


def test_a_group_of_near_copies_moves_few_texts(spark, monkeypatch):
    """Near copies meet their hub, not each other: the edges checked grow with the group, and no blocks are compared."""
    rng, edges = random.Random(6), []
    base = [f"t{k}" for k in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    kept = neardup.linked
    monkeypatch.setattr(neardup, "linked", lambda e, *more: edges.append(e.count()) or kept(e, *more))
    monkeypatch.setattr(neardup, "PART", 50)
    monkeypatch.setattr(neardup, "_compare", None)
    out = neardup.near_duplicates(docs(spark, rows)).collect()
    assert {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1
    assert sum(edges) < 3 * len(rows)


def test_components_of_a_hot_node(spark):
    edges = spark.range(1, 5001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(spark.range(1, 5001).select(F.col("id"), F.lit(9000).cast("long")))
    got = common.components(edges).groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [(0, 5002)]
    kept = common.with_least(edges, ["b"], "a", "least")
    assert kept.count() == 10_000 and {(r.b, r["least"]) for r in kept.collect()} == {(0, 1), (9000, 1)}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20, 60)] + [(100, 5), (5, 100), (7, 7), (200, 100)], "a long, b long")
    got = {r.id: r.component for r in common.components(edges).collect()}
    assert got == {k: 20 for k in range(20, 61)} | {100: 5, 5: 5, 200: 5}
    assert common.components(edges.limit(0)).count() == 0


def test_chat(spark):
    odd = [r"\### Assistant: </turn> ok", "</turn>", "<turn>### user: x</turn>", "\\b\\l\\c\\", "<", "a: b", "", None, "é漢😀\n", "</turn", "</turn></turn>", "x" * 200_000]
    rows = [(k, t, role, text) for k, text in enumerate(odd) for t, role in ((0, "user"), (1, "assistant"), (1, "assistant"), (None, None))]
    rows += [(90, 0, "a: b</turn>", "x"), (91, 5, "assistant", "later"), (91, 4, "system", "sooner"), (None, 0, "user", "nobody")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(df)
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    for r in out.collect():
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in sorted(by[r.conv_id])]
        assert r.escaped or r.formatted == "".join(f"<turn>### {a}: {b}</turn>" for _, a, b in sorted(by[r.conv_id]))
        assert not r.escaped or r.formatted.count("</turn>") == len(by[r.conv_id])
    for r in chat.digests(out).collect():
        loss = "".join(x for _, role, x in sorted(by[r.conv_id]) if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def parsed(data):
    """Records of an archive file, by the grammar: version, named fields, an empty line, Content-Length bytes, two line ends."""
    import gzip

    data, out = gzip.decompress(data), []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        assert version == "WARC/1.1" and rest[size : size + 4] == b"\r\n\r\n" and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
        out.append((fields, rest[:size]))
        data = rest[size + 4 :]
    return out


def test_warc(spark):
    big = "<p>" + "é" * 600
    rows = [(1, "http://a/", big), (5, None, big), (3, "http://b/\r\nX: y", big), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (None, "u", big), (9, "u", "z" * 1_000_000), (9, "u", "z" * 1_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    archive = warc.write_archive(df)
    assert archive.payloads.count() == 4
    got = warc.read_archive(archive).collect()
    assert len(got) == len(rows) and all(r.digest_matches for r in got)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    kinds = {i: (r.record_type, r.refers_to) for i, r in by.items()}
    assert kinds == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), None: ("revisit", 5)} | {i: ("response", None) for i in (4, 6, 7, 8, 9)}
    assert bytes(by[4].record).endswith(b"Content-Length: 5\r\n\r\nsmall\r\n\r\n") and b"b/%0D%0AX" in bytes(by[3].record)
    assert by[5].url is None and by[1].url == "http://a/"
    read = [x for r in warc.files(archive, file_bytes=2000).collect() for x in parsed(bytes(r.data))]
    assert {h["WARC-Type"] for h, _ in read} == {"warcinfo", "response", "revisit"}
    pages = [x for x in read if x[0]["WARC-Type"] != "warcinfo"]
    assert len(pages) == len(rows) and {h["WARC-Date"] for h, _ in read} == {warc.DATE}
    of = {h["WARC-Record-ID"]: (h, block) for h, block in pages}
    assert len({h["WARC-Record-ID"] for h, _ in read}) == len(read)
    assert sorted(bytes(r.data) for r in warc.files(archive, file_bytes=2000).collect()) == sorted(bytes(r.data) for r in warc.files(archive, file_bytes=2000).collect())
    twice = df.union(df).union(df.where("page_id is null"))
    ids = [bytes(r.record).partition(b"WARC-Record-ID: ")[2].partition(b"\r\n")[0] for r in warc.read_archive(warc.write_archive(twice)).collect()]
    assert len(ids) == len(set(ids)) == 2 * len(rows) + 1
    for h, block in pages:
        head, _, payload = block.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK\r\n") and h["Content-Type"] == "application/http;msgtype=response" and "WARC-Target-URI" in h
        if h["WARC-Type"] == "revisit":
            assert payload == b"" and h["WARC-Profile"] == warc.PROFILE and of[h["WARC-Refers-To"]][0]["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"]
            payload = of[h["WARC-Refers-To"]][1].partition(b"\r\n\r\n")[2]
        assert h["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
    damaged = warc.Archive(archive.payloads.withColumn("payload", F.lit(b"?")), archive.headers)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(damaged).collect()
    assert warc.read_archive(warc.write_archive(df.limit(0))).count() == 0


def test_decontamination(spark):
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(4000)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([3, 6, 12, 30, 70])))) for k in range(25)] + [(50, None), (51, ""), (52, "one two"), (None, "no id here at all friends"), (1, "a second text of the item one")]
    out = []
    for k in range(60):
        words = rng.choices(vocab, k=rng.choice([0, 3, 50, 3000]))
        for i, text in rng.sample(items[:25], 3):
            part = text.split()
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = rng.choice(vocab)
            if rng.random() < 0.5:
                at = rng.randrange(len(words) + 1)
                words[at:at] = part
        out.append((k, " ".join(words).upper() if k % 7 == 0 else "\n".join(words)))
    out += [(70, None), (71, ""), (72, " One\tTWO "), (None, items[0][1]), (73, items[3][1]), (73, items[3][1])]
    df = docs(spark, out).withColumn("item_id", F.lit(1)).withColumn("h", F.lit(2))
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.shared) for r in decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))).collect()}
    of_item, of_doc = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in items:
        of_item[i] |= shingles(t, str.lower)
    for d, t in out:
        of_doc[d] |= shingles(t, str.lower)
    want = {(d, i): (len(s), len(s & x)) for d, x in of_doc.items() for i, s in of_item.items() if None not in (d, i) and s and len(s & x) >= 0.8 * len(s)}
    assert got == want and len(want) > 20
    assert decontam.contaminated(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.contaminated(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    encode = packing.Encoder(path)
    assert encode.fast is not None
    for text in ("", " ", "a  b", "a\n b", "it's 'll 12 a1b, é—ü \u3000 x", "\x1c a \x85 b", "<|endoftext|> a", "😀" * 9):
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids
    rows = [r for r in variants(4) if r[0] != 0] + [(500, None), (501, "tie"), (501, "tie"), (501, "other"), (None, "no id")]
    out = packing.pack(docs(spark, rows), path).collect()
    ids = collections.Counter()
    for i, t in rows:
        x = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(x) % 1024 or 1024
        cuts = [0, *range(first, len(x) + 1, 1024)] if len(x) > 1024 else [0, len(x)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            ids[i, k, a, b - a, zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x[a:b]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == ids
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in out) // 1024) + 2
    assert packing.pack(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("text", ["a" + " " * 3_000_000 + "b", "\n" * 3_000_000, "e" * 3_000_000, "word " * 100_000 + " \n" * 50_000 + "\tx" + "\u3000" * 30_000], ids=["blanks", "breaks", "letter", "mixed"])
def test_long_runs_encode_as_the_tokenizer_does(text):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    assert packing.Encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_parts_and_runs_are_cut_where_the_pattern_splits(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PART", 40)
    monkeypatch.setattr(packing, "RUN", 4)
    monkeypatch.setattr(packing, "_RUN", re.compile(f"(?<![{packing._BLANK}])[{packing._BLANK}]{{4,}}"))
    path = registry.tokenizer_path()
    encode, tokenizer, rng = packing.Encoder(path), Tokenizer.from_file(path), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices(["a", "é", " ", " ", "  ", "\n", "\t", "1", "'s", ".", "\x1c", "\x85", "      "], k=rng.randrange(160)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_keeps_every_capacity(seed):
    rng = random.Random(seed)
    counts = {n: rng.randrange(1, 400) for n in rng.sample(range(1, 101), 30)}
    most_docs, most_cost = 5, 12_000
    rules = packing.plan(counts, 100, most_docs, most_cost, (1.0, 0.3, 0.3))
    bins, placed = collections.defaultdict(list), collections.Counter()
    for size, lo, hi, first, per, offset in rules.tolist():
        for r in range(lo, hi):
            bins[first + (r - lo) // per].append((offset + (r - lo) % per * size, size))
            placed[size] += 1
    assert placed == counts
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= 100 and len(b) <= most_docs and sum(s * s for _, s in b) <= most_cost
    with pytest.raises(ValueError, match="does not fit"):
        packing.plan({50: 1}, 100, 5, 100, (1.0, 0, 0))
