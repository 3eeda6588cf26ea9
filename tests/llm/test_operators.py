"""Every operator against a brute-force version, on the smallest tables and on a table of odd rows."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.llm import components, decontam, exact, jaccard, langid, licenses, lines, packing, phrases, quality, runs, suffix, toxicity, warc
from reelgrid.llm.queries import ORACLE_SQL, QUERIES
from reelgrid.session import shared_dir

LONG = " ".join(f"word{k}" for k in range(3000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs", "en", 9),
    (2, "the quick brown fox jumps over the lazy dog and runs", "en", 9),
    (2, "the quick brown fox jumps over the lazy dog and runs", "en", 9),
    (3, None, None, None),
    (4, "", "en", 1),
    (5, "   \n\t ", "fr", 1),
    (6, "x", None, 1),
    (7, LONG, "en", 1),
    (8, LONG + " more", "en", 1),
    (9, "The  Quick brown fox jumps over the lazy dog and runs", "en", 9),
    (10, "aaaa" * 400, "de", 2),
    (11, "Ünï ß ÀÉ 日本語 text\n\nUnder way", "de", 2),
    (12, "<|endoftext|> \x1c 1234 ½", "de", 2),
    (None, "a null id", "de", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those the operators use."""
    rows = [(i, t, lang, n, "k", 1, "x") for i, t, lang, n in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, h string, component_id int, norm string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1] is not None, m[1] or 0))[1]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in members]
    return Counter(out)


@pytest.mark.parametrize("hashed", [None, lambda norm: F.lit(b"same").cast("binary"), lambda norm: F.substring(F.md5(norm), 1, 1).cast("binary")])
def test_exact(docs, odd, hashed):
    for df in (docs.limit(60), odd, odd.limit(0)):
        got = exact.exact_groups(df, content_hash=hashed)
        assert Counter(map(tuple, got.collect())) == brute_exact(texts(df))


# suffix dedup


def brute_repeats(rows, n):
    seen = Counter(t[i : i + n] for t in rows for i in range(len(t) - n + 1))
    out = []
    for t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((int(gone.sum()), int((np.diff(np.pad(gone, 1).astype(int)) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length,wide,bucket", [(400, 4096, 16_384), (64, 4096, 3), (64, 2, 16_384), (40, 8, 3)])
def test_suffix(docs, odd, length, wide, bucket, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET", bucket)
    for df in (docs.where("length(text) < 4000"), odd, odd.limit(0)):
        rows = texts(df)
        want = brute_repeats([(t or "").encode() for _, t in rows], length)
        got = suffix.remove_repeats(df, length=length, wide=wide).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == Counter((i, len((t or "").encode()), *w) for (i, t), w in zip(rows, want, strict=True))


def test_suffix_segments(spark, monkeypatch):
    """Repeats inside one long text that is scanned in several pieces."""
    monkeypatch.setattr(suffix, "SEGMENT", 1000)
    rng = np.random.default_rng(1)
    block = bytes(rng.integers(97, 123, 900, dtype=np.uint8)).decode()
    text = block + "".join(map(chr, rng.integers(97, 123, 3000))) + block[100:700] + "z" * 300
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    removed, spans, kept = brute_repeats([text.encode()], 200)[0]
    row = suffix.remove_repeats(df, length=200).first()
    assert (row["n_removed"], row["n_spans"], bytes(row["kept"])) == (removed, spans, kept)


def test_multikey_order():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 40), dtype=np.uint8)) for _ in range(500)]
    order = suffix.multikey_order(strings, list(range(500)))
    assert [strings[i] for i in order] == sorted(strings)


# Jaccard join


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        low[find(a)] = min((x for x in (low.get(find(a)), i) if x is not None), default=None)
    return Counter((i, len(sets[a]), low[find(a)] if sets[a] else i) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("k,num,den,region", [(3, 90, 100, 20_000), (5, 8, 10, 20_000), (3, 90, 100, 3), (2, 6, 10, 2)])
def test_jaccard(spark, docs, odd, k, num, den, region):
    base = [f"w{x}" for x in np.random.default_rng(5).integers(0, 999, 120)]
    rng = np.random.default_rng(6)
    near = []
    for i in range(40):  # near copies that chain
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            w[at] = f"new{rng.integers(0, 9)}"
        near.append((1000 + i, " ".join(w)))
    chain = spark.createDataFrame(near, "doc_id long, text string")
    for df in (docs, odd, odd.limit(0), chain) if region > 100 else (chain, odd):
        got = jaccard.near_duplicates(df, shingle=k, num=num, den=den, region=region)
        assert Counter(map(tuple, got.collect())) == brute_components(texts(df), k, num, den)


@pytest.mark.parametrize("k,num,den,region", [(3, 90, 100, 40), (5, 8, 10, 50), (2, 6, 10, 7)])
def test_jaccard_split(spark, k, num, den, region):
    """Clusters of near copies far over a task's bound: cells, rings and blocks give the components of all pairs."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(3):
        base = [f"g{g}w{x}" for x in rng.integers(0, 999, 120)]
        for i in range(120):
            w = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 9)):
                w[at] = f"new{rng.integers(0, 6)}"
            rows.append((1000 * g + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.near_duplicates(df, shingle=k, num=num, den=den, region=region).collect())) == brute_components(rows, k, num, den)


def test_jaccard_clash(spark, monkeypatch):
    """Sets whose first hashes are equal are told apart by the second."""
    plain = jaccard.set_hashes
    monkeypatch.setattr(jaccard, "set_hashes", lambda s: (plain(s)[0] & 3, plain(s)[1]))
    rows = [(i, f"text number {i} is unlike {i * 7} and {i * 11} here") for i in range(12)] + [(100, "text number 3 is unlike 21 and 33 here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(df, shingle=2, num=9).collect()}
    assert got == {(i, i) for i in range(12)} | {(100, 3)}


def test_parts_share():
    """Sets at the threshold always agree on a part."""
    rng = np.random.default_rng(2)
    for n in (1, 5, 9, 10, 15, 16, 25, 40, 160, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for num, den in ((90, 100), (8, 10)):
            drop = (den - num) * n // den
            for b in (a[drop:], np.unique(np.concatenate((a, rng.integers(0, 2**63, n * (den - num) // num).astype(np.uint64))))):
                inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if len(b) and den * inter >= num * union:
                    assert set(np.concatenate(jaccard.parts_of(a, num, den))) & set(np.concatenate(jaccard.parts_of(b, num, den)))


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 101), (102, 101), (50, 50)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {100: 100, 101: 100, 102: 100}


# decontamination


def brute_hits(rows, items, n):
    words = lambda t: [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[s : s + n])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if own := windows.get(tuple(w[s : s + size])):
                    hit.update(range(s, s + size))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("window,block", [(10, 1 << 25), (10, 4000), (3, 1 << 25)])
def test_decontamination(spark, sf, docs, odd, window, block):
    own = spark.read.parquet(f"{sf}/benchmark.parquet")
    small = spark.createDataFrame([(1, "lazy dog"), (2, None), (3, "x"), (4, ""), (5, "quick brown fox jumps over the lazy dog and runs"), (6, "word7 word8 word9 word10 word11 word12 word13 word14 word15 word16 word17"), (7, "lazy dog")], "item_id long, text string")
    single = odd.dropDuplicates(["doc_id"])
    for df, items in ((docs, own), (single, small), (single, small.limit(0)), (odd.limit(0), small)):
        got = decontam.decontaminate(df, items, window=window, block_bytes=block)
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in got.collect()) == brute_hits(texts(df), [tuple(r) for r in items.collect()], window)


# language ID, toxicity


@pytest.mark.parametrize("block", [1 << 30, 120])
def test_decontamination_rows(spark, block):
    """Rows without an id, or with one id and several texts, or repeated whole, are rows of their own at any number of blocks."""
    bad, bad2 = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(None, bad), (None, "all clean here"), (None, "all clean here"), (1, f"so {bad} end"), (1, "quite another text of this id"), (2, f"{bad} {bad2}"), (2, f"{bad} {bad2}"), (3, None), (3, None)]
    items = [("a", bad), ("b", bad2), ("c", "not in any document at all")] + [(f"x{k}", f"filler item {k} of the benchmark") for k in range(4)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = decontam.decontaminate(df, bench, window=4, block_bytes=block).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in got) == Counter(
        {(None, 6, 6, ("a",), True): 1, (None, 3, 0, (), False): 2, (1, 8, 6, ("a",), True): 1, (1, 6, 0, (), False): 1, (2, 12, 12, ("a", "b"), True): 2, (3, 0, 0, (), False): 2}
    )


def test_language(docs, odd):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["lang_pred"] == want[i] for i in held) >= 0.95 * len(held)
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 5)) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify(odd.limit(0)).count() == 0


def test_language_ngrams():
    """Each text is seen alone, whatever stands beside it."""
    some = ["Ab ba.", "", "x", "Ünder 12 way", None, "ab"]
    alone = [dict(zip(*map(np.ndarray.tolist, next(iter(langid.ngrams([t])))), strict=True)) for t in some]
    assert [dict(zip(k.tolist(), c.tolist(), strict=True)) for k, c in langid.ngrams(some)] == alone
    a, b, blank = ord("a"), ord("b"), 0x20
    assert alone[5] == {a: 1, b: 1, blank << 21 | a: 1, a << 21 | b: 1, b << 21 | blank: 1, (blank << 21 | a) << 21 | b: 1, (a << 21 | b) << 21 | blank: 1}


def brute_profile(texts, n):
    """The n most frequent 1- to 3-grams of words between blanks, most frequent first, ties by code."""
    counts = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            padded = f" {w} "
            counts.update(g for k in (1, 2, 3) for g in (padded[i : i + k] for i in range(len(padded) - k + 1)) if g.strip())
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:n]]


def test_language_brute(spark):
    """Profiles, ranks, out-of-place distances and ties against a plain version."""
    rng = np.random.default_rng(12)
    words = {"aa": ["this", "that", "with", "when"], "bb": ["das", "dies", "mit", "wenn"], "cc": ["ceci", "cela", "avec", "quand"]}
    rows = [(i, " ".join(rng.choice(words[lang], rng.integers(1, 30))) + rng.choice(["", ".", " 12"]), lang) for i in range(150) for lang in [list(words)[i % 3]]]
    rows += [(900, "zzz", "aa"), (901, "", None), (902, None, "bb"), (903, "123", "cc"), (904, "this das", None), (905, "this das", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 5]
    profiles = {lang: brute_profile([t for _, t, x in learn if x == lang], 40) for lang in words}
    worst = max(map(len, profiles.values()))
    want = {}
    for i, t, _ in rows:
        own = brute_profile([t], worst)
        distance = {lang: sum(abs(p.index(g) - k) if g in p else worst for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(distance, key=lambda x: (distance[x], x)) if own else "und"
        want[i] = (best, distance[best] if own else 0, round(1 - distance[best] / (worst * len(own)), 9) if own else 0.0)
    got = {r["doc_id"]: (r["lang_pred"], r["distance"], round(r["score"], 9)) for r in langid.identify(df, ranks=40).collect()}
    assert got == want and got[904] == got[905]
    assert all(k in (901, 902, 903) for k, v in got.items() if v[0] == "und")


def test_toxicity(spark, docs, odd, sf):
    rng = np.random.default_rng(9)
    plain = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(300):
        w = [plain[k] for k in rng.integers(0, 60, 40)]
        if i % 3 == 0:
            w[5] = rng.choice(["horrible", "horribl", "horribles"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert sum(got[i]["predicted"] == int(i % 3 == 0) for i in held) >= 0.9 * len(held)
    unseen = spark.createDataFrame([(1, "w1 w2 w3 w4 horrrible w5 w6 w7 w8"), (2, "w1 w2 w3 w4 w9 w5 w6 w7 w8")], "doc_id long, text string")
    model = toxicity.fit(df, id_col="doc_id", text_col="text", label_col="toxic")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(unseen, model).collect()}
    assert s[1] > s[2]
    rows = toxicity.detect(odd, spark.createDataFrame([(1, 1), (7, 0), (4, None)], "doc_id long, toxic int")).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.detect(odd, spark.createDataFrame([], "doc_id long, toxic int")).count() == len(ODD)


def test_toxicity_brute():
    """Bags, one step of training and scores against plain versions."""
    some = ["Bad bad word", "", "ünder x", None]
    for (ids, weights), t in zip(toxicity.bags(some), some, strict=True):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        assert len(ids) == len(set(ids.tolist())) and abs(weights.sum() - (1 if words else 0)) < 1e-5
        if words:  # one word's subwords share its weight
            alone = [toxicity.bags([w])[0] for w in words]
            total = Counter()
            for i, w in alone:
                total.update(dict(zip(i.tolist(), (w / len(words)).tolist(), strict=True)))
            assert set(total) == set(ids.tolist()) and all(abs(total[k] - v) < 1e-5 for k, v in zip(ids.tolist(), weights.tolist(), strict=True))
    model = toxicity.Model(np.random.default_rng(1).standard_normal(toxicity.BUCKETS), 0.3)
    for s, (ids, weights) in zip(model.scores(some), toxicity.bags(some), strict=True):
        assert abs(s - 1 / (1 + np.exp(-0.3 - float((model.bucket[ids] * weights).sum())))) < 1e-5
    labels, share = np.array([1.0, 0.0, 0.0, 1.0]), np.array([0.5, 1.5, 1.0, 1.0])
    data = toxicity.bags(["bad one", "good two", "good ones", "very bad"])
    rng = np.random.default_rng(3)
    table, w, b = rng.standard_normal((toxicity.BUCKETS, toxicity.SIZE)), rng.standard_normal(toxicity.SIZE), 0.1
    loss = lambda table, w, b: sum(-s * np.log(p if y else 1 - p) for (i, x), y, s in zip(data, labels, share, strict=True) for p in [1 / (1 + np.exp(-(x[:, None] * table[i]).sum(0) @ w - b))]) / len(data)
    near, grad, gw, gb = toxicity.gradients(data, labels, share, table, w, b, 1.0)
    for k in (0, len(near) - 1):
        for d in (0, toxicity.SIZE - 1):
            moved = table.copy()
            moved[near[k], d] += 1e-5
            assert abs((loss(moved, w, b) - loss(table, w, b)) / 1e-5 - grad[k, d]) < 1e-3
    step = np.eye(toxicity.SIZE)[2] * 1e-5
    assert abs((loss(table, w + step, b) - loss(table, w, b)) / 1e-5 - gw[2]) < 1e-3 and abs((loss(table, w, b + 1e-5) - loss(table, w, b)) / 1e-5 - gb) < 1e-3


def test_toxicity_empty(spark, docs):
    known = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.detect(docs.limit(0), known).count() == 0


# WARC


def test_warc(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nX: y", None), (4, "http://b/", ""), (5, "http://c/", "é" * 5000), (6, "http://d/", "é" * 5000), (6, "http://e/", "other"), (None, "http://n/", "nobody")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, mark string")
    for least, level in ((0, 6), (100, 1)):
        sets = []
        for _ in range(2):
            folder = f"{shared_dir(spark)}/warc-{hashlib.sha256(str(np.random.rand()).encode()).hexdigest()}"
            manifest = warc.write_warc(df, folder, roll_bytes=600, shards=3, min_revisit_bytes=least, level=level)
            sets.append(sorted(map(tuple, manifest.collect())))
            rows = warc.read_warc(spark, folder).collect()
            first = {}
            for i, _, html in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
                first.setdefault((html or "").encode(), i)
            want = Counter()
            for i, _, html in pages:
                raw = (html or "").encode()
                ref = first.get(raw) if i is not None and len(raw) >= least and first.get(raw) != i else None
                want[(None if i is None else str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if ref is None else "revisit", None if ref is None else str(ref), raw if ref is None else None)] += 1
            assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows) == want
        assert sets[0] == sets[1]  # the same files, byte for byte
    # What a finished and a failed earlier attempt left is replaced and cleared.
    import os

    folder = f"{shared_dir(spark)}/warc-again-{np.random.rand()}"
    local = folder.removeprefix("file://")
    os.makedirs(local)
    for name in ("part-000000-0000.warc.gz", ".tmp-0-99-0"):
        with open(f"{local}/{name}", "wb") as f:
            f.write(b"half")
    warc.write_warc(df, folder, roll_bytes=600, shards=3, level=1)
    assert warc.read_warc(spark, folder).count() == len(pages)
    assert not [x for x in os.listdir(local) if x.startswith(".tmp-")]
    folder = f"{shared_dir(spark)}/warc-empty-{np.random.rand()}"
    assert warc.write_warc(df.limit(0), folder).count() == 0 and warc.read_warc(spark, folder).count() == 0


# packing


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("tokens,segments,loss", [(2048, 256, None), (64, 4, 40), (128, 2, None), (16, 1, 5)])
def test_packing(docs, odd, tokens, segments, loss):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    for df in (docs.limit(40), odd.dropDuplicates(["doc_id"]), odd.limit(0)):
        whole = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts(df)}
        rows = packing.pack(df, tokenizer(), tokens=tokens, segments=segments, loss=loss, open_bins=4, with_ids=True).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append(r)
            assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert {i: sum((r["ids"] for r in sorted(p, key=lambda r: r["start"])), []) for i, p in pieces.items()} == whole
        for s in sequences.values():
            s.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in s] == np.concatenate(([0], np.cumsum([r["length"] for r in s])[:-1])).tolist()
            assert sum(r["length"] for r in s) <= tokens and len(s) <= segments and sum(r["loss_tokens"] for r in s) <= (loss or tokens)
        if tokens == 2048 and sequences:
            sizes = [sum(r["length"] for r in s) for s in sequences.values()]
            assert sum(tokens - n for n in sizes if n & (n - 1)) <= 0.01 * sum(sizes) + 64


def test_packing_loss_from(spark):
    df = spark.createDataFrame([(i, "a b c d e f g h", 3) for i in range(20)] + [(99, "a b", None)], "doc_id long, text string, first int")
    rows = packing.pack(df, tokenizer(), tokens=32, segments=8, loss=12, loss_from="first").collect()
    assert sum(r["loss_tokens"] for r in rows) == 20 * 6 + 3
    per = defaultdict(int)
    for r in rows:
        per[r["sequence_id"]] += r["loss_tokens"]
    assert max(per.values()) <= 12


# line dedup


def brute_lines(rows, least):
    found = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if w := [x for x in re.split("[\x20\x09-\x0d]+", line) if x]:
                found.append(((-1 if i is None else i, k), w))
    found.sort()

    def near(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < least:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = Counter()
    for own, w in found:
        first = next(o for o, v in found if o <= own and near(v, w))
        out[(*own, len(w), first == own, *first)] += 1
    return out


def test_lines(spark, docs, odd):
    rng = np.random.default_rng(4)
    base = [[f"w{k}" for k in rng.integers(0, 50, n)] for n in (3, 7, 8, 9, 12, 20)]
    rows = []
    for i in range(60):
        w = list(base[rng.integers(0, 6)])
        at = int(rng.integers(0, len(w)))
        for _ in range(rng.integers(0, 3)):
            kind = rng.integers(0, 3)
            if kind == 0:
                w[at % len(w)] = f"n{rng.integers(0, 3)}"
            elif kind == 1:
                w.insert(at, f"n{rng.integers(0, 3)}")
            else:
                del w[at % len(w)]
        rows.append((i // 3, " ".join(w)))
    joined = defaultdict(list)
    for i, line in rows:
        joined[i].append(line)
    made = spark.createDataFrame([(i, "\n".join(x)) for i, x in joined.items()], "doc_id long, text string")
    for df in (made, docs.limit(50), odd, odd.limit(0)):
        got = lines.dedup_lines(df)
        assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["line_no"], r["n_words"], r["kept"], -1 if r["first_id"] is None else r["first_id"], r["first_line"]) for r in got.collect()) == brute_lines(texts(df), lines.MIN_WORDS)


# licence scans


def brute_licences(rows, threshold):
    """All eight columns, from every line and every run of SPANS lines with a term."""
    import math

    terms = lambda t: [x for x in re.split("[^a-z0-9]+", t.lower()) if x]
    lines = [[terms(u) for u in (t or "").split("\n")] for _, _, t in rows]
    df, total = Counter(x for own in lines for u in own for x in set(u)), sum(map(len, lines))
    vector = lambda u: {x: c * (math.log((1 + total) / (1 + df[x])) + 1) for x, c in Counter(u).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(terms(t))) for name, t in [*licenses.TEMPLATES.items(), *((k, t) for k in licenses.TEMPLATES for t in licenses.NOTICES.get(k, ()))]]

    def best(units):
        out = []
        for span, k, u in units:
            if v := vector(u):
                scores = {}
                for name, w in templates:
                    scores[name] = max(scores.get(name, 0), round(sum(v[x] * w.get(x, 0) for x in v) / norm(v) / norm(w), 9))
                (top, name), (second, _) = sorted(((s, n) for n, s in scores.items()), reverse=True)[:2]
                if top >= threshold - 5e-10 and (second < threshold - licenses.MARGIN - 5e-10 or top - second >= licenses.MARGIN - 5e-10):
                    out.append((-top, span, k, name))
        return out

    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    is_file = lambda p: p.rsplit("/", 1)[-1].lower().split(".")[0] in licenses.LICENCE_NAMES
    own, stated = [], {}
    for (_, p, _), own_lines in zip(rows, lines, strict=True):
        found = best([(1, k, u) for k, u in enumerate(own_lines)])
        full = [(k, u) for k, u in enumerate(own_lines) if u]
        if not any(f[0] <= -1 for f in found):
            found += best([(n, full[i][0], sum((u for _, u in full[i : i + n]), [])) for i in range(len(full)) for n in sorted({min(n, len(full) - i) for n in licenses.SPANS}) if n > 1])
        own.append(min(found, default=None))
        if own[-1] and is_file(p or ""):
            stated[folder(p or "")] = min(stated.get(folder(p or ""), (9, "", "")), (own[-1][0], p or "", own[-1][3]))
    out = Counter()
    for (i, p, _), f in zip(rows, own, strict=True):
        p = p or ""
        up = folder(p)
        while up and up not in stated:
            up = folder(up)
        if f:
            out[(i, p, f[3], round(-f[0], 6), f[2], f[3], "file" if is_file(p) else "header", folder(p) if is_file(p) else None)] += 1
        elif up in stated:
            out[(i, p, None, None, None, stated[up][2], "inherited", up)] += 1
        else:
            out[(i, p, None, None, None, None, "none", None)] += 1
    return out


def scanned(df):
    return Counter((r["doc_id"], r["path"], r["own_license"], None if r["own_score"] is None else round(r["own_score"], 6), r["own_line"], r["license"], r["via"], r["license_dir"]) for r in df.collect())


def test_licences(spark, docs):
    notice = licenses.NOTICES
    files = [
        (1, "a/LICENSE", "Hello\nReleased under the MIT License."), (2, "a/b/c/x.py", "no words here"), (3, "a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/y.py", "# All rights reserved.\ncode"), (5, "z/x", None), (6, "top", ""), (7, "a/b/c/d/e", "This work is licensed under the GNU General Public License, version 3."),
        (8, "ab/x", "the license of the version"), (9, "z/NOTICE", "nothing at all"), (10, "z/y", "Licensed under CC BY-NC 4.0."), (1, "a/LICENSE", "other words"), (1, "a/LICENSE", "other words"), (None, None, "plain"), (11, None, "Released under the MIT License"),
        (12, "m/LICENSE", "\n\n".join(notice["MIT"][1].split(", "))), (13, "m/copy", "\n\n".join(notice["MIT"][1].split(", "))), (14, "g/h.c", "int x;\n" + notice["GPL-3.0"][0].replace(". ", ".\n").replace(", ", ",\n * ") + "\nint y;"), (15, "g/COPYING", "word " * 3000 + "\nAll rights reserved"),
    ]
    made = spark.createDataFrame([(*f, "x", 1) for f in files], "doc_id long, path string, text string, term string, line int")
    got = licenses.scan(made)
    assert scanned(got) == brute_licences(files, 0.8)
    found = {(r["doc_id"], r["path"]): r["license"] for r in got.collect()}
    assert found[(2, "a/b/c/x.py")] == "Apache-2.0" and found[(12, "m/LICENSE")] == "MIT" and found[(14, "g/h.c")] == "GPL-3.0" and found[(8, "ab/x")] is None
    table = docs.where("length(text) < 6000").select("doc_id", F.concat_ws("/", "source", F.concat(F.lit("LICENSE."), "doc_id")).alias("path"), "text")
    assert scanned(licenses.scan(table)) == brute_licences([tuple(r) for r in table.collect()], 0.8)
    assert licenses.scan(made.limit(0)).count() == 0


def test_licences_ordinary_word(spark):
    """A term outside the templates weighs by its own document frequency: an ordinary word costs a licence line little, at any size of the corpus."""
    import math

    split = lambda t: [x for x in re.split("[^a-z0-9]+", t.lower()) if x]
    for n in (30, 3000):
        lines = [f"thtion plain{k}" if k % 2 else f"plain{k}" for k in range(n)] + ["Released under the MIT License thtion", "Released under the MIT License qqqq"]
        df = Counter(x for t in lines for x in set(split(t)))
        weigh = lambda x: math.log((1 + len(lines)) / (1 + df[x])) + 1  # noqa: B023, E731
        vector = lambda t: {x: c * weigh(x) for x, c in Counter(split(t)).items()}  # noqa: B023, E731
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        w = vector(licenses.TEMPLATES["MIT"])
        want = {k: sum(x * w.get(t, 0) for t, x in v.items()) / norm(v) / norm(w) for k, v in ((k, vector(lines[k])) for k in (n, n + 1))}
        made = spark.createDataFrame([(k, f"a/{k}.txt", t) for k, t in enumerate(lines)], "doc_id long, path string, text string")
        got = {r["doc_id"]: (r["own_license"], r["own_score"]) for r in licenses.scan(made, threshold=0.7).where("own_license is not null").collect()}
        assert {k: x for k, (x, _) in got.items()} == {k: "MIT" for k, s in want.items() if s >= 0.7}
        assert want[n] > 0.95 and all(abs(s - want[k]) < 1e-6 for k, (_, s) in got.items())


def test_licences_wrapped(spark):
    """Headers and licence files wrapped over lines, SPDX lines, and rows that share id and path."""
    wrap = lambda text, n, lead="": "\n".join(lead + " ".join(w) for w in (text.split()[k : k + n] for k in range(0, len(text.split()), n)))
    notice = {k: v[0] for k, v in licenses.NOTICES.items() if v}
    files = [
        (1, "a/x.py", "#!/usr/bin/env python\n# SPDX-License-Identifier: MIT\nimport os"),
        (2, "b/y.py", wrap(notice["Apache-2.0"], 12, "# ").replace("you may", "\n#\n# you may") + "\n\nimport os\nprint(os)"),
        (3, "c/LICENSE", "Copyright 2021 Example\n\n" + wrap(licenses.NOTICES["MIT"][1], 11) + "\n\nThe above copyright notice shall stay"),
        (4, "c/d/z.py", "print(1)"),
        (5, "e/w.c", wrap(notice["GPL-3.0"], 10, " * ") + "\nint main() {}"),
        (6, "f/v.c", "Licensed under the\nApache License, Version 2.0"),
        (7, "g/u.c", "The MIT License (MIT)"),
        (10, "i/LICENSE", wrap(licenses.NOTICES["BSD-2-Clause"][0], 9)), (11, "j/LICENSE", wrap(licenses.NOTICES["BSD-3-Clause"][0], 9)), (12, "k/a.c", "/* SPDX-License-Identifier: GPL-2.0-only */"), (13, "k/b.c", "// SPDX-License-Identifier: (Zlib+ OR MIT)"), (14, "k/c.c", "# SPDX-License-Identifier:"),
        (15, "l/LICENSE", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n"), (16, "m/COPYING", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"), (17, "n/LICENSE", "ISC License\n\n" + wrap(licenses.NOTICES["ISC"][1], 10)), (18, "o/UNLICENSE", licenses.TEMPLATES["Unlicense"]),
        (19, "q/x.c", wrap(notice["GPL-2.0"], 10, " * ")), (20, "r/x.c", "This work is licensed under the GNU General Public License, version 7"), (21, "s/x.c", wrap(notice["AGPL-3.0"], 10, " * ")), (22, "t/x.c", wrap(notice["LGPL-3.0"], 10, " * ")),
        (8, "h/same.c", "Released under the MIT License"),
        (8, "h/same.c", "nothing is said here"),
        *[(100 + k, f"p/{k}.txt", f"plain words number {k}\nof the file {k} and of no other") for k in range(300)],
    ]
    got = Counter((r["doc_id"], r["license"], r["via"]) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).where("doc_id < 100").collect())
    assert got == Counter([(1, "MIT", "header"), (2, "Apache-2.0", "header"), (3, "MIT", "file"), (4, "MIT", "inherited"), (5, "GPL-3.0", "header"), (6, "Apache-2.0", "header"), (7, "MIT", "header"), (8, "MIT", "header"), (8, None, "none"),
        (10, "BSD-2-Clause", "file"), (11, "BSD-3-Clause", "file"), (12, "GPL-2.0", "header"), (13, "Zlib", "header"), (14, None, "none"), (15, "GPL-2.0", "file"), (16, "AGPL-3.0", "file"), (17, "ISC", "file"), (18, "Unlicense", "file"),
        (19, "GPL-2.0", "header"), (20, None, "none"), (21, "AGPL-3.0", "header"), (22, "LGPL-3.0", "header")])


# queries: each is run whole on the smallest tables


def test_op2_query(spark, sf, docs):
    rows = texts(docs)
    want = Counter((i, len((t or "").encode()), removed, spans, hashlib.sha256(kept).hexdigest()) for (i, t), (removed, spans, kept) in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 400), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op2_suffix_dedup"](spark, sf).collect()) == want


def test_op3_query(spark, sf, docs):
    assert Counter(map(tuple, QUERIES["op3_ngram_jaccard"](spark, sf).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(texts(docs), 3, 90, 100)


def test_op1_op5_queries(spark, sf, docs):
    language = QUERIES["op1_language_id"](spark, sf).collect()
    assert {r["doc_id"] for r in language} == {i for i, _ in texts(docs)} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in language)
    toxic = QUERIES["op5_toxicity"](spark, sf).collect()
    assert {r["doc_id"] for r in toxic} == {i for i, _ in texts(docs)} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in toxic)


def test_op7_query(spark, sf, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    whole = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts(docs)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op7_packing"](spark, sf).collect():
        ids = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    gapless = lambda parts: [p for p, _ in sorted(parts)] == np.concatenate(([0], np.cumsum([n for _, n in sorted(parts)])[:-1])).tolist()
    assert set(pieces) == set(whole) and all(gapless(p) and sum(n for _, n in p) == len(whole[i]) for i, p in pieces.items())
    assert all(gapless(p) and sum(n for _, n in p) <= 2048 for p in sequences.values())


def test_op8_query(spark, sf, docs):
    rows = [(r["doc_id"], f"{r['source']}/{r['lang']}/{r['doc_id'] % 50}/" + (f"LICENSE.{r['doc_id']}" if len(r["text"]) < 400 and "licen" in r["text"].lower() else f"{r['doc_id']}.txt"), r["text"]) for r in docs.where("length(text) < 6000").collect()]
    got = scanned(licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")))
    assert got == brute_licences(rows, 0.8)
    assert QUERIES["op8_license_scan"](spark, sf).count() == docs.count()


def test_query_columns(spark, sf):
    want = {
        "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op2_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, "op3_ngram_jaccard": {"doc_id", "n_shingles", "component_id"},
        "op4_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}, "op6_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
        "op7_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op9_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    }
    for name, columns in want.items():
        assert columns <= set(QUERIES[name](spark, sf).columns)
    assert set(ORACLE_SQL) <= set(QUERIES)


# quality rules


def brute_quality(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if seen[x] > 1 for d in range(3)}
    n, chars, symbols, dup, repeat = len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)
    base = n < 50 or 100 * repeat > 50 * n
    lettered = sum(bool(re.search("[A-Za-z\x80-\U0010ffff]", x)) for x in w)
    bullets = sum(bool(re.match("[\x20\x09-\x0d]*[-*•]", x)) for x in lines)
    dots = sum(bool(re.search("(\\.\\.\\.|…)[\x20\x09-\x0d]*$", x)) for x in lines)
    top = max(Counter(w).values(), default=0)
    bad = 10 * symbols > n or chars < 3 * n or chars > 10 * n or 100 * lettered < 80 * n or 100 * dup > 50 * len(lines) or 100 * bullets > 90 * len(lines) or 100 * dots > 30 * len(lines) or 100 * top > 30 * n
    return n, chars, symbols, dup, repeat, base, not (base or bad)


@pytest.fixture(scope="module")
def judged(spark, odd):
    """Texts that each rule rejects, and texts at its bound."""
    plain = [f"wort{k}" for k in range(60)]
    say = lambda words, by=" ": by.join(words)
    texts = [
        say(plain), say(plain[:50]), say(plain[:49]), say(plain) + " ####", say(plain) + " #######", say([f"a{k}" for k in range(60)]), say([f"abcdefghijk{k:02}" for k in range(60)]), say([str(1000 + k) for k in range(15)] + plain[:45]),
        say(["one line"] * 40 + plain, "\n"), say(["- " + x for x in plain], "\n"), say(["-" + x for x in plain], "\n"), say(["• " + x for x in plain[:50]] + plain[50:54], "\n"), say([x + "..." for x in plain[:40]] + plain[40:], "\n"), say([x + "…\t" for x in plain], "\n"),
        say(["x"] * 30 + plain), say(plain + plain), say(plain[:30] * 2 + plain), "\n" * 90, say(["ü" * 9, "日本"] * 2 + plain), say(plain, "\x0b"), say(plain) + "\n" + say(plain[:20]) + "\n\n" + say(plain[:20]) + "\n" + say(plain[:20]) + " ",
    ]
    rows = [(100 + k, t) for k, t in enumerate(texts)]
    return odd.select("doc_id", "text", "h").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


def test_quality(docs, judged):
    for df in (judged, docs, judged.limit(0)):
        got = Counter(tuple(r)[:8] for r in quality.judge(df).drop("failed_rule").collect())
        assert got == Counter((i, *brute_quality(t)) for i, t in texts(df))
    rejected = {r["failed_rule"] for r in quality.judge(judged).collect()}
    assert rejected >= {None, "few_words", "repeated_windows", "symbols", "word_length", "letters", "bullets", "ellipses", "one_word"}


def test_quality_order(spark, judged):
    """The order follows from rejections per cost among what is left; no order changes what is kept, and rules see only what passed those before."""
    slow = quality.Rule("slow", lambda t: (sum(range(200_000)) < 0) | (t.n_words < 60))
    rules = [slow, quality.Rule("quick", lambda t: t.n_words < 60), quality.Rule("never", lambda t: t.n_words < 0)]
    found = quality.estimate(judged, rules)
    assert [e.name for e in found][0] == "quick" and {e.name: e.rejected for e in found}["slow"] == 0 and found[0].worth > 0
    kept = [quality.judge(judged, quality.RULES, order=order).select("doc_id", "kept").orderBy("doc_id").collect() for order in ([r.name for r in quality.RULES], [r.name for r in quality.RULES][::-1])]
    assert kept[0] == kept[1]
    with pytest.raises(ValueError):
        quality.judge(judged, order=["symbols"])
    assert [e.name for e in quality.estimate(judged.limit(0))] == [r.name for r in quality.RULES]
    assert len(quality.estimate(judged, sample_rows=5)) == len(quality.RULES)


# periodic runs


def brute_runs(w, times, least):
    found = {}
    for p in range(1, len(w) // times + 1):
        k = 0
        while k + p < len(w):
            start = k
            while k + p < len(w) and w[k] == w[k + p]:
                k += 1
            if (size := k - start + p) >= max(least, times * p) and k > start:
                found.setdefault((start, size), p)
            k += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("times,least", [(4, 6), (3, 3), (5, 1), (4, 10)])
def test_find_runs(times, least):
    rng = np.random.default_rng(times * 100 + least)
    for _ in range(300):
        words_ = []
        for _ in range(int(rng.integers(1, 6))):
            w = rng.integers(0, rng.choice([1, 2, 3, 9]), int(rng.integers(0, 80)))
            if len(w) > 9 and rng.random() < 0.5:
                s, p = int(rng.integers(0, len(w))), int(rng.integers(1, 7))
                for i in range(s + p, len(w)):
                    w[i] = w[i - p]
            words_.append(w.astype(np.int64))
        for w, found in zip(words_, runs.find_runs(words_, times=times, least=least), strict=True):
            assert [tuple(r) for r in found.tolist()] == brute_runs(w.tolist(), times, least)


def test_extensions():
    rng = np.random.default_rng(5)
    for values in (rng.integers(0, 2, 90), np.zeros(64, int), np.arange(40), np.tile(rng.integers(0, 5, 7), 9)):
        e, n = runs.Extensions(values), len(values)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        for a, b, got in zip(i, j, e.lce(i, j), strict=True):
            want = next((k for k in range(n - max(a, b)) if values[a + k] != values[b + k]), n - max(a, b))
            assert got == want


def test_periodic_runs(spark, docs, odd):
    more = [(200, "a b " * 50), (201, "x " * 7), (202, "x " * 5), (203, "p q r s p q r s p q r s p q r s t"), (204, "z\n" * 12 + " ".join(f"w{k}" for k in range(30)) + " é" * 9), (205, " ".join(["u", "v"] * 6 + ["u", "u"] * 4)), (206, LONG + " " + " ".join(["k l m"] * 40)), (None, "n " * 9)]
    df = odd.select("doc_id", "text", "norm").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    for rows in (df, docs, df.limit(0)):
        want = Counter()
        for i, t in texts(rows):
            w = re.findall("[^\x20\x09-\x0d]+", t or "")
            r = brute_runs(w, 4, 6)
            best = min(r, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
            want[i, len(w), tuple(r), best, brute_collapsed(w, r)] += 1
        got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["best"] and tuple(r["best"]), r["collapsed"]) for r in runs.periodic_runs(rows).collect())
        assert got == want
    assert all(r["n_runs"] == len(r["runs"]) for r in runs.periodic_runs(df).collect())


def test_strongest():
    assert runs.strongest(np.zeros((0, 3), int)) is None
    assert runs.strongest(np.array([[0, 12, 3], [5, 8, 2], [9, 40, 10]])) == (0, 12, 3)
    big = 3 * 10**15
    assert runs.strongest(np.array([[0, big, 10**15], [1, big + 1, 10**15]])) == (1, big + 1, 10**15)


# phrases


def brute_phrases(rows, longest, least, top, subsume):
    counts = defaultdict(Counter)
    for lang, t in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(w[s : s + k]) for s in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= subsume * a and any(q[s : s + len(p)] == p for s in range(len(q) - len(p) + 1)) for q, b in frequent.items()):
                continue
            low, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-low, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -low) for rank, (low, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest,least,top,subsume,cells", [(5, 3, 2000, 100, 1 << 26), (5, 3, 7, 100, 1 << 14), (3, 2, 50, 60, 1 << 14), (2, 5, 2000, 100, 1 << 26)])
def test_phrases(spark, docs, odd, longest, least, top, subsume, cells, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50)
    df = odd.select("doc_id", "text", "lang").unionByName(docs.select("doc_id", "text", "lang").limit(60))
    for rows in (df, df.limit(0)):
        got = phrases.collocations(rows.withColumn("n", F.lit(1)).withColumn("phrase", F.lit("x")), longest=longest, min_count=least, top=top, subsume=subsume, max_cells=cells)
        assert sorted(map(tuple, got.collect())) == brute_phrases([(r["lang"], r["text"]) for r in rows.select("lang", "text").collect()], longest, least, top, subsume)


def test_phrases_odd(spark):
    """Cases of letters, blanks and pieces, a word as long as a page, phrases that repeat within themselves, and a hot language."""
    rows = [("a", "Big  RED\tdog. big red dog;big red dog big red dog"), ("a", "x x x x x x"), (None, "big red\x0bbig red"), ("", "é ü é ü!é ü"), ("a", "w" * 3000 + " y " + "w" * 3000 + " y"), *[("hot", "one two three")] * 40]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(df, min_count=2)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 5, 2, 2000, 100)


def test_sketch():
    """Counts stop at the limit, alone and in sums, and are never too low before it."""
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**64, 5000, np.uint64)
    drawn = hashes[rng.zipf(1.3, 60_000) % 5000]
    for limit, kind in ((100, np.uint8), (300, np.uint16)):
        sketch = phrases.Sketch(1 << 14, limit)
        assert sketch.table.dtype == kind
        for part in np.array_split(drawn, 7):
            sketch.add(part)
            sketch.settle()
        values, seen = np.unique(drawn, return_counts=True)
        for row in range(phrases.ROWS):
            told = sketch.table[row, phrases.Sketch.cells(values, row, 14)]
            assert (told >= np.minimum(seen, limit)).all() and told.max() == limit


# long words


def test_long_words(spark):
    """Words that a polynomial modulo a power of two cannot tell apart, through the hashes of the near-duplicate join, decontamination and packing."""
    from tokenizers import Tokenizer

    from reelgrid.llm.arrays import same_spans, span_hashes, span_ids

    def pair(n):
        word = "a"
        while len(word) < n:
            word += word.translate(str.maketrans("ab", "ba"))
        return word, word.translate(str.maketrans("ab", "ba"))

    rows, k = [], 0
    for n in (1024, 2048, 4096):
        for word in pair(n):
            rows.append((k, word))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.near_duplicates(df, shingle=3, num=90, den=100).collect()} == set(range(k))
    bench = spark.createDataFrame([("one", rows[2][1])], "item_id string, text string")
    assert [r["doc_id"] for r in decontam.decontaminate(df, bench).where("contaminated").collect()] == [2]
    plain = Tokenizer.from_file(tokenizer())
    packed = packing.pack(df, tokenizer(), with_ids=True).collect()
    ids = defaultdict(list)
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["start"])):
        ids[r["doc_id"]] += r["ids"]
    assert dict(ids) == {i: plain.encode(t, add_special_tokens=False).ids + [1] for i, t in rows}
    data = np.frombuffer(b"abc abd abc abcabc" + b"x" * 70 + b" " + b"x" * 69 + b"y", np.uint8)
    starts, ends = np.array([0, 4, 8, 12, 18, 89]), np.array([3, 7, 11, 18, 88, 159])
    assert span_ids(data, starts, ends)[0].tolist() == span_ids(data, starts, ends, np.zeros(6, np.uint64))[0].tolist() or len(set(span_ids(data, starts, ends)[0])) == 5
    clashing, places = span_ids(data, starts, ends, np.zeros(6, np.uint64))
    assert clashing.tolist() == [0, 1, 0, 2, 3, 4] and places.tolist() == [0, 1, 3, 4, 5]
    assert same_spans(data, starts, ends, starts[[2, 0, 0, 3, 5, 5]], ends[[2, 0, 0, 3, 5, 5]]).tolist() == [True, False, True, True, False, True]
    assert len(set(span_hashes(data, starts, ends).tolist())) == 5


def test_windows_size():
    """A block's windows take some hundred bytes each, and equal windows of several items are one."""
    import pickle

    rng = np.random.default_rng(2)
    items = [(str(k), " ".join(f"w{x}" for x in rng.integers(0, 5000, 200))) for k in range(500)] + [("again", None)]
    items.append(("same", items[3][1]))
    block = decontam.Windows(items, 10)
    block.order({n: np.zeros(len(v), np.int64) for n, v in block.vocabulary.items()})
    assert len(block) == 500 * 191 and len(pickle.dumps(block)) < 100 * len(block)
    assert sorted(block.items[i] for i in block.owners[block.owner_of[0] : block.owner_of[1]]) in [[str(k)] for k in range(500)] + [["3", "same"]]
    assert sum(np.diff(block.owner_of) == 2) == 191


def test_toxicity_rows(spark):
    """The bound of a fit is one of rows, also where one id has them all."""
    rows = spark.range(400).select(F.lit(7).alias("id"), (F.col("id") % 2).cast("int").alias("y"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    taken = []
    original = toxicity.train
    toxicity.train = lambda data, labels, share, **k: taken.append(len(data)) or original(data, labels, share, **k)
    try:
        toxicity.fit(rows, id_col="id", text_col="text", label_col="y", fit_rows=20)
    finally:
        toxicity.train = original
    assert taken == [40]


def test_new_queries(spark, sf, docs):
    """The thin queries give their contracts' columns, whole tables, and the digests of what the operators give."""
    found = QUERIES["op12_periodic_runs"](spark, sf)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = {}
    for i, t in texts(docs):
        w, h = re.findall("[^\x20\x09-\x0d]+", t or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        r = brute_runs(w, 4, 6)
        best = min(r, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[i] = (len(r), *best, 1000 * best[1] // best[2] if r else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in r)), digest(brute_collapsed(w, r)))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == want
    assert QUERIES["op11_quality_rules"](spark, sf).columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert QUERIES["op13_phrases"](spark, sf).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_shuffles_go_with_their_query(spark, tmp_path):
    """A written step leaves no shuffle files behind; a frame that is asked twice gives its rows twice."""
    from reelgrid.session import written

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = lambda: {str(p) for p in (manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size())) if p.startswith("shuffle_")}
    before = blocks()
    written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        if not blocks() - before:
            break
        time.sleep(0.1)
    assert not blocks() - before
    twice = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(twice.collect()) == sorted(twice.collect())


def test_jaccard_without_broadcast(spark, monkeypatch):
    """Texts of regions are the same by a semi-join of their hashes and without it; others are not shuffled."""
    rows = [(i, f"w{i // 3} " + " ".join(f"x{i // 3}y{j}" for j in range(40)) + (" z" if i % 3 == 2 else "")) for i in range(60)] + [(100 + i, " ".join(f"u{i}v{j}" for j in range(30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with_keys = Counter(map(tuple, jaccard.near_duplicates(df, shingle=3, num=80, den=100).collect()))
    monkeypatch.setattr(jaccard, "MAX_KEYS", 0)
    assert with_keys == Counter(map(tuple, jaccard.near_duplicates(df, shingle=3, num=80, den=100).collect())) == brute_components(rows, 3, 80, 100)


def test_op12_wordless(spark, tmp_path):
    """Documents that would be planted but have no word."""
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    spark.createDataFrame(list(zip(ids, ["", None, " \n\t", "a b"], strict=True)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["collapsed_sha256"]) for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert set(got) == set(ids) and all(got[i] == (0, None, hashlib.sha256(b"").hexdigest()) for i in ids[:3])
