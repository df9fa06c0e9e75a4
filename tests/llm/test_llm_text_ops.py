"""The numbered operators against brute force on small tables with nulls, ties, repeats and long texts."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, fmindex, html, jpeg, langid, lm, media, sharding, simhash, suffixes
from tessera.llm import blocks as B
from tessera.llm import text as T
from tessera.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def fixture_rows() -> list[tuple]:
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, licence = prose(80), prose(45)
    rows = [prose(rng.randint(1, 120)) for _ in range(30)]
    rows += [rows[0]] * 4 + [rows[1] + " more"] * 2
    rows += [f"{prose(20)} {passage} {prose(15)}", f"{prose(9)}\n{passage}  {prose(5)}", passage]
    rows += [f"{prose(12)} {licence} {prose(rng.randint(1, 30))}" for _ in range(12)]
    near = passage.split()
    for i in (3, 30, 60):
        near[i] = "changed"
        rows.append(" ".join(near))
    rows += [None, "", " \n\t ", "!!! 123", "é世界 ñ", "a" * 5000, "ab " * 3000, prose(4000), "x", "one two three"]
    return [(i * 3, t, f"s{i % 2}", None if i % 9 == 0 else "en") for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns with names that operators use themselves
    return spark.createDataFrame([(*r, 1, "y", 2) for r in rows], "doc_id long, text string, source string, lang string, block int, part string, slot int").repartition(5)


def words(t):
    return WORD.findall((t or "").encode())


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


# helpers


@given(st.lists(st.binary(max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_and_hashes(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    starts, ends, first = T.words(data, off)
    got = [[data[starts[k] : ends[k]].tobytes() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t) for t in texts]
    h = T.span_hash(data, starts, ends)
    flat = [w for ws in got for w in ws]
    assert len(set(h.tolist())) == len(set(flat))


@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=5), st.integers(1, 4), st.integers(0, 6))
@settings(max_examples=80, deadline=None)
def test_equal_windows_have_equal_anchors(texts, k, more):
    window = k + more
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    gram, at, lo, hi = T.anchors(data, off, k, window)
    owned = {s: (g, a - s) for g, a, l, h in zip(gram.tolist(), at.tolist(), lo.tolist(), hi.tolist()) for s in range(l, h + 1)}
    starts = [s for i in range(len(texts)) for s in range(off[i], off[i + 1] - window + 1)]
    assert sorted(owned) == starts  # each window of a text has one anchor
    seen = {}
    for s in starts:
        assert seen.setdefault(data[s : s + window].tobytes(), owned[s]) == owned[s]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1


def test_sharding(spark, docs, rows):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    for limit in (10, 100_000):
        got = sharding.assign_shards(docs, "doc_id", 8, rows_per_range=limit).collect()
        assert all(r["shard"] == jump(r["doc_id"], 8) and r["grown_shard"] == jump(r["doc_id"], 9) for r in got)
        assert len(got) == len(rows) and got[0]["block"] == 1
        by = collections.defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    hot = spark.createDataFrame([(None, i) for i in range(20)] + [(5, i) for i in range(50)], "k long, v int")
    slots = sharding.assign_shards(hot, "k", 3, rows_per_range=7).groupBy("shard").agg(F.max("slot"), F.countDistinct("slot"), F.count("*")).collect()
    assert all(r[1] + 1 == r[2] == r[3] for r in slots) and sum(r[3] for r in slots) == 70
    assert sharding.assign_shards(hot.limit(0), "k", 3).count() == 0
    assert sharding.assign_shards(hot.select(F.col("v").cast("string").alias("k")), "k", 3).count() == 70


# 2 and 5


@pytest.mark.parametrize(("hot", "block_bytes", "window", "fan"), [(10**6, 4 << 20, 100, 8), (2, 3000, 100, 8), (3, 20_000, 40, 8192), (10**6, 3000, 20, 8192), (10**6, 20_000, 400, 1)])
def test_byte_dedup(docs, rows, hot, block_bytes, window, fan):
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs, window, hot=hot, block_bytes=block_bytes, fan=fan).collect()}
    seen = set()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if b[s : s + window] in seen:
                gone[s : s + window] = True
            seen.add(b[s : s + window])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(b), int(gone.sum()), spans, kept), i
    assert len(got) == len(rows)


@pytest.mark.parametrize(("hot", "block_bytes", "window", "fan"), [(10**6, 4 << 20, 35, 8), (2, 3000, 35, 8), (3, 20_000, 10, 8192), (10**6, 3000, 5, 1)])
def test_word_dedup(docs, rows, hot, block_bytes, window, fan):
    got = {r["doc_id"]: r for r in fmindex.remove_repeats(docs, window, hot=hot, block_bytes=block_bytes, fan=fan).collect()}
    count = collections.Counter(tuple(w[s : s + window]) for w in (words(t) for _, t, *_ in rows) for s in range(len(w) - window + 1))
    for i, t, *_ in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), int(gone.sum()), kept), i


def test_blocks_keep_their_size(spark):
    """Ten times the texts make ten times the blocks, and no larger ones."""
    text = F.repeat(F.lit("some words "), 50)
    largest = []
    for n in (400, 4000):
        df = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
        count = B.block_count(df, "text", 11_000)
        assert count == n * 550 // 11_000
        largest.append(B.deal(df, "doc_id", "text", count).groupBy("block").agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0])
    assert largest[1] < 1.5 * largest[0] < 60_000


@pytest.mark.parametrize("fan", [100, 3])
def test_look_ups_add_up(spark, fan):
    """Sums of two spaces of keys over blocks, directly and by way of groups."""
    rng = random.Random(9)
    rows = [(b, rng.randrange(40)) for b in range(10) for _ in range(60)]
    df = spark.createDataFrame([(b, b, str(k)) for b, k in rows], "block int, id long, text string")
    hashed = lambda k: T.mix(np.array(k, np.uint64) + T.U64(1))

    def keys_of(table):
        k = np.array([int(x) for x in table.column("text").to_pylist()])
        out = []
        for bits, values in ((64, hashed(k)), (20, hashed(k % 7) >> T.U64(44))):
            distinct, counts = np.unique(values, return_counts=True)
            out.append(B.Keys(distinct, [counts.astype(np.uint32)], bits))
        return out

    found = B.look_up(df, 10, keys_of, [1, 1], [64, 20], lambda space, sums: [sums[0], sums[0] * 2], lambda spaces: [len(x[0]) for x in spaces], lambda block: [True, block % 2 == 0], fan)
    assert found.agg(F.sum(F.col("sums")[0]), F.sum(F.col("sums")[1])).first()[:] == (len({k for _, k in rows}), 7)
    total, weekly = collections.Counter(k for _, k in rows), collections.Counter(k % 7 for _, k in rows)
    for block in range(10):
        own = sorted({k for b, k in rows if b == block}, key=lambda k: int(hashed([k])[0]))
        days = sorted({k % 7 for k in own}, key=lambda k: int(hashed([k])[0] >> T.U64(44)))
        parts = [B.split_parts(r["data"]) for r in found.where(F.col("block") == block).orderBy("part").collect()]
        column = lambda n: [int(x) for p in parts for x in (B.unpack(p[n]) if p[n] else [])]
        assert column(0) == [total[k] for k in own] and column(2) == [weekly[k] for k in days]
        assert column(1) == ([2 * total[k] for k in own] if block % 2 == 0 else [])


def test_dedup_of_nothing(spark, docs):
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
    assert fmindex.remove_repeats(docs.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in suffixes.remove_repeats(null, 5).collect()} == {None}


@given(st.lists(st.lists(st.binary(max_size=12), max_size=12), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_loser_tree_merge(runs):
    runs = [sorted(set(r)) for r in runs]
    coded = []
    for r in runs:
        shared, rest = suffixes.front_code(r) if r else (np.zeros(0, int), b"")
        assert suffixes.front_decode(np.array([len(x) for x in r], int), shared, rest) == r
        coded.append((r, shared.tolist()))
    run, at, shared = suffixes.merge_runs(coded)
    merged = [coded[a][0][b] for a, b in zip(run, at)]
    assert merged == sorted(x for r in runs for x in r)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert shared[1:] == [common(a, b) for a, b in zip(merged, merged[1:])]


@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_fm_index(seqs):
    text = np.array([x for s in seqs for x in [*s, 0]])
    index = fmindex.FMIndex(text, np.ones(len(text), int), 4, 12)
    flat = [tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
    count = collections.Counter(flat)
    at = 0
    for s in seqs:
        for e in range(len(s) + 1):
            start = int(index.matching_statistics(np.array([at + e]), np.array([at]))[0]) - at
            assert start == next((i for i in range(e) if count[tuple(s[i:e])] > 1), e)
        at += len(s) + 1


# 3


def test_language_model(docs, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    column = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {r["doc_id"]: r for r in lm.score(docs, ~column).collect()}
    tokens = {i: [lower(w) for w in words(t)] + [None] for i, t, *_ in rows}
    count = collections.Counter(x for i, ws in tokens.items() if not held(i) for x in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[x] > 0 for x in ws), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 1e-9 and math.isfinite(r["score"])
    unseen = [r for i, r in got.items() if held(i)]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert lm.score(docs.limit(0), ~column).count() == 0
    assert all(math.isfinite(r["score"]) for r in lm.score(docs, F.lit(False)).collect())


def ngram_counts(tokens):
    """Counts of n-grams and their contexts, by plain dictionaries."""
    one, two, three, after1, after2 = (collections.Counter() for _ in range(5))
    for ws in tokens:
        seq = ["<s>", *ws]
        for i in range(1, len(seq)):
            one[seq[i]] += 1
            two[seq[i - 1], seq[i]] += 1
            after1[seq[i - 1]] += 1
            if i > 1:
                three[tuple(seq[i - 2 : i + 1])] += 1
                after2[tuple(seq[i - 2 : i])] += 1
    return one, two, three, after1, after2


def mixed(counts, weights, a, b, w):
    """The probability of token w after a and b (None: no token)."""
    one, two, three, after1, after2 = counts
    n, v = sum(one.values()), len(one)
    n2, n1 = after2[a, b] if a is not None else 0, after1[b]
    bucket = lambda c: min(math.ceil(math.log2(c + 1)), lm.BUCKETS) - 1
    x = weights[bucket(n2) if n2 else lm.BUCKETS + bucket(n1) if n1 else lm.SETS - 1]
    if not one[w]:
        return x[4]
    return x[0] * (three[a, b, w] / n2 if n2 else 0) + x[1] * (two[b, w] / n1 if n1 else 0) + x[2] * one[w] / n + x[3] / v


@pytest.mark.parametrize("fan", [8192, 4])
def test_scores_are_those_of_the_mixture(docs, rows, fan):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rng = np.random.default_rng(4)
    weights = rng.random((lm.SETS, 5)) * lm.ALLOWED
    weights /= weights.sum(1, keepdims=True)
    tokens = {i: [lower(w) for w in words(t)] + ["</s>"] for i, t, *_ in rows}
    counts = ngram_counts([ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    for r in lm.score(docs, ~held, fan=fan, weights=weights).collect():
        seq = [None, "<s>", *tokens[r["doc_id"]]]
        want = sum(math.log10(mixed(counts, weights, *seq[k : k + 3])) for k in range(len(seq) - 2))
        assert r["score"] == pytest.approx(want, abs=1e-6), r


def test_probabilities_sum_to_one(rows):
    counts = ngram_counts([[lower(w) for w in words(t)] + ["</s>"] for _, t, *_ in rows])
    cells = np.array([[3, 1, 50, 15.0, 20.0, 1.0], [3, 0, 10, 0, 0, 0], [50, 1, 30, 0, 2.0, 1.0], [lm.SETS - 1, 1, 5, 0, 0, 0.5]])
    weights = lm.mixture_weights(cells, 100)
    assert np.allclose(weights.sum(1), 1) and (weights[lm.ALLOWED > 0] > 0).all() and not weights[lm.ALLOWED == 0].any()
    one = counts[0]
    pairs = list(counts[4])
    for a, b in [(None, "<s>"), pairs[0], pairs[-1], max(counts[4], key=counts[4].get), ("never", pairs[5][1]), ("never", "seen")]:
        total = sum(mixed(counts, weights, a, b, w) for w in one) + mixed(counts, weights, a, b, "unknown")
        assert total == pytest.approx(1), (a, b)


def test_weights_are_those_of_em_over_single_tokens():
    """Cells of single tokens against plain expectation-maximisation."""
    rng = np.random.default_rng(5)
    p = rng.random((400, 3)) * [1, 0.3, 0.05]
    known = rng.random(400) < 0.9
    cells = np.column_stack([np.full(400, 2), known, np.ones(400), p * known[:, None]])
    got = lm.mixture_weights(cells, 50, rounds=20)[2]
    e = [[*x, 1 / 50, 0.0] if k else [0, 0, 0, 0, 1.0] for x, k in zip(p.tolist(), known.tolist())]

    def em(start):
        w = start
        for _ in range(20):
            total = list(start)
            for x in e:
                s = sum(a * b for a, b in zip(w, x))
                total = [t + a * b / s for t, a, b in zip(total, w, x)]
            w = [t / sum(total) for t in total]
        return w

    assert np.allclose(got, em(em([0.3, 0.3, 0.2, 0.1, 0.1])))


# 4


def fingerprint(t, k):
    w = [lower(x) for x in words(t)]
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize(("radius", "bucket"), [(4, 20_000), (4, 3), (9, 20_000), (20, 2), (0, 5)])
def test_simhash(docs, rows, radius, bucket):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, 4, radius, bucket=bucket).collect()}
    prints = {i: fingerprint(t, 4) for i, t, *_ in rows}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    for i, p in prints.items():
        assert int.from_bytes(got[i]["fp"], "big") == p and got[i]["component_id"] == find(i), i


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=600), st.integers(1, 300))
@settings(max_examples=30, deadline=None)
def test_majority(values, cut):
    h = np.array(values, np.uint64)
    off = np.array([0, min(cut, len(h)), min(cut, len(h)), len(h)])
    got = simhash.majority(h, off)[:, 0].tolist()
    want = [sum(1 << b for b in range(64) if sum(x >> b & 1 for x in values[a:z]) * 2 > z - a) if z > a else 0 for a, z in zip(off, off[1:])]
    assert got == want


def test_plans_miss_no_link():
    for n in (10, 10**5, 10**7, 10**10):
        for radius in (0, 3, 4, 8):
            tables = {(a, w): ball for a, w, ball, _ in simhash.plan(n, 64, radius)}
            assert sum(w for _, w in tables) == 64 and sum(tables.values()) == radius - len(tables) + 1


def test_similar_groups_keep_one_of_each(docs, rows):
    kept = {r["doc_id"] for r in simhash.keep_first(docs, simhash.similar_groups(docs)).collect()}
    first = {}
    for i, t, *_ in rows:
        first.setdefault(t if t and t.strip() else "", i)
    assert kept <= set(first.values()) and len(kept) >= len(first) - 8
    assert simhash.similar_groups(docs.limit(0)).count() == 0


# 6


@pytest.mark.parametrize("limits", [(1 << 16, 2048), (300, 20)])
def test_bpe(docs, rows, limits):
    t = bpe.Codec.load(TOKENIZER).tokenizer
    got = {r["doc_id"]: r for r in bpe.encode(docs, TOKENIZER, long_text=limits[0], long_word=limits[1]).collect()}
    digest = {r["doc_id"]: r for r in bpe.encode(docs, TOKENIZER, digests=True, long_text=limits[0], long_word=limits[1]).collect()}
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (list(got[i]["ids"]), got[i]["decoded"]) == (ids, decoded), i
        assert digest[i]["n_tokens"] == len(ids) and digest[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, TOKENIZER).select("doc_id", "ids", F.col("decoded").alias("want")), TOKENIZER)
    assert back.where("not want <=> decoded").isEmpty()


@given(st.text(st.sampled_from("abtheing é世!?'1.,A\n\x1c\x85<|>"), max_size=120), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_tree_concatenation(text, leaf):
    codec = bpe.Codec.load(TOKENIZER)
    out, leaves, last = [], [], -1
    for kind, piece, unit in codec.units(text, 50, leaf):
        if piece != last:
            out += codec.concatenate(leaves)
            leaves, last = [], piece
        if piece < 0:
            out += codec.ids_of(bpe.split_words(unit))
        else:
            leaves.append(codec.tokenize(unit))
    assert out + codec.concatenate(leaves) == codec.tokenizer.encode(text, add_special_tokens=False).ids


# 7


def test_language_id(spark):
    rng = random.Random(1)
    words_of = {"aa": ["banana", "mango", "salad", "canal"], "bb": ["zwyrk", "kwyz", "wyrd", "krzy"]}
    text = lambda lang, n: " ".join(rng.choice(words_of[lang]) for _ in range(n))
    rows = [(i, text(lang, 20), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(100, None, "aa"), (101, "123 !!", None), (102, "", None), (103, text("aa", 30) + " " + text("bb", 10), None), (104, text("bb", 4000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.predict(df, langid.train(df)).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["score"] > 0.9 for i, _, lang in rows[:80])
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "aa", "bb"]
    assert 0.6 < got[103]["score"] < 0.9 and "bb" in got[103]["lang_mix"]
    none = langid.train(df.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), none).count() == 0


# 8


def test_tiling_finds_reordered_parts():
    item = np.arange(1, 21).astype(np.uint64)
    doc = np.concatenate([[90, 91], item[10:], [92], item[:10], [93]]).astype(np.uint64)
    tiles = decontaminate.tile(doc, item, 5)
    assert sorted((b, n) for _, b, n in tiles) == [(0, 10), (10, 10)]
    assert decontaminate.tile(doc, item[:4], 5) == []


def plain_tiling(doc, item, shortest):
    """Greedy string tiling by its definition."""
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []

    def length(a, b):
        n = 0
        while a + n < len(doc) and b + n < len(item) and free_d[a + n] and free_i[b + n] and doc[a + n] == item[b + n]:
            n += 1
        return n

    while True:
        best = max((length(a, b) for a in range(len(doc)) for b in range(len(item))), default=0)
        if best < shortest:
            return tiles
        for a in range(len(doc)):
            for b in range(len(item)):
                if length(a, b) >= best:
                    tiles.append((a, b, best))
                    free_d[a : a + best] = free_i[b : b + best] = [False] * best


@given(st.lists(st.integers(1, 3), max_size=40), st.lists(st.integers(1, 3), max_size=25), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_tiling_is_greedy_string_tiling(doc, item, shortest):
    assert decontaminate.tile(np.array(doc, np.uint64), np.array(item, np.uint64), shortest) == plain_tiling(doc, item, shortest)


def test_tiling_of_repeated_words_is_fast():
    tiles = decontaminate.tile(np.full(10_000, 7, np.uint64), np.full(500, 7, np.uint64), 5)
    assert tiles == [(0, 0, 500)]


def test_decontamination_against_brute_force(spark):
    """Items whose parts stand in another order, ties and repeated words; a sieve that lets much through."""
    rng = random.Random(21)
    word = lambda: f"v{rng.randrange(12)}"
    items = [[word() for _ in range(rng.randint(3, 24))] for _ in range(12)] + [["same"] * 20]
    items += [items[0]]
    docs = []
    for n in range(60):
        parts = [[word() for _ in range(rng.randrange(12))]]
        for _ in range(rng.randrange(3)):
            it = rng.choice(items)
            cut = rng.randrange(len(it) + 1)
            parts += [it[cut:], [word()], it[:cut]]
        docs.append([w for p in parts for w in p])
    docs += [docs[0], docs[1], ["same"] * 300]
    d = spark.createDataFrame([(n, " ".join(w), n) for n, w in enumerate(docs)], "doc_id long, text string, covered int").repartition(4)
    i = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["covered"]), r["n_tiles"], r["longest"]) for r in decontaminate.leaks(d, i).collect()}
    want = {}
    for a, doc in enumerate(docs):
        for b, item in enumerate(items):
            tiles = plain_tiling(doc, item, decontaminate.SEED)
            if tiles and sum(t[2] for t in tiles) / len(item) >= decontaminate.COVERAGE:
                want[a, b] = (sum(t[2] for t in tiles) / len(item), len(tiles), max(t[2] for t in tiles))
    assert got == want and len(want) > 20


def test_decontamination(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [(i, prose(30)) for i in range(10)] + [(10, None), (11, "too short")]
    text = dict(items)
    swap = text[3].split()
    docs = [(0, prose(50)), (1, f"{prose(9)} {text[2].upper()} {prose(9)}"), (2, " ".join([*swap[15:], "x", *swap[:15]])), (3, " ".join(text[4].split()[:12])), (4, None), (5, ""), (6, f"{text[5]} {text[6]}"), (6, f"{text[5]} {text[6]}")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.judge(d, spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["contaminated"], r["n_items"], r["item_id"]) for r in found.collect()}
    assert got == {0: (False, 0, None), 1: (True, 1, 2), 2: (True, 1, 3), 3: (False, 0, None), 4: (False, 0, None), 5: (False, 0, None), 6: (True, 2, 5)}
    assert decontaminate.judge(d.limit(0), d.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


# 9


@given(st.binary(max_size=3000), st.sampled_from([(24, 24), (7, 3), (1, 1), (16, 2)]))
@settings(max_examples=40, deadline=None)
def test_frames_are_lossless(data, size):
    w, h = size
    x = np.frombuffer(data.ljust(-(-max(len(data), 1) // (w * h)) * w * h, b"\xff"), np.uint8)
    fps, frames = media.read_avi(media.to_avi(media.encode_frames(x, w, h), w, h))
    assert fps == 25 and (np.array(media.decode_frames(frames)).ravel() == x).all()


class BaselineWriter:
    """A plain baseline encoder with the standard tables, for tests."""

    def __init__(self):
        self.bits = []
        self.codes = {}
        for name, (counts, symbols) in jpeg.STANDARD.items():
            code = at = 0
            for n, count in enumerate(counts, 1):
                for _ in range(count):
                    self.codes[*name, symbols[at]] = format(code, f"0{n}b")
                    code, at = code + 1, at + 1
                code <<= 1

    def number(self, v):
        size = int(abs(v)).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def block(self, pixels, before, table, quant):
        c = np.rint(jpeg.COSINES @ (pixels.astype(float) - 128) @ jpeg.COSINES.T / quant).astype(int).ravel()[jpeg.ZIGZAG].tolist()
        size, text = self.number(c[0] - before)
        self.bits.append(self.codes[0, table, size] + text)
        run = 0
        for v in c[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                self.bits.append(self.codes[1, table, 0xF0])
                run -= 16
            size, text = self.number(v)
            self.bits.append(self.codes[1, table, run * 16 + size] + text)
            run = 0
        if run:
            self.bits.append(self.codes[1, table, 0])
        return c[0]

    def flush(self):
        text = "".join(self.bits)
        text += "1" * (-len(text) % 8)
        self.bits = []
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")

    def frame(self, planes, factors, width, height, restart=0, quant=1, tables=True):
        """planes: full-size components; factors: sampling of each."""
        segment = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
        out = b"\xff\xd8" + segment(0xFE, b"comment") + segment(0xDB, b"\0" + bytes([quant] * 64))
        if tables:
            for (kind, n), (counts, symbols) in jpeg.STANDARD.items():
                out += segment(0xC4, bytes([kind * 16 + n]) + counts + symbols)
        if restart:
            out += segment(0xDD, restart.to_bytes(2, "big"))
        parts = len(planes)
        out += segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([parts]) + b"".join(bytes([k + 1, h * 16 + v, 0]) for k, (h, v) in enumerate(factors)))
        out += segment(0xDA, bytes([parts]) + b"".join(bytes([k + 1, 17 * (k > 0)]) for k in range(parts)) + bytes([0, 63, 0]))
        across, down = max(h for h, _ in factors), max(v for _, v in factors)
        columns, lines = -(-width // (8 * across)), -(-height // (8 * down))
        scaled = []
        for p, (h, v) in zip(planes, factors):
            full = np.pad(p, ((0, lines * 8 * down - height), (0, columns * 8 * across - width)), mode="edge").astype(float)
            scaled.append(full.reshape(lines * 8 * v, down // v, columns * 8 * h, across // h).mean((1, 3)))
        last, marks = [0] * parts, 0
        for unit in range(lines * columns):
            if restart and unit and unit % restart == 0:
                out += self.flush() + bytes([0xFF, 0xD0 + marks % 8])
                last, marks = [0] * parts, marks + 1
            line, column = divmod(unit, columns)
            for k, (h, v) in enumerate(factors):
                for y in range(v):
                    for x in range(h):
                        a, b = (line * v + y) * 8, (column * h + x) * 8
                        last[k] = self.block(scaled[k][a : a + 8, b : b + 8], last[k], int(k > 0), quant)
        return out + self.flush() + b"\xff\xd9"


@pytest.mark.parametrize(("size", "restart", "tables"), [((16, 16), 0, True), ((37, 21), 2, True), ((8, 40), 1, False)])
def test_baseline_frames_in_grey(size, restart, tables):
    w, h = size
    rng = np.random.default_rng(w)
    pixels = rng.integers(0, 256, (h, w)).astype(np.uint8)
    got = jpeg.decode(BaselineWriter().frame([pixels], [(1, 1)], w, h, restart, tables=tables))
    assert got.shape == (h, w) and np.abs(got.astype(int) - pixels).max() <= 2


@pytest.mark.parametrize("factors", [[(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)]])
def test_baseline_frames_in_colour(factors):
    w, h = 45, 30
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    rgb = np.stack([2 * x + 40, 3 * y + 60, 200 - x - y], axis=-1).astype(float)
    luma = rgb @ [0.299, 0.587, 0.114]
    planes = [luma, 128 + (rgb[..., 2] - luma) / 1.772, 128 + (rgb[..., 0] - luma) / 1.402]
    got = jpeg.decode(BaselineWriter().frame(planes, factors, w, h, restart=3))
    assert got.shape == (h, w, 3) and np.abs(got - rgb).max() <= 6


def test_clips_of_a_camera(spark):
    """Baseline colour frames in an AVI: two scenes, cut where they change."""
    make = lambda level: BaselineWriter().frame([np.full((16, 24), level), np.full((16, 24), 100), np.full((16, 24), 150)], [(2, 2), (1, 1), (1, 1)], 24, 16)
    film = media.to_avi([make(40)] * 6 + [make(200)] * 5, 24, 16, fps=10)
    df = spark.createDataFrame([(1, film), (2, None), (1, film)], "doc_id long, media binary")
    rows = media.clips(df).orderBy("doc_id", "clip").collect()
    assert [(r["clip"], r["first_frame"], r["n_frames"], r["end_s"]) for r in rows] == [(0, 0, 6, 0.6)] * 2 + [(1, 6, 5, 1.1)] * 2
    with pytest.raises(ValueError):
        jpeg.decode(make(1).replace(b"\xff\xc0", b"\xff\xc2"))


def test_stored_form_and_feature(docs, rows):
    """media_bytes and media_sha256 are those of the stored column; equal texts have equal values."""
    stored = media.store(docs)
    held = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    got = {r["doc_id"]: r for r in media.read_back(stored).collect()}
    text = {i: t or "" for i, t, *_ in rows}
    by_text = {}
    for i, r in got.items():
        assert (r["media_bytes"], r["media_sha256"]) == (len(held[i]), hashlib.sha256(held[i]).hexdigest())
        _, frames = media.read_avi(held[i])
        pixels = np.array(media.decode_frames(frames))
        assert pixels.tobytes() == text[i].encode().ljust(max(1, -(-len(text[i].encode()) // 576)) * 576, b"\xff")
        cuts = media.shots(pixels)
        want = f"{len(frames)} frames, {len(cuts)} shots: " + ";".join(f"{a}-{b - 1}@{a / 25:.2f}s,{int(pixels[a:b].sum(dtype=np.int64) // pixels[a:b].size)}" for a, b in cuts)
        assert r["feature"] == want
        assert by_text.setdefault(text[i], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_media(docs, rows):
    stored = media.store(docs)
    got = {r["doc_id"]: r for r in media.read_back(stored).collect()}
    for i, t, *_ in rows:
        b = (t or "").encode()
        payload = b.ljust(max(1, -(-len(b) // 576)) * 576, b"\xff")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    clips = media.clips(stored).groupBy("doc_id").agg(F.sum("n_frames").alias("n"), F.min("start_s"), F.count("*")).collect()
    assert {r["doc_id"]: r["n"] for r in clips} == {i: got[i]["payload_bytes"] // 576 for i in got}


def test_shots():
    still = lambda level, n: np.full((n, 24, 24), level, np.uint8)
    assert media.shots(np.concatenate([still(10, 6), still(200, 5), still(90, 7)])) == [(0, 6), (6, 11), (11, 18)]
    assert media.shots(still(5, 4)) == [(0, 4)] and media.shots(still(5, 0)) == []


# 10


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>One <b>two</b>\n three<p>Four<br>five", "One two three\n\nFour\nfive"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>tail", "* a\n* b\n  3. x\n  4. y\n* c\n\ntail"),
        ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td colspan=2>all of it</table>", "Name       Qty\nApple pie  3\nall of it"),
        ("<style>.h{display:none} p#z{visibility:hidden}</style>a<i class='x h'>no</i><p id=z>no</p><b hidden>no</b><script>no</script><i style='DISPLAY : none'>no</i>", "a"),
        ("<pre>\n  keep\n   this</pre>", "  keep\n   this"),
        ("a &lt;b&gt; &amp;amp; &copy; <!-- no --> c<![CDATA[d]]>", "a <b> &amp; © cd"),
        ("<head><title>no</title></head>x</body>y</html>z", "xyz"),
        ("</div></p>a<div><p>b</div>c", "a\n\nb\n\nc"),
        ("<select><option>1<option>2</select><details>no<summary>s</summary></details>", "1\n2\ns"),
        ("<dl><dt>T<dd>D</dl><blockquote>Q</blockquote>", "T\n    D\n\n    Q"),
        ("a < b <3 <>", "a < b <3 <>"),
        ("", ""),
        ("<style>@media print{.ad{display:none}}</style><i class=ad>x</i>", "x"),
        ("<style>@media screen and (min-width: 600px){.ad{display:none}}</style><i class=ad>x</i>y", "y"),
        ("<style media=print>.ad{display:none}</style><i class=ad>x</i>", "x"),
        ("<style>.h{display:none} .h{display:block}</style><i class=h>x</i>", "x"),
        ("<style>.h{display:none} i{display:block}</style>a<i class=h>x</i>", "a"),
        ("<style>.h{display:none!important} #a{display:block}</style>a<i class=h id=a>x</i>", "a"),
        ("<i style='display:none;display:block'>x</i>", "x"),
        ("<i style='display:none;display:9'>x</i>y", "y"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>x</b>c</div>", "x"),
        ("<style>div.x.y{display:none}</style><div class='y x'>no</div><div class=x>yes</div>", "yes"),
        ("<style>/* c */ .h /* d */ {display:none}</style>a<i class=h>no</i>", "a"),
        ("<style>nav > ul li:first-child, [data-a~=q]{display:none} p + p{display:none} h1 ~ b{display:none} i:not(.k){display:none} a:hover{display:none}</style><nav><ul><li>no<li>yes</ul></nav><u data-a='p q'>no</u><p>1<p>no<h1>H</h1><b>no</b><i class=k>k</i><i>no</i><a>z</a>", "* yes\n\n1\n\nH\n\nkz"),
        ("<p hidden style='display:block'>x</p>", "x"),
        ("<style>i{display:none!important} i{display:block} b{display:none} b{display:block} u{display:block} b,u{display:none}</style><i>no</i><b>no</b><u>no</u>a", "a"),
        ("<table><tr><td rowspan=2>A<td>B1<td>C<tr><td>B2<td rowspan=0>D<tr><td>E</table>", "A  B1  C\n   B2  D\nE"),
        ("<table><tr><td colspan=1000>wide<td>end<tr><td>a<td>b</table>", "wide  end\na  b"),
        ("<table><tr><td colspan=2>long heading<td>end<tr><td>a<td>b<td>c</table>", "long heading  end\na  b          c"),
        ("<ol><li value=5>a<li>b<li value=2>c</ol><ol reversed><li>x<li>y</ol><ol type=a start=27><li>z</ol><ol type=I start=1994><li>r</ol>", "5. a\n6. b\n2. c\n\n2. x\n1. y\n\naa. z\n\nMCMXCIV. r"),
        ("<ul><li>a</li>X<li hidden>no</ul>", "* a\n  X"),
        ("&#0000000065; &#99999999999; &#xfffffffff;", "A \ufffd \ufffd"),
        ("a<b", "a"),
        ("x<!-- a --!>y<!-->z<!x>", "xyz"),
        ("</3 n>x<\u0130>y", "x<\u0130>y"),
    ],
)
def test_html(source, text):
    assert html.Page(source).render() == text


@pytest.mark.parametrize(
    "part",
    ["<a \"", "<a '", "<a ", "<a b=", "<", "</", "<!--", "<!", "<![CDATA[", "&#9", "<p>", "<li>", "<b>", "<td>", "<table>", "<script>", "<td colspan=1000 rowspan=9>", "<style>a{", "<style>@media print{", "<style>/*", "<i style='display:none", "<style>a, a{display:none}", "<style>a b > c + d ~ e [x] ", "</p>", "<option>", " \n "],
)
def test_any_page_is_read_in_one_pass(part):
    """100 kB of what a tokenizer may trip over."""
    began = time.process_time()
    html.Page(part * (100_000 // len(part))).render()
    html.Page("<a " + part[-1] * 100_000).render()
    assert time.process_time() - began < 3


def test_selectors_are_matched_once():
    sheet = " ".join("div" for _ in range(60))
    page = f"<style>{sheet} > b{{display:none}} p ~ p ~ b{{display:none}}</style>" + "<div>" * 150 + "<p>" * 20_000 + "<b>x</b>"
    began = time.process_time()
    html.Page(page).render()
    assert time.process_time() - began < 5


@pytest.mark.parametrize("mark", [" + ", " ~ ", " > ", " ", ","])
def test_selectors_of_any_length(mark):
    page = lambda n: f"<style>{mark.join(['b'] * n)}{{display:none}}</style>" + "<b>x</b>" * 3000
    began = time.process_time()
    html.Page(page(3000)).render()
    assert html.Page(page(150)).render() == {" + ": "x" * 149, " ~ ": "x" * 149, ",": ""}.get(mark, "x" * 3000)
    assert time.process_time() - began < 20


def test_html_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<div>" * 5000 + "deep", "x"), (4, "<p>" + "long " * 50_000, "x")], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[1] is None and got[2] == "" and got[3] == "deep" and len(got[4]) == 249_999


# edge cases of all operators


def edge_rows(spark):
    """Repeated ids and whole rows, null ids and texts, ties, and columns named like those of results."""
    long = "".join(random.Random(2).choice("abcde ") for _ in range(40_000))
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "other words here"), (None, "a b c d e f g h"), (None, None), (2, None), (3, ""), (4, " \n"), (5, long), (5, long), (None, long), (6, "x" * 9000)]
    df = spark.createDataFrame([(i, t, "en" if n % 2 else None) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string")
    names = "score fp component_id kept kept_sha256 n_removed n_words ids decoded media n_bytes covered item_id block part row key shard slot __key __place a.b h seeds".split()
    return rows, df.select("*", *(F.lit("keep").alias(n) for n in names))


def by_row(found, columns):
    """What each (id, ...) got, as a sorted list."""
    return sorted([tuple(r[c] for c in columns) for r in found], key=repr)


def test_edge_cases_of_every_operator(spark):
    rows, df = edge_rows(spark)
    ids = sorted([i for i, _ in rows], key=repr)
    found = {
        "sharding": sharding.assign_shards(df, "doc_id", 3, rows_per_range=4),
        "suffixes": suffixes.remove_repeats(df, 5, block_bytes=5000),
        "lm": lm.score(df, F.lit(True)),
        "simhash": simhash.near_duplicates(df, 4, 4),
        "similar": simhash.similar_groups(df),
        "fmindex": fmindex.remove_repeats(df, 5, block_bytes=5000),
        "cut": fmindex.cut_repeats(df, 5),
        "bpe": bpe.encode(df, TOKENIZER, long_text=5000, long_word=100),
        "langid": langid.predict(df, langid.train(df)),
        "media": media.read_back(media.store(df)),
        "html": html.extract(df, "text", "h"),
    }
    for name, out in found.items():
        got = out.collect()
        assert sorted([r["doc_id"] for r in got], key=repr) == ids, name
        # equal rows get equal results, whatever else a row has
        groups = collections.defaultdict(set)
        if name not in ("sharding", "cut", "html"):
            for r in got:
                groups[r["doc_id"]].add(repr({k: v for k, v in r.asDict().items() if k != "lang"}))
            if name not in ("suffixes",):
                assert len(groups[5]) == 1, name
    kept = found["sharding"].first()
    assert kept["__key"] == kept["a.b"] == kept["__place"] == "keep" and found["cut"].columns == df.columns
    tokenizer = bpe.Codec.load(TOKENIZER).tokenizer
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in rows)
    assert sorted(list(r["ids"]) for r in found["bpe"].collect()) == want
    judged = {r["doc_id"]: r for r in decontaminate.judge(df, spark.createDataFrame([(7, "b c d e f g"), (8, None)], "item_id long, text string")).collect()}
    assert judged[1]["contaminated"] and judged[None]["contaminated"] and not judged[2]["contaminated"] and set(judged) == set(ids)


def test_empty_tables_of_every_operator(spark):
    _, df = edge_rows(spark)
    none = df.limit(0)
    assert bpe.encode(none, TOKENIZER).count() == media.read_back(media.store(none)).count() == media.clips(media.store(none)).count() == 0
    assert html.extract(none, "text").count() == sharding.assign_shards(none, "doc_id", 3).count() == simhash.near_duplicates(none).count() == 0
    assert decontaminate.leaks(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert decontaminate.leaks(df, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert fmindex.cut_repeats(none).count() == suffixes.remove_repeats(none).count() == lm.score(none, F.lit(True)).count() == 0


def test_minority_language_of_many(spark):
    """Of ten languages any may be a document's second."""
    rng = random.Random(12)
    words_of = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[k * 2 : k * 2 + 6]) for _ in range(6)) for _ in range(12)] for k in range(10)}
    say = lambda lang, n: " ".join(rng.choice(words_of[lang]) for _ in range(n))
    rows = [(k * 100 + i, say(f"l{k}", 40), f"l{k}") for k in range(10) for i in range(12)]
    rows += [(5000 + k, say("l0", 60) + " " + say(f"l{k}", 25), None) for k in range(3, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_mix"] for r in langid.predict(df, langid.train(df)).where("lang is null").collect()}
    assert all(f"l{k}:" in got[5000 + k] and "l0:" in got[5000 + k] for k in range(3, 10)), got
