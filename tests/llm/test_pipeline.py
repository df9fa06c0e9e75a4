"""The pipeline's stages, one after another, against brute force on a small table."""

import collections
import hashlib
import random
import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import decontaminate, fmindex, simhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(n))


def shingles(text, k=5):
    w = WORD.findall(text.lower().encode())
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    items = [(i, prose(rng, 30)) for i in range(6)]
    base = [prose(rng, 200) for _ in range(25)]
    passage = prose(rng, 60)
    near = base[3].split()
    near[100] = "altered"
    texts = [*base, base[0], base[0], " ".join(near), f"{prose(rng, 50)} {passage} {prose(rng, 50)}", f"{prose(rng, 80)} {passage}", f"{prose(rng, 40)} {items[2][1]} {prose(rng, 40)}", None, "", "12 34 !!", prose(rng, 5), passage]
    rows = [(i * 2, t, "en" if i % 4 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # documents without letters go
    want = {i: t for i, t, *_ in rows if t and any(map(str.isalpha, t))}
    # the first of each group of similar texts stays; here pairs are far above or below 0.8
    held: dict = {}
    for i, t in want.items():
        own = shingles(t)
        if not any(len(own & s) / len(own | s) >= 0.8 for s in held.values()):
            held[i] = own
    want = {i: want[i] for i in held}
    # windows of 35 words that occur twice go
    words = {i: WORD.findall(t.encode()) for i, t in want.items()}
    count = collections.Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    cut = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - 34) if count[tuple(w[s : s + 35])] > 1 for p in range(s, s + 35)}
        rest = b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else want[i]
        if rest:
            cut[i] = rest
    # documents that hold half of an item go
    want = {i: t for i, t in cut.items() if not any(f" {it} " in f" {t} " for _, it in items)}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    digest = {}
    for i, x in want.items():
        ids = t.encode(x, add_special_tokens=False).ids
        digest[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == digest

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.count() == 0
        if name != "bpe":
            assert out.columns == docs.columns


def test_wide_fingerprints_measure_similarity(spark):
    rng = random.Random(2)
    pairs = []
    for edits in (0, 2, 5, 40):
        a = prose(rng, 400).split()
        b = list(a)
        for at in rng.sample(range(400), edits):
            b[at] = "zz"
        pairs.append((" ".join(a), " ".join(b)))
    rows = [(2 * i + side, p[side]) for i, p in enumerate(pairs) for side in (0, 1)]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    similar = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    assert [groups[2 * i + 1] == 2 * i for i in range(4)] == [s >= 0.8 for s in similar]


def test_passages_are_cut_out_of_the_layout(spark):
    rng = random.Random(4)
    passage = prose(rng, 50).replace(" ", "\n", 3)
    rows = [
        (0, f"A\n\nB\n{passage}\nC\n\n  D"),
        (1, f"H {passage}\n\nI"),
        (2, f"J\n\n{passage} K"),
        (3, f"  {passage}\n"),
        (4, f" \n{passage}\n  E\tF "),
        (5, f"G\n\n  {passage}\n"),
        (6, None),
        (7, " \n"),
        (8, "é  à\n"),
    ]
    got = fmindex.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 35).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {0: "A\n\nB\nC\n\n  D", 1: "H\n\nI", 2: "J\n\nK", 3: "", 4: " \nE\tF ", 5: "G\n", 6: None, 7: " \n", 8: "é  à\n"}
    assert fmindex.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 35, drop_emptied=True).count() == 8


CLASHES = "score lang_mix lang_pred kept n_removed n_words _ id __x row block part first node fp component_id item_id covered `a.b`".split()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rng = random.Random(6)
    passage = prose(rng, 60)
    texts = [prose(rng, 90), f"{prose(rng, 40)} {passage}", f"{passage} {prose(rng, 50)}", None, "", "12 34"]
    texts += texts[:1]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(c.strip("`")) for n, c in enumerate(CLASHES)))
    spark.createDataFrame([(0, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c.strip("`")] == f"{n}:{r['doc_id']}" for r in rows for n, c in enumerate(CLASHES)), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(texts)


def test_repeated_rows_and_null_ids(spark, tmp_path):
    """Repeated rows are copies of one another; rows without an id stay apart from those with one."""
    rng = random.Random(7)
    a, b = prose(rng, 90), prose(rng, 80)
    rows = [(1, a), (1, a), (None, b), (None, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {name: [(r[0], r[1]) for r in stage(spark, docs, str(tmp_path)).collect()] for name, stage in corpus_pipeline.STAGES}
    assert sorted(out["language_id"], key=str) == [(1, a), (1, a), (None, b)]
    assert out["near_dedup"].count((1, a)) == 1 and (None, b) in out["near_dedup"]
    assert set(out["substring_dedup"]) == {(2, ""), (None, None), (None, b)}
    assert len(out["decontamination"]) == len(out["bpe"]) == 5


def test_stage_threshold_is_shared():
    assert decontaminate.COVERAGE == 0.5 and corpus_pipeline.SIMILARITY == 0.8
