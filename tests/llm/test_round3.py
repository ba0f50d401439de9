"""Merkle manifest, token counts and importance resampling against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import importance, manifest, registry, tokencount
from rankloom.llm.order import numbered

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fanout):
    """rows of (doc_id, text, lang, source, n_chars) to sorted tuples of op11's columns."""
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(spell, (r[0], r[3], r[2], r[4], text)))
    low = lambda t: t and t.translate({c: c + 32 for c in range(65, 91)})

    def tree(leaves):
        """(root, proof of each leaf as [(left, right)])."""
        proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
        while len(level) > 1:
            runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
            for i, p in enumerate(at):
                run, k = runs[p // fanout], p % fanout
                proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
                at[i] = p // fanout
            level = [h(*r) for r in runs]
        return level[0], proofs

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for g in langs}
    trees = {g: tree([leaf(r, r[1]) for r in own[g]]) for g in langs}
    root, tops = tree([trees[g][0] for g in langs]) if langs else (None, [])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for r, proof in zip(own[g], trees[g][1], strict=True):
            now = leaf(r, low(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r, r[1])
            for a, b in proof + top:
                now = h(a, now, b)
            out.append((r[0], leaf(r, r[1]), trees[g][0], root, h(*(a + b for a, b in proof + top)), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout, n", [(8, 0), (8, 1), (8, 9), (2, 130), (8, 600)])
def test_manifest_equals_brute_force(spark, fanout, n):
    rng = random.Random(n)
    langs = [None, "", "é", "zz", "de", *["en"] * 6]
    rows = [(rng.choice([None, k, k, k]), rng.choice([None, "", "Aé" * k, f"Some Text {k}", "low"]), rng.choice(langs), rng.choice([None, "web"]), rng.choice([None, k])) for k in range(n)]
    rows += rows[: n // 10]  # repeated rows
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("place", "size", "tree", "node", "key", "tampered", "part", "row")})
    got = sorted((tuple(r) for r in manifest.manifest_digest(frame, fanout).collect()), key=repr)
    assert got == brute_manifest(rows, fanout)
    assert n < 100 or any(not r[-1] for r in got)


def test_manifest_levels_are_sorted_parquet(spark):
    m = manifest.Manifest(spark.createDataFrame([(k, f"t{k}", "en", None, 1) for k in range(100)], DOCS))
    assert [x.count() for x in m.store.levels] == [100, 13, 2, 1] and m.root == bytes(m.store.levels[3].first().node)
    for k, level in enumerate(m.store.levels[1:], 1):
        assert all(f"/level={k}/" in f for f in level.inputFiles())
    # a run of any level is found by its coordinates alone, without reading other files' rows
    plan = m.store.levels[1].where("tree = '=en' and place = 3")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(tree), IsNotNull(place), EqualTo(tree,=en), EqualTo(place,3)]" in plan


def test_numbers_follow_the_order(spark):
    rows = [(k % 3 * "a", (k * 7919) % 1000) for k in range(3000)]
    got = numbered(spark.createDataFrame(rows, "g string, v long").repartition(7), ["g"], [F.desc("v")], "place", "total").collect()
    by = {g: sorted((v for x, v in rows if x == g), reverse=True) for g in ("", "a", "aa")}
    assert all(by[r.g][r.place] == r.v and r.total == len(by[r.g]) for r in got)
    assert all(sorted(r.place for r in got if r.g == g) == list(range(len(v))) for g, v in by.items())
    plan = numbered(spark.createDataFrame(rows, "g string, v long"), [], [F.desc("v")], "place")._jdf.queryExecution().toString()
    assert "Window" not in plan


TOKENIZER = registry.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counting():
    from tokenizers import Tokenizer

    return tokencount.counter(open(TOKENIZER, encoding="utf-8").read()), Tokenizer.from_file(TOKENIZER)


def assert_same_counts(counting, texts, block=tokencount.BLOCK):
    mine, theirs = counting
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = mine.count(np.frombuffer(b"".join(raw), np.uint8), offsets, block)
    assert got.tolist() == [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]


ALPHABETS = ["abcdefst're ll  \n\t'd", "0123456789 ab-_=+!'", "äöüß éèñ 中文字 ٣٤  　 \u0085​'", "ABCxyz09+/", "'srtmdvel ", "<|endoftext|> a\n"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_counts_equal_the_tokenizer(counting, alphabet):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 10, 50, 200]))) for _ in range(800)]
    assert_same_counts(counting, texts)
    assert_same_counts(counting, texts[:150], block=16)


def test_counts_of_all_code_points(counting):
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and (p < 0x32000 or p % 97 == 0)]
    assert_same_counts(counting, ["x" + "".join(map(chr, points[a : a + 64])) + "1" for a in range(0, len(points), 64)])
    assert_same_counts(counting, [f"a{chr(p)}'s {chr(p)} " for p in points[:0x3000]])


def test_counts_of_special_strings_and_long_runs(counting):
    texts = ["a <|endoftext|>  b<|endoftext|><|endoftext|>", "<|endoftext|", " <|endoftext|>'s", "-" * 63, "-" * 64, "a" * 70_000, " " * 70_000, "x" + "'" * 9000 + "s", "ab\n\n \n" * 9000]
    assert_same_counts(counting, texts)
    assert_same_counts(counting, texts, block=1000)


def test_a_text_of_20_mb_in_blocks(counting):
    unit = "The quick brown fox's 12345 jumps;  over\n\nthe lazy dog. Größe 中文 "
    n = 20_000_000 // len(unit.encode())
    mine, theirs = counting
    data = np.frombuffer((unit * n).encode(), np.uint8)
    per = [len(theirs.encode(unit * k, add_special_tokens=False).ids) for k in (2, 3)]
    assert mine.count(data, np.array([0, len(data)])).tolist() == [per[0] + (n - 2) * (per[1] - per[0])]


def test_states_start_anew_when_the_table_is_full(counting, monkeypatch):
    monkeypatch.setattr(tokencount, "TRANSITIONS", 50)
    assert_same_counts(counting, [f"word{k} other{k} things {k}" for k in range(200)], block=64)


def test_token_counts_of_odd_tables(spark, counting):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same text"), (3, "same text"), (4, "long " * 600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "n_bytes": F.lit(1)})
    size = lambda t: len(counting[1].encode(t or "", add_special_tokens=False).ids)
    got = tokencount.count_tokens(frame, TOKENIZER)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((d, len((t or "").encode()), size(t), size(t) > 512) for d, t in rows), key=repr)
    assert tokencount.count_tokens(frame.limit(0), TOKENIZER).collect() == []
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.Counter(open(registry.tokenizer_path(), encoding="utf-8").read(), np.zeros(0x110000, np.uint8))


def test_op12_equals_the_tokenizer(spark, counting):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in registry.op12_token_counts(spark, sf).collect()}
    want = {d: len(counting[1].encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    assert got == {d: (len(t.encode()), want[d], want[d] > 512) for d, t in texts.items()}


def brute_resample(docs, target, low, high, buckets, percent, least, seed="2024"):
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(low, high + 1) for k in range(len(w) - n + 1)]

    own = [features(t) for _, t in docs]
    s, t = Counter(b for f in own for b in f), Counter(b for x in target for b in features(x))
    total_s, total_t = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets))))
    rows = []
    for (d, text), f in zip(docs, own, strict=True):
        u = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), len(words(text))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(able) // 100
    return sorted([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < least], key=repr)


@pytest.mark.parametrize("low, high, buckets", [(1, 1, 10_000), (1, 2, 97), (2, 3, 1000)])
def test_resampling_equals_brute_force(spark, low, high, buckets):
    rng = random.Random(buckets)
    vocabulary = ["Ärger", "the", "THE", "x1", "2", "naïve", "ÄRGER", "don't", "a_b", "中文", "tail"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 21, 60]))) for _ in range(300)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (7, "other"), (None, texts[9]), (None, None), (400, ""), (401, "\0 \t\n")]
    target = [rng.choice([None, "the tail", "2 naïve x1 the the", "Ärger 中文"]) for _ in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("rank", "i", "score", "place")})
    got = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), low, high, buckets)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(docs, target, low, high, buckets, 10, 20)


def test_resampling_of_nothing_and_everything(spark):
    docs = spark.createDataFrame([(k, f"word{k} same same") for k in range(50)], "doc_id long, text string")
    none = docs.limit(0)
    assert importance.resample(none, docs).collect() == []
    rows = importance.resample(docs, none, percent=100, least=0).collect()
    assert sorted(r.rank for r in rows) == list(range(1, 51))
    best = sorted(rows, key=lambda r: (-r.score, r.doc_id))
    assert [r.rank for r in best] == list(range(1, 51))


def test_counts_of_a_long_text_and_chunks(spark):
    text = " ".join(f"w{k % 5000}" for k in range(900_000))  # 5 MB
    docs = spark.createDataFrame([(1, text), (2, "w1 w2"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in importance.bucket_counts(docs, chunk=1000).collect()}
    want = Counter(zlib.crc32(w.encode()) % importance.BUCKETS for w in text.split())
    assert dict(zip(got[1].buckets, got[1].counts, strict=True)) == want and got[1].n_words == 900_000
    assert got[3].buckets == [] and got[2].n_features == 2


def test_a_model_of_many_buckets_needs_few_descriptors(spark, tmp_path):
    """600 buckets are looked up while few more files than usual may be open."""
    import resource

    from rankloom.llm import toxicity

    rows = spark.range(60_000).select((F.col("id") % 600).alias("bucket"), F.col("id").alias("k")).repartition(100, "bucket").sortWithinPartitions("bucket")
    places = toxicity.sorted_files(rows, str(tmp_path / "model"), lambda own: (own["k"], own["k"] * 2))
    assert len(places) == 600 and len({p[0] for p in places.values()}) <= 100
    limits = resource.getrlimit(resource.RLIMIT_NOFILE)
    opened = len(__import__("os").listdir("/proc/self/fd"))
    resource.setrlimit(resource.RLIMIT_NOFILE, (opened + 20, limits[1]))
    try:
        found, known = toxicity.Stored(places, 600, 1).rows(np.arange(60_010), np.arange(60_010) % 600, 0)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, limits)
    assert known[:60_000].all() and not known[60_000:].any() and (found[:60_000] == 2 * np.arange(60_000)).all()


def test_files_need_a_mounted_folder(spark, monkeypatch, tmp_path):
    from rankloom.llm import common, toxicity

    for bad in ("hdfs://nn:8020/ck", "s3a://bucket/ck"):
        monkeypatch.setattr(common, "shared_dir", lambda spark, bad=bad: bad)
        with pytest.raises(ValueError, match="mounted"):
            toxicity.folder_of(spark)
        common.WRITTEN.pop()
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert toxicity.folder_of(spark).startswith(f"{tmp_path}/rankloom-")


def test_packing_ids_of_all_code_points(spark):
    """Assigned or not, in whatever version of Unicode: the ids are the tokenizer's."""
    from tokenizers import Tokenizer

    from rankloom.llm import packing

    spec = open(registry.tokenizer_path(), encoding="utf-8").read()
    mine, theirs = packing.WordBpe(spec), Tokenizer.from_str(spec)
    points = [p for p in range(1, 0x32000) if not 0xD800 <= p < 0xE000]
    texts = [f"a{chr(p)}b {chr(p)}" for p in points]
    wrong = [hex(p) for p, t, e in zip(points, texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True) if np.array(e.ids, "<u4").tobytes() != mine(t)]
    assert not wrong


def test_pipeline_leaves_nothing_but_what_its_result_reads(spark, monkeypatch, tmp_path):
    import os

    import corpus_pipeline
    from rankloom.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = [d for d in os.listdir(tmp_path / f"rankloom-{spark.sparkContext.applicationId}") if not d.startswith(".")]
    assert packed.count() > 0 and len(left) <= 2  # the documents of the last stage and their pieces
