"""Words with U+0000, templates as black boxes, BM25 against exhaustive search, pieces of packing, held-out quality, stages with odd tables."""

import random
import re
import zlib
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rankloom.llm import chat, decontaminate, exact, jaccard, language, packing, passages, registry, toxicity

from .test_operators import SF, brute_components, brute_spans, words


def test_nul_is_part_of_a_word(spark):
    rng = random.Random(31)
    shared = words(rng, 60).split()
    shared[20] = "a\0b"
    rows = [(1, " ".join(shared)), (2, "\0 \0x " + " ".join(shared) + " tail"), (3, "a b\0c d e f g h"), (4, "a b\0c  d e f g h"), (5, "\0"), (6, " ".join(shared[:49]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    own = {i: t.encode().split() for i, t in rows}
    marks = brute_spans(own, 50, lambda a, b: a[0] < b[0])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.substring_dedup(frame).collect()}
    assert got == {i: (len(w), sum(marks[i]), sha256(b" ".join(x for x, m in zip(w, marks[i]) if not m)).hexdigest()) for i, w in own.items()}
    assert got[2][1] == 60
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    assert found == brute_components(rows) and found[3] == (3, 3) and found[4] == (3, 3)


def numbered(turns):
    return "preamble\n" + "".join(f"{k} {role}> {text.upper()}\n" for k, (role, text) in enumerate(turns))


def merging(turns):
    """Turns of one role in a row share a header; what ends the output closes the last."""
    out = ""
    for k, (role, text) in enumerate(turns):
        out += text if k and turns[k - 1][0] == role else ("</>" if k else "") + f"<{role}>{text}"
    return out + "</>"


def rewriting(turns):
    return f"{len(turns)} turns\n" + "".join(f"[{role}] {text}\n" for role, text in turns)


@pytest.mark.parametrize("n", [1, 65, 200, 1000])
def test_templates_are_black_boxes(n):
    turns = [("user" if k % 3 else "assistant", f"t{k}\n</turn> \\") for k in range(n)]
    for box, rewrites in ((chat.template, False), (numbered, False), (merging, n > 1), (rewriting, n > 1)):
        out, spans, mask, rewritten = chat.format_turns(turns, black_box=box)
        assert out == box(turns) and rewritten == rewrites and len(spans) == n
        said = [t for r, t in turns if r == "assistant"]
        shown = [out[a:b] for a, b in mask]
        assert shown == ([chat.escape(t) for t in said] if box is chat.template else [t.upper() for t in said] if box is numbered else said)


def exhaustive(docs, items):
    """All hits by scores of every passage against every piece."""
    index = decontaminate.Index(items)
    hits = set()
    for doc, text in docs:
        data = np.frombuffer((text or "").encode(), np.uint8)
        flat, starts, ends, first = decontaminate.split_words(data, np.array([0, len(data)]), decontaminate.PLAIN)
        own = decontaminate.word_hashes(flat, starts, ends)
        for a in range(0, max(1, len(own)), decontaminate.PIECE):
            passage = own[a : a + 2 * decontaminate.PIECE]
            terms = set(index.lookup(passage).tolist())
            for p in range(len(index.pieces)):
                score = sum(float(index.impact[x]) for t in terms if t < len(index.vocabulary) for x in range(index.bounds[t], index.bounds[t + 1]) if index.piece[x] == p)
                if score < decontaminate.THRESHOLD:
                    continue
                sizes = index.sizes(p)
                q, r, whole = (decontaminate.share(part[p], index.shingles(passage, n)) for part, n in zip((index.question, index.answer, index.all), sizes, strict=True))
                if whole >= decontaminate.OVERLAP and min(q, r) >= decontaminate.HALF:
                    hits.add((doc, index.items[p]))
    return hits


def test_decontamination_equals_exhaustive_search(spark):
    rng = random.Random(33)
    items = [(k, words(rng, n, 300)) for k, n in enumerate([3, 5, 8, 12, 20, 40, 64, 90, 130, 15, 15, 7])] + [(50, words(rng, 12, 300))] * 2
    docs = [(k, words(rng, 150, 300) + " " + item + " " + words(rng, 90, 300)) for k, (_, item) in enumerate(items)]
    for k, (_, item) in enumerate(items):  # some words of the item replaced, some left out
        own = item.split()
        own[len(own) // 2] = "other"
        docs += [(100 + k, words(rng, 30, 300) + " " + " ".join(own)), (200 + k, " ".join(own[: len(own) // 2]) + " " + words(rng, 40, 300)), (300 + k, words(rng, 260, 300))]
    docs += [(900, None), (901, "")]
    want = exhaustive(docs, items)
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.contaminated(frame, known).collect()
    assert {(r.doc_id, r.item_id) for r in whole} == want and all((k, items[k][0]) in want for k in range(len(items)))
    # shards change neither hits nor scores
    parts = decontaminate.contaminated(frame, known, shard_bytes=400).collect()
    score = lambda rows: {(r.doc_id, r.item_id): round(r.bm25_share, 9) for r in rows}
    assert score(parts) == score(whole)


def test_packing_pieces_and_ids(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rng = random.Random(34)
    rows = [(1, words(rng, 3000)), (2, None), (3, "é ؒ ᫀ क्षि \U0001fae8"), (4, words(rng, 700)), (4, words(rng, 700)), (5, "x" * 5000)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), path).collect()
    want = []
    for doc, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_short_texts_count_with_their_nodes():
    trie = exact.PatriciaTrie("largest")
    for k in range(2000):
        trie.insert(b"%07d" % k, k)
    assert trie.size >= 2000 * exact.NODE_BYTES
    out = list(trie.spill(0))
    assert len(out) == 2000 and trie.size == 0


def test_held_out_quality(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    langs = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'")
    assert langs.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.98
    scored = toxicity.score_documents(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    yes, no = ([r.score for r in scored if r.toxic == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no]) >= 0.9


def test_stages_take_odd_tables(spark):
    rng = random.Random(35)
    long_ = words(rng, 80)
    rows = [(1, long_), (2, long_), (3, long_ + " end"), (4, None), (5, ""), (5, ""), (None, "q"), (None, words(rng, 80)), (6, words(rng, 40000, 9000))]
    clash = ["own", "digest", "later", "leaked", "_own", "score", "whole", "_id", "_digest", "_later", "_leaked"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in clash:
        docs = docs.withColumn(c, F.lit(f"={c}"))
    stages = dict(pipeline.STAGES)
    kept = {n: stages[n](spark, docs, SF) for n in ("toxicity", "exact_dedup", "near_dedup", "decontaminate")}
    for n, out in kept.items():
        assert out.columns == docs.columns, n
        assert all(r[c] == f"={c}" for r in out.collect() for c in clash)
        assert stages[n](spark, docs.where("false"), SF).count() == 0
    assert sorted(str(r.doc_id) for r in kept["exact_dedup"].collect()) == sorted(["2", "3", "5", "6", "None", "None"])
    assert sorted(str(r.doc_id) for r in kept["near_dedup"].collect()) == sorted(["1", "4", "5", "5", "6", "None", "None"])
    assert kept["decontaminate"].count() == len(rows)
    packed = pipeline.pack(spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows) and pipeline.pack(spark, docs.where("false"), SF).count() == 0
    assert re.fullmatch(r"[a-z_]+", pipeline.STAGES[0][0]) and Path(registry.tokenizer_path()).exists()
