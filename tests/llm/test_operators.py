"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.llm import chat, decontaminate, exact, jaccard, language, packing, passages, registry, suffixes, toxicity, urlfilter

from ..oracle import compare

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts():
    """(doc_id, text) with copies, near copies, shared passages, self-repeats, ties and odd texts."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 70)
    near = base.split()
    near[60] = "edited"
    far = [w if k % 6 else "x" for k, w in enumerate(base.split())]
    rows = [
        (10, base), (3, base), (7, " ".join(near)), (8, " ".join(far)), (5, words(rng, 40) + " " + passage + "\n" + words(rng, 30)), (9, passage + " " + words(rng, 50)), (4, words(rng, 200)),
        (1, None), (2, ""), (6, "   "), (11, "a"), (12, "a"), (13, "A b c"), (14, "x" * 400), (15, "ü" * 150 + " é"), (16, (words(rng, 60) + " ") * 3), (17, words(rng, 6000, 5000)), (18, "tab\tand\x0bvertical\nnew  double"), (20, base), (20, base),
        (21, base + " " + passage), (22, "\x00 nul \x1c sep"),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "clash") for i, t in texts()], DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_exact(docs, none, spark):
    got = sorted(map(tuple, exact.exact_dedup(docs).collect()))
    groups = {}
    for i, t in texts():
        groups.setdefault(t or "", []).append(i)
    want = sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts())
    assert got == want
    assert exact.exact_dedup(none).count() == 0
    nulls = spark.createDataFrame([(None, "q"), (5, "q"), (None, "z")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.kept) for r in exact.exact_dedup(nulls, "smallest").collect()) == [(0, 0, True), (0, 5, False), (5, 5, True)]


def test_trie_splits_and_spills():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randrange(9))) for _ in range(400)]
    trie, want = exact.PatriciaTrie(), {}
    for k, key in enumerate(keys):
        trie.insert(key, k)
        want.setdefault(key, []).append(k)
    spilled = {key: (x.owner, x.members) for key, x in trie.spill(trie.size // 2)}
    rest = {key: (x.owner, x.members) for key, x in trie.terminals()}
    assert spilled and not spilled.keys() & rest.keys()
    assert spilled | rest == {k: (min(v), len(v)) for k, v in want.items()}


def brute_spans(units, width, earlier):
    first = {}
    for key in sorted(units):
        u = units[key]
        for i in range(len(u) - width + 1):
            first.setdefault(tuple(u[i : i + width]), (key, i))
    marks = {}
    for key, u in units.items():
        marks[key] = bytearray(len(u))
        for i in range(len(u) - width + 1):
            if earlier(first[tuple(u[i : i + width])], (key, i)):
                marks[key][i : i + width] = b"\1" * width
    return marks


def test_passages(docs, none, monkeypatch):
    for hot in (passages.HOT, 1):
        monkeypatch.setattr(passages, "HOT", hot)
        own = {i: (t or "").encode().split() for i, t in texts()}
        marks = brute_spans(own, 50, lambda a, b: a[0] < b[0])
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.substring_dedup(docs).collect()}
        assert got == {i: (len(w), sum(marks[i]), hashlib.sha256(b" ".join(x for x, m in zip(w, marks[i]) if not m)).hexdigest()) for i, w in own.items()}
        assert any(x[1] for x in got.values())
    assert passages.substring_dedup(none).count() == 0


def test_suffixes(docs, none, monkeypatch):
    for hot in (suffixes.HOT, 1):
        monkeypatch.setattr(suffixes, "HOT", hot)
        own = {i: (t or "").encode() for i, t in texts()}
        marks = brute_spans(own, 100, lambda a, b: a < b)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.suffix_dedup(docs).collect()}
        want = {i: (len(w), sum(marks[i]), len(re.findall(b"\1+", bytes(marks[i]))), hashlib.sha256(bytes(x for x, m in zip(w, marks[i]) if not m)).hexdigest()) for i, w in own.items()}
        assert got == want
    assert suffixes.suffix_dedup(none).count() == 0


def test_loser_tree_merges_and_knows_common_prefixes():
    rng = random.Random(2)
    rows = [bytes(rng.choices(b"ab", k=rng.randrange(1, 12))) for _ in range(300)]
    parts = [sorted((r, b"", k, k, 0, 0) for k, r in enumerate(rows) if k % 7 == j) for j in range(7)]
    runs = [suffixes.Run(suffixes.encode(p)) for p in parts]
    order = list(suffixes.LoserTree(runs).merge())
    merged = [parts[r][k][0] for r, k, _ in order]
    assert merged == sorted(rows)
    assert [n for _, _, n in order[1:]] == [exact.shared_prefix(a, b) for a, b in zip(merged, merged[1:])]


def brute_components(rows):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_jaccard(docs, none, spark, monkeypatch):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute_components(texts())
    assert jaccard.near_duplicates(none).count() == 0
    # a family that drifts: links form a chain, so its groups span labels and all ways of joining are taken
    rng = random.Random(9)
    own, rows = words(rng, 90, 9999).split(), []
    for k in range(40):
        if k % 3 == 0:
            own[rng.randrange(90)] = f"v{k}"
        rows.append((100 - k, " ".join(own)))
        rows.append((200 + k, " ".join(own[:70]) + " " + words(rng, 25, 9999)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block, few in ((256, 32), (4, 0)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "PAIRS", few)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()} == brute_components(rows)


def test_jaccard_compares_groups_of_repeated_rows(spark):
    # groups of one size and different documents, each row twice; 3 has the documents of 2
    met = spark.createDataFrame([(m, d, d) for m, ds in ((1, (1, 2)), (2, (3, 4)), (3, (3, 4))) for d in ds] * 2, "member long, doc_id long, label long")
    tasks = jaccard.cross_tasks(met, spark.createDataFrame([(d, 9) for d in range(1, 5)], "doc_id long, n_shingles long")).collect()
    assert {r.doc_id for r in tasks} == {1, 2, 3, 4}


def test_packing(docs, none):
    from pathlib import Path

    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    got = packing.pack_documents(docs, path).collect()
    size = Counter()
    for i, t in texts():
        size[i] += len(whole.encode(t or "", add_special_tokens=False).ids) + 1
    assert {i: sum(r.length for r in got if r.doc_id == i) for i in size} == size
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(size.values()) // 2048)
    assert packing.pack_documents(none, path).count() == 0
    encode = packing.WordBpe(Path(path).read_text(encoding="utf-8"))
    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choices("abcdEFG'019 \n.,;éèÜß…日語мир\u0301\x1cΣİ", k=rng.randrange(30)))
        assert encode(t) == b"".join(x.to_bytes(4, "little") for x in whole.encode(t, add_special_tokens=False).ids)


def test_best_two_fit_replaces_the_smallest():
    assert sorted(map(sorted, packing.best_two_fit([6, 3, 2, 2], 10))) == [[0, 2, 3], [1]]


def test_chat(spark):
    rows = [(1, 0, "user", "hi \\ ### </turn>"), (1, 1, "assistant", "### A:\n</turn>\n\\"), (1, 1, "assistant", "### A:\n</turn>\n\\"), (2, None, "system", None), (2, 0, None, "x"), (None, 0, "assistant", "é🙂"), (3, 5, "a:b", ":\n"), *((4, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(200))]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, spans string")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(frame)).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(x or "", t or "") for _, x, t in sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv)]
        lost = "".join(t for x, t in turns if x == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(lost) and not r.rewritten
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{t}\n" for x, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
    assert chat.format_conversations(frame.where("false")).count() == 0
    out, spans, bad = chat.render([("u", "a"), ("v", "b")], lambda ts: f"<{len(ts)}>" + "".join(t for _, t in ts))
    assert bad and out == "<2>ab"
    assert not chat.render([("u", "a"), ("v", "b")])[2]


def test_chat_renders_true_prefixes_at_any_length():
    turns = [("user", f"t{k}") for k in range(150)]
    numbered = lambda ts: "preamble " + "".join(f"{k}:{t} " for k, (_, t) in enumerate(ts))
    out, spans, bad = chat.render(turns, numbered)
    assert not bad and out == numbered(turns)
    assert all(out[a:b] == numbered(turns[: k + 1])[len(numbered(turns[:k])) :] for k, (a, b) in enumerate(spans) if k)
    assert chat.render(turns, chat.template) == chat.render(turns, lambda ts: chat.template(ts))


def test_urls(spark):
    pages = spark.createDataFrame([(1, "HTTP://A.Example.COM/en/7?x"), (2, "https://b.example.net/de/1"), (3, "https://example.net/de/8"), (4, None), (5, "no url"), (6, "x://notorg/es/"), (7, "x://q.org/es/#f"), (None, "x://bad.io/p"), (8, "x://bad.io/q"), *((100 + k, "x://bad.io/r") for k in range(30)), *((200 + k, "x://ok.io/r") for k in range(30))], "page_id long, url string")
    outcomes = spark.createDataFrame([(8, None)] + [(100 + k, 1) for k in range(30)] + [(200 + k, 0) for k in range(30)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages.withColumn("host", F.lit("clash")), outcomes).collect()}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2][2:] == ("net/de/", "allow") and got[3][2:] == ("example.net/de/8", "block")
    assert got[4][:2] == got[5][:2] == ("", "") and got[6][2] is None and got[7][2:] == ("org/es/", "block")
    assert got[None][3] == got[8][3] == got[101][3] == "block" and got[201][3] == "allow"
    assert urlfilter.filter_urls(pages.where("false"), outcomes).count() == 0
    assert urlfilter.filter_urls(pages, outcomes.where("false")).count() == pages.count()


def test_decontamination(spark, docs, none):
    rng = random.Random(4)
    item = words(rng, 50, 9999)
    edited = item.split()
    edited[20] = "changed"
    rows = [(1, words(rng, 300) + " " + item.upper() + " " + words(rng, 100)), (2, " ".join(edited)), (3, words(rng, 400)), (4, " ".join(item.split()[:20]) + " " + words(rng, 60)), (None, item), (5, None), (1, item)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item)], "item_id long, text string")
    hits = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, items).collect()}
    assert hits == {(1, 7), (2, 7), (None, 7)}
    assert sorted(r.doc_id or 0 for r in decontaminate.decontaminate(frame, items).collect()) == [0, 3, 4, 5]
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(frame, items.where("false")).count() == 0


def test_decontamination_finds_short_items(spark):
    rng = random.Random(14)
    own = {n: [f"s{n}x{k}" for k in range(n)] for n in range(1, 13)} | {66: [f"l{k}" for k in range(66)]}
    rows = [(n, words(rng, 150) + " " + " ".join(w) + " " + words(rng, 90)) for n, w in own.items()] + [(100 + n, " ".join(w)) for n, w in own.items()]
    # the halves apart, in the other order, or the end of a long item only
    rows += [(200 + n, " ".join(w[n // 2 :] + ["between"] + w[: n // 2])) for n, w in own.items() if 1 < n < 10] + [(300, words(rng, 50) + " l64 l65")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(n, " ".join(w)) for n, w in own.items()], "item_id long, text string")
    hits = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, items).collect()}
    assert hits == {(n + at, n) for n in own for at in (0, 100)}


def test_wand_equals_full_scores():
    rng = random.Random(6)
    items = [(k, words(rng, rng.randrange(5, 60), 60)) for k in range(300)]
    index = decontaminate.Index(items)
    scores = [dict(zip(index.piece[a:b].tolist(), index.impact[a:b].tolist())) for a, b in zip(index.bounds[:-1].tolist(), index.bounds[1:].tolist())]
    for _ in range(20):
        import numpy as np

        terms = np.array(rng.sample(range(len(index.vocabulary)), 25))
        total = Counter()
        for t in terms.tolist():
            total.update(scores[t])
        for least in (0.3, 0.5, 0.7):
            assert {p for p, _ in index.wand(terms, least)} == {p for p, s in total.items() if s >= least}


def test_toxicity(spark, none):
    rng = random.Random(8)
    rows = [(k, words(rng, 60) + (" vileword awfulterm vileword" if k % 4 == 0 else "")) for k in range(400)] + [(900, None), (901, ""), (902, "!!!"), (None, "vileword")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(400)] + [(1, 0, None), (None, 0, 1), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(frame, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [r for k, r in got.items() if r.held_out]
    assert held and all(r.predicted == (r.doc_id % 4 == 0) for r in held if r.doc_id < 400)
    assert toxicity.score_documents(none, labels).count() == 0
    assert toxicity.score_documents(frame, labels.where("false")).count() == len(rows)


def toxic_model(spark, rows):
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))[0]


def whole(spark, model, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r.text: r.whole for r in toxicity.measured(frame, model, toxicity.ORDER, toxicity.WINDOW).collect()}


def test_toxicity_unseen_grams_read_no_other_ratio(spark):
    rng = random.Random(18)
    word = lambda letters: "".join(rng.choices(letters, k=7))
    vocabulary = [word("abcdefghijklmno") for _ in range(4000)]
    model = toxic_model(spark, [(k, " ".join(vocabulary[(k % 200) * 20 :][:20]), k % 2) for k in range(3000)])
    # letters that no training text has: nothing is known of these words but that they begin with an unseen letter
    assert len(set(whole(spark, model, [word("pqrstuvwxyz") for _ in range(20000)]).values())) == 1


def test_toxicity_reads_every_byte(spark):
    rng = random.Random(19)
    plain = lambda: words(rng, 20)
    #: toxic by an end after byte 7, a stem within a compound, a pair of ordinary words, a run without separators
    pairs = [("wonderfulness", "wonderfulscum"), ("overbadlanguage", "overbadwordily"), ("go die die go home stay", "stay home go go die now"), ("語日本語文字化", "語日本語文死ね")]
    for clean, toxic in pairs:
        model = toxic_model(spark, [(k, plain() + " " + (toxic if k % 2 else clean), k % 2) for k in range(400)])
        got = whole(spark, model, [clean, toxic])
        assert got[toxic] > got[clean] + 0.1


def test_toxicity_knows_rare_spellings(spark):
    rng = random.Random(20)
    name = lambda k: "zq" + "".join(chr(97 + int(c)) for c in f"{k:03}") + "v"
    rows = [(k, f"{name(k)} {words(rng, 20)}", k % 2) for k in range(200)]
    rows += [(900, name(11), 1), (901, name(101), 1)]  # else both classes leave the same to the backoff after zqab and zqba
    got = whole(spark, toxic_model(spark, rows), [*map(name, range(200)), "zqabx", "zqbax"])
    # each word is seen once, and its neighbour in the other class
    assert sum(got[name(k)] > got[name(k ^ 1)] + 0.5 for k in range(1, 200, 2)) >= 50
    # what was never seen takes the ratio of its context
    assert got["zqabx"] != 0 and got["zqbax"] != 0


def test_toxicity_counts_every_training_row(spark):
    rng = random.Random(21)
    name = lambda k: "zq" + "".join(chr(97 + int(c)) for c in f"{k:03}") + "v"
    rows = [(k, f"{name(k)} {words(rng, 20)}", k % 2) for k in range(200)]
    got = whole(spark, toxic_model(spark, rows), [name(k) for k in range(200)])
    # each word occurs in one training row only, and leans to the class of that row
    assert all(got[name(k)] > got[name(k ^ 1)] for k in range(1, 200, 2))


def test_language(spark, none):
    rng = random.Random(7)
    sounds = {"aa": ["ka", "ko", "ku", "ta"], "bb": ["sch", "ung", "ein", "ver"]}
    speak = lambda lang, n: " ".join("".join(rng.choices(sounds[lang], k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(k, speak(lang := ("aa", "bb")[k % 2], rng.randrange(1, 60)), lang) for k in range(300)] + [(500, None, "aa"), (501, "123 !", "aa"), (502, "…", None), (503, speak("aa", 20) + " " + speak("bb", 20), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify(frame).collect()}
    assert all(got[k].lang_pred == rows[k][2] for k in range(300)) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3
    assert [(s.lang, s.start, s.stop) for s in got[503].segments] == [("aa", 0, 20), ("bb", 20, 40)]
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    compare(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_one_probe_walks_the_trie_with_numbers(monkeypatch):
    import numpy as np

    from rankloom.llm import jaccard as J

    rng, found = np.random.default_rng(3), 0
    monkeypatch.setattr(J.PrefixTree, "traverse", lambda *_: pytest.fail("tables are for many probes"))
    for n, noise in ((4, 0.1), (60, 0.03), (600, 0.05), (600, 0.5)):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(n) >= noise], rng.integers(0, 1 << 63, int(n * noise)).astype(np.uint64)])) for _ in range(30)]
        sets = [x for x in sets if len(x)]
        tree = J.PrefixTree()
        for k, x in enumerate(sets[1:]):
            tree.insert(k, x, k % 3)
        near = sorted(k for k, x in enumerate(sets[1:]) if k % 3 != 1 and 100 * len(np.intersect1d(x, sets[0])) >= 75 * len(np.union1d(x, sets[0])))
        assert sorted(doc for _, doc in tree.similar([sets[0]], np.array([1]))) == near
        found += len(near)
    assert found > 20 and not list(J.PrefixTree().similar([base], np.array([1])))
