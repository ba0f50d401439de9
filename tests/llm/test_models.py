"""Models against their definitions: label paths one by one, Kneser-Ney ratios from plain counts."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankloom.llm import language, toxicity


@pytest.mark.parametrize("seed", range(5))
def test_posteriors_sum_over_all_label_paths(seed):
    rng = np.random.default_rng(seed)
    langs, sizes = 3, [0, 1, 4, 2, 0, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores, moves = rng.normal(size=(first[-1], langs)).astype(np.float32) * 3, rng.normal(size=(langs, langs))
    pairs = np.zeros((langs, langs))
    got = language.posteriors(scores, first, moves, pairs)
    want, steps = np.zeros_like(got), np.zeros_like(pairs)
    for a, n in zip(first, sizes, strict=False):
        total, mark, step = 0.0, np.zeros((n, langs)), np.zeros_like(pairs)
        for path in itertools.product(range(langs), repeat=n):
            weight = math.exp(sum(float(scores[a + t, y]) for t, y in enumerate(path)) + sum(moves[u, v] for u, v in itertools.pairwise(path)))
            total += weight
            for t, y in enumerate(path):
                mark[t, y] += weight
            for u, v in itertools.pairwise(path):
                step[u, v] += weight
        want[a : a + n], steps = mark / total, steps + step / total
    assert np.allclose(got, want, atol=1e-6) and np.allclose(pairs, steps, atol=1e-6)


def grams_of(text: str, order: int):
    """n-grams of a text as pairs (bytes, whether across words), from the definition."""
    words, now = [], bytearray()
    for b in text.encode() + b" ":
        b = b + 32 if 65 <= b <= 90 else b
        if 97 <= b <= 122 or b >= 128:
            now.append(b)
        elif now:
            words.append(bytes(now))
            now = bytearray()
    line = b""
    for w in words:
        line += b"\0"
        for k in range(1, len(w) + 1):
            line += w[k - 1 : k]
            yield w[:k][-order:], False
            if k < order:
                yield line[-order:], True


def coded(gram: bytes, across: bool, order: int) -> int:
    return int.from_bytes(gram, "big") | (order if across else len(gram)) << 56


def test_ratios_equal_kneser_ney_by_hand(spark):
    rng = random.Random(4)
    order, discount = 4, 0.75
    vocabulary = ["bad", "badly", "good", "Güte", "a", "ab", "goodness", "x1y", "the"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))), int(rng.random() < 0.4), int(rng.random() < 0.2)) for k in range(60)]
    counts = defaultdict(Counter)
    for _, text, toxic, fifth in rows:
        for g in grams_of(text, order):
            counts[coded(*g, order)][toxic, fifth] += 1
    places, after = Counter(g & 0xFFFFFF for g in counts), defaultdict(set)
    for s in places:
        after[s >> 8].add(s)
    backoff = {s: (max(places[s] - discount, 0) + discount * len(after[s >> 8]) / 256) / sum(places[t] for t in after[s >> 8]) for s in places}
    below = lambda g: ((g & (1 << 56) - 1) >> 8) + (((g >> 56) - 1) << 56)
    inside = defaultdict(list)
    for g in counts:
        inside[below(g)].append(g)

    def probability(g, toxic, column):
        own = lambda x: counts[x][toxic, 0] + (counts[x][toxic, 1] if column else 0)
        total, kinds = sum(map(own, inside[below(g)])), sum(own(x) > 0 for x in inside[below(g)])
        left = discount * kinds / total if total else 1.0
        return (max(own(g) - discount, 0) / total if total else 0.0) + left * backoff[g & 0xFFFFFF], left

    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fifth int")
    files = toxicity.model(labelled.select("text", "toxic", "fifth"), order, discount)
    keys = sorted(counts)
    for column in (0, 1):
        found = toxicity.Ratios(files, column).find(np.array(keys, np.uint64))
        want = [math.log(probability(g, 1, column)[0] / probability(g, 0, column)[0]) for g in keys]
        assert np.allclose(found, want, atol=1e-4)
    # n-grams never seen take what their context leaves to the backoff; an unknown context says nothing
    contexts = [c for c in inside if (c | 0) and (c << 8) + (1 << 56) + 0x7A not in counts][:50]
    unseen = [((c & (1 << 56) - 1) << 8 | 0x7A) + (((c >> 56) + 1) << 56) for c in contexts]
    unseen, contexts = zip(*((g, c) for g, c in zip(unseen, contexts, strict=True) if g not in counts), strict=True)
    lefts = [math.log(probability(inside[c][0], 1, 1)[1] / probability(inside[c][0], 0, 1)[1]) for c in contexts]
    assert np.allclose(toxicity.Ratios(files, 1).find(np.array(unseen, np.uint64)), lefts, atol=1e-4)
    assert toxicity.Ratios(files, 1).find(np.array([int.from_bytes(b"zzqq", "big") | 4 << 56], np.uint64)).tolist() == [0.0]
