"""Language ID by a linear-chain conditional random field over words.

Each word has affix features (its first and last one to three bytes), n-gram features (its byte trigrams, averaged) and
a lexicon feature (the word itself), all hashed; transitions between languages are learned with them. Forward-backward
gives every word's posterior, so code-switched texts are labelled word by word; a document's language is the one with
the greatest mean posterior, its score that mean.

The field is fitted by gradient ascent on windows of words from at most about SAMPLE documents a language, some of them
joined from two languages, as a bound on the fit. Words are runs of letters (A-Z lower-cased; all bytes from 128 on).

Null texts and texts without a letter are `und` with score 0. Null languages teach nothing; where nothing is learned all
texts are `und`. Repeated rows are judged one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs_of, slices, text_buffers
from .tokens import SEP, U, mixed, range_hashes, split_words, text_of

SAMPLE, WINDOW, EPOCHS, RATE, BITS, CHUNK = 600, 40, 40, 0.2, 17, 5 << 19
LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else SEP for b in range(256)], np.uint8)


class Features:
    """Hashed features of all words of some texts: seven single ones, and trigrams as (feature, word) pairs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        flat, starts, ends, self.first = split_words(data, offsets, LETTERS)
        size = ends - starts
        kinds = [(starts, ends)]
        for k in (1, 2, 3):
            kinds += [(starts, np.minimum(starts + k, ends)), (np.maximum(ends - k, starts), ends)]
        self.single = np.column_stack([self.place(range_hashes(flat, a, b), k) for k, (a, b) in enumerate(kinds)]) if len(starts) else np.zeros((0, 7), np.int64)
        n = np.maximum(size - 2, 0)
        self.word = np.repeat(np.arange(len(starts)), n)
        at = np.arange(len(self.word)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        wide = flat.astype(U)
        self.gram = self.place(mixed(wide[at] << U(16) | wide[at + 1] << U(8) | wide[at + 2]) if len(at) else np.zeros(0, U), 7)
        self.begin, self.count = np.cumsum(n) - n, n

    @staticmethod
    def place(h: np.ndarray, kind: int) -> np.ndarray:
        return (mixed(h + U((kind + 1) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)) >> U(64 - BITS)).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Each word's score for each language."""
        out = np.zeros((len(self.single), weights.shape[1]), np.float32)
        for k in range(self.single.shape[1]):
            out += weights[self.single[:, k]]
        some = np.flatnonzero(self.count)
        if len(some):
            out[some] += np.add.reduceat(weights[self.gram], self.begin[some], axis=0) / self.count[some, None].astype(np.float32)
        return out

    def gradient(self, delta: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, delta.shape[1]), np.float32)
        share = delta / np.maximum(self.count, 1)[:, None]
        for lang in range(delta.shape[1]):
            for k in range(self.single.shape[1]):
                out[:, lang] += np.bincount(self.single[:, k], delta[:, lang], size)
            out[:, lang] += np.bincount(self.gram, share[self.word, lang], size)
        return out


def posteriors(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Each word's posterior by forward-backward, all texts side by side; adds expected transitions to `pairs`."""
    potential = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    move = np.exp(moves)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # texts that have word t
    ahead = np.empty_like(potential)
    now = None
    for t, m in enumerate(live.tolist()):
        at = begin[:m] + t
        now = potential[at] if t == 0 else (now[:m] @ move) * potential[at]
        now /= now.sum(1, keepdims=True)
        ahead[at] = now
    out = ahead.copy()
    back = np.ones((len(size), scores.shape[1]))
    for t in range(len(live) - 1, 0, -1):
        m = live[t]
        at = begin[:m] + t
        onward = back[:m] * potential[at]
        if pairs is not None:
            joint = ahead[at - 1][:, :, None] * move * onward[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        before = onward @ move.T
        before /= before.sum(1, keepdims=True)
        back[:m] = before
        both = ahead[at - 1] * before
        out[at - 1] = both / both.sum(1, keepdims=True)
    return out


def fit_field(windows: list[tuple[str, str]], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, moves) from (words, language) windows; every third is joined with one of another language."""
    n = len(langs)
    rng = np.random.default_rng(7)
    number = {x: k for k, x in enumerate(langs)}
    texts, marks = [], []
    by = [[w for w, x in windows if x == lang] for lang in langs]
    for k, (words, lang) in enumerate(windows):
        own = [(words, number[lang])]
        if k % 3 == 0 and n > 1:
            other = (number[lang] + 1 + int(rng.integers(n - 1))) % n
            if by[other]:
                own = [(" ".join(words.split()[: WINDOW // 2]), number[lang]), (" ".join(by[other][int(rng.integers(len(by[other])))].split()[: WINDOW // 2]), other)]
        texts.append(" ".join(w for w, _ in own))
        marks += [m for w, m in own for _ in w.split()]
    features = Features(*text_buffers(pa.array(texts, pa.string())))
    gold = np.array(marks)
    truth = np.zeros((len(gold), n))
    truth[np.arange(len(gold)), gold] = 1
    inner = np.ones(len(gold), bool)
    inner[features.first[:-1][np.diff(features.first) > 0]] = False
    seen = np.zeros((n, n))
    np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    weights, moves = np.zeros((1 << BITS, n), np.float32), np.zeros((n, n))
    past_w, past_m = np.full_like(weights, 1e-12), np.full_like(moves, 1e-12)
    for _ in range(EPOCHS):
        expected = np.zeros((n, n))
        found = posteriors(features.scores(weights), features.first, moves, expected)
        g = features.gradient((truth - found).astype(np.float32), len(weights)) / len(gold) - 1e-7 * weights
        h = (seen - expected) / len(gold) - 1e-4 * moves
        past_w += g * g
        past_m += h * h
        weights += RATE * g / np.sqrt(past_w)
        moves += RATE * h / np.sqrt(past_m)
    return weights, moves


def sampled(training: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[str, str]], list[str]]:
    """(windows of words with their language, languages), from about `sample` documents a language."""
    counts = {r.lang: r["count"] for r in training.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    rate = F.create_map(*(x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / v)))))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) / 1e6
    picked = training.where(draw < F.element_at(rate, F.col("lang"))).select("doc_id", "text", "lang")

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            data, offsets = text_buffers(b.column(1))
            flat, starts, ends, first = split_words(data, offsets, LETTERS)
            out = []
            for doc, a, z in zip(b.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                a += (doc or 0) * 7919 % max(1, z - a - WINDOW + 1)
                z = min(z, a + WINDOW)
                out.append(b" ".join(flat[starts[k] : ends[k]].tobytes() for k in range(a, z)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(2)], names=["words", "lang"])

    rows = picked.limit(4 * sample * len(counts)).mapInArrow(window, "words string, lang string").where("words != ''").collect()
    return sorted((r.words, r.lang) for r in rows), sorted(counts)


def label(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score, segments (runs of words of one language: start and stop word, lang) for docs (doc_id, text).

    training: doc_id, text, lang.
    """
    windows, langs = sampled(training)
    field = docs.sparkSession.sparkContext.broadcast(fit_field(windows, langs) if windows else None)
    segment = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], object)
        for b in slices(batches, "text", CHUNK):
            n = b.num_rows
            pred, score, runs = np.full(n, len(langs)), np.zeros(n), [[] for _ in range(n)]
            if field.value:
                data, offsets = text_buffers(b.column(1))
                features = Features(data, offsets)
                first = features.first
                found = posteriors(features.scores(field.value[0]), first, field.value[1])
                total = np.concatenate([np.zeros((1, len(langs))), np.cumsum(found, 0)])
                mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
                pred, score = mean.argmax(1), np.minimum(mean.max(1), 1.0)
                best = found.argmax(1)
                text = text_of(first)
                new = np.ones(len(best), bool)
                new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(new)
                for t, a, z, k in zip(text[at].tolist(), at.tolist(), [*at[1:].tolist(), len(best)], best[at].tolist(), strict=True):
                    runs[t].append({"start": a - int(first[t]), "stop": min(z, int(first[t + 1])) - int(first[t]), "lang": langs[k]})
                ascii_letters = np.concatenate([[0], np.cumsum((LETTERS[data] != SEP) & (data < 128))])
                for t in np.flatnonzero(ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]]).tolist():
                    if not any(c.isalpha() for c in b.column(1)[t].as_py() or ""):
                        pred[t], score[t], runs[t] = len(langs), 0.0, []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[pred], pa.string()), pa.array(score), pa.array(runs, segment)], names=["doc_id", "lang_pred", "score", "segments"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, segments array<struct<start:long,stop:long,lang:string>>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) to doc_id, held_out, lang_pred, score, segments; held-out rows teach nothing."""
    training = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return label(docs_of(docs), training).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "segments")
