"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Items are cut into pieces of at most PIECE words (a piece is what the index holds); documents are cut into passages of
2 * PIECE words that advance by PIECE, so each run of PIECE words lies whole in a passage. Every passage is a query.
Impacts are BM25 weights divided by the piece's score against itself, so one threshold serves all pieces. Upper bounds
from block maxima are added up for all passages at once; passages that may reach the threshold go through WAND, which
retrieves all pieces above it. Those are verified by five-word shingles: enough of the question (the piece's first
half) and of the answer (its second half) must lie in the passage. Halves of items of less than ten words are shingles
of their own length, so such an item is found where its words stand in order; the last piece of a longer item, where
that short, is not looked for on its own.

The index is broadcast; it is built in shards of a fixed number of bytes of item texts, each of which meets all
documents, so its size is bounded whatever the benchmark. Document frequencies and the mean length are those of all
items, so a score does not depend on the shards. Words are lower-cased A-Z; ASCII punctuation separates words.

Null and empty documents and items match nothing. Repeated items are reported each. Rows of a null doc_id are searched
like others. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, docs_of, fresh, frugal, per_worker, slices, text_buffers
from .tokens import PLAIN, shingle_hashes, split_words, text_of, word_hashes

PIECE, BLOCK, SHINGLE = 64, 64, 5
K1, B = 1.2, 0.75
#: Least share of a piece's own BM25 score; of its shingles; of the shingles of either half.
THRESHOLD, OVERLAP, HALF = 0.6, 0.75, 0.5
#: Bytes of item texts in one shard of the index; columns of block maxima that passages are bounded by.
SHARD_BYTES, COLUMNS, CHUNK = 16 << 20, 64, 2 << 20

HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage", pa.int64()), ("bm25_share", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
HITS_DDL = "doc_id long, item_id long, passage long, bm25_share double, question_overlap double, answer_overlap double"


class Index:
    """Postings of item pieces with impacts, and block maxima; items are (item_id, text).

    corpus: (pieces, their mean length, pieces that hold each word) of all shards, where there are others.
    """

    def __init__(self, items: list[tuple[int, str]], corpus: tuple[int, float, dict[int, int]] | None = None):
        texts = pa.array([t or "" for _, t in items], pa.string())
        data, offsets = text_buffers(texts)
        flat, starts, ends, first = split_words(data, offsets, PLAIN)
        words = word_hashes(flat, starts, ends)
        self.items, self.pieces, self.short = [], [], []
        for (item, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            for at in range(a, b, PIECE):
                self.items.append(item)
                self.pieces.append(words[at : min(at + PIECE, b)])
                self.short.append(b - a < 2 * SHINGLE)
        n = max(1, len(self.pieces))
        self.vocabulary = np.unique(words)
        lengths = np.array([len(p) for p in self.pieces], float)
        terms, piece, tf = [], [], []
        for k, p in enumerate(self.pieces):
            own, count = np.unique(p, return_counts=True)
            terms.append(np.searchsorted(self.vocabulary, own))
            piece.append(np.full(len(own), k))
            tf.append(count)
        term, piece, tf = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (terms, piece, tf))
        df = np.bincount(term, minlength=len(self.vocabulary))
        every, mean = n, max(1.0, lengths.mean() if len(lengths) else 1.0)
        if corpus:
            every, mean, df = corpus[0], max(1.0, corpus[1]), np.array([corpus[2].get(w, 1) for w in self.vocabulary.astype(np.int64).tolist()], float)
        idf = np.log(1 + (every - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[piece] / mean))
        impact /= np.bincount(piece, impact, max(1, len(self.pieces)))[piece]
        order = np.lexsort((piece, term))
        self.piece, self.impact = piece[order], impact[order]
        self.bounds = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        # maxima by term and block of pieces: sparse for WAND, dense over at most COLUMNS wider blocks for the first bound
        self.wide = -(-n // COLUMNS)
        self.table = np.zeros((len(self.vocabulary) + 1, COLUMNS), np.float32)
        np.maximum.at(self.table, (term, piece // self.wide), impact.astype(np.float32))
        self.top = np.append(np.maximum.reduceat(self.impact, self.bounds[:-1]), 0.0) if len(self.impact) else np.zeros(1)
        half = [len(p) // 2 for p in self.pieces]
        self.question = [self.shingles(p[:h]) for p, h in zip(self.pieces, half, strict=True)]
        self.answer = [self.shingles(p[h:]) for p, h in zip(self.pieces, half, strict=True)]
        self.all = [self.shingles(p) for p in self.pieces]

    @staticmethod
    def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
        return np.unique(shingle_hashes(words, np.array([0, len(words)]), size)[0])

    def sizes(self, piece: int) -> tuple[int, int, int]:
        """Words in a shingle of the question, the answer and the whole; parts of a short item are one shingle each."""
        n = len(self.pieces[piece])
        return tuple(min(SHINGLE, max(1, k)) for k in (n // 2, n - n // 2, n)) if self.short[piece] else (SHINGLE,) * 3

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Term numbers; that of a word of no item is the vocabulary's size."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, len(self.vocabulary))

    def wand(self, terms: np.ndarray, threshold: float) -> Iterator[tuple[int, float]]:
        """(piece, score) of all pieces whose score against these distinct terms reaches the threshold."""
        lists = [Postings(self.piece[a:b], self.impact[a:b]) for a, b in zip(self.bounds[terms].tolist(), self.bounds[terms + 1].tolist(), strict=True) if b > a]
        lists = [x for x in lists if x.current is not None]
        while lists:
            lists.sort(key=lambda x: x.current)
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += x.top
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                return
            at = lists[pivot].current
            while pivot + 1 < len(lists) and lists[pivot + 1].current == at:
                pivot += 1
            near = lists[: pivot + 1]
            if sum(x.block_top(at) for x in near) < threshold:
                # no piece up to the nearest block end of these lists can qualify
                beyond = min([x.block_end(at) for x in near] + [x.current for x in lists[pivot + 1 : pivot + 2]])
                for x in near:
                    x.seek(max(beyond, at + 1))
            else:
                score = 0.0
                for x in near:
                    score += x.score(at)
                if score >= threshold:
                    yield at, score
                for x in near:
                    x.seek(at + 1)
            lists = [x for x in lists if x.current is not None]


class Postings:
    """A cursor over one term's postings, with maxima for each BLOCK postings."""

    __slots__ = ("pieces", "impacts", "tops", "top", "at", "current")

    def __init__(self, pieces: np.ndarray, impacts: np.ndarray):
        self.pieces, self.impacts = pieces.tolist(), impacts.tolist()
        self.tops = [max(self.impacts[k : k + BLOCK]) for k in range(0, len(self.impacts), BLOCK)]
        self.top, self.at, self.current = max(self.tops), 0, self.pieces[0]

    def find(self, piece: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.pieces, piece, self.at)

    def block_top(self, piece: int) -> float:
        k = self.find(piece)
        return self.tops[k // BLOCK] if k < len(self.pieces) else 0.0

    def block_end(self, piece: int) -> int:
        """The first piece behind the block that `piece` would lie in."""
        k = (self.find(piece) // BLOCK + 1) * BLOCK
        return self.pieces[k] if k < len(self.pieces) else self.pieces[-1] + 1

    def score(self, piece: int) -> float:
        k = self.find(piece)
        return self.impacts[k] if k < len(self.pieces) and self.pieces[k] == piece else 0.0

    def seek(self, piece: int) -> None:
        self.at = self.find(piece)
        self.current = self.pieces[self.at] if self.at < len(self.pieces) else None


def share(part: np.ndarray, whole: np.ndarray) -> float:
    return float(np.isin(part, whole).mean()) if len(part) else 1.0


def search(index: Index, docs: list, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(doc, item, passage's first word, share of BM25, overlaps) of each verified hit, the best for each doc and item."""
    flat, starts, ends, first = split_words(data, offsets, PLAIN)
    if not len(starts) or not index.pieces:
        return []
    words = word_hashes(flat, starts, ends)
    text, terms = text_of(first), index.lookup(words)
    # half-passages, numbered over all texts; a passage is one and the next of the same text
    halves = -(-np.diff(first) // PIECE)
    base = np.cumsum(halves) - halves
    half = base[text] + (np.arange(len(words)) - first[text]) // PIECE
    known = np.flatnonzero(terms < len(index.vocabulary))
    v = np.int64(len(index.vocabulary) + 1)
    key = np.unique(np.concatenate([half[known] * v + terms[known], np.maximum(half[known] - 1, base[text[known]]) * v + terms[known]]))
    if not len(key):
        return []
    passage, term = key // v, key % v
    begins = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    # the first bound, from each term's best impact; then by block of pieces
    rough = np.add.reduceat(index.top[term], begins)
    stops = np.append(begins[1:], len(key))
    live = np.flatnonzero(rough >= THRESHOLD)
    bounded = []
    for part in np.array_split(live, max(1, len(live) // 512)):
        if len(part):
            size = stops[part] - begins[part]
            ends = np.cumsum(size)
            rows = np.arange(ends[-1]) + np.repeat(begins[part] - ends + size, size)
            bound = np.add.reduceat(index.table[term[rows]], ends - size, axis=0).max(1)
            bounded += part[bound >= THRESHOLD * 0.999].tolist()
    best: dict[tuple[int, int], tuple] = {}
    for k in bounded:
        own = term[begins[k] : stops[k]]
        p = int(passage[begins[k]])
        doc = int(np.searchsorted(base, p, "right")) - 1
        while halves[doc] == 0:
            doc -= 1
        a = int(first[doc]) + (p - int(base[doc])) * PIECE
        b = min(a + 2 * PIECE, int(first[doc + 1]))
        found: dict[int, np.ndarray] = {}
        for piece, score in index.wand(own, THRESHOLD):
            sizes = index.sizes(piece)
            for n in sizes:
                if n not in found:
                    found[n] = Index.shingles(words[a:b], n)
            q, r, whole = (share(part[piece], found[n]) for part, n in zip((index.question, index.answer, index.all), sizes, strict=True))
            if whole >= OVERLAP and min(q, r) >= HALF:
                hit = (docs[doc], index.items[piece], a - int(first[doc]), score, q, r)
                at = (doc, index.items[piece])
                if at not in best or best[at][3] < score:
                    best[at] = hit
    return list(best.values())


def pieces_of(items: DataFrame) -> DataFrame:
    """word (hash), n: in how many pieces of the items (item_id, text) it occurs; the word null stands for pieces and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            flat, starts, ends, first = split_words(*text_buffers(b.column(1)), PLAIN)
            words = word_hashes(flat, starts, ends)
            text = text_of(first)
            piece = text * np.int64(1 << 32) + (np.arange(len(words)) - first[text]) // PIECE
            pairs = np.unique(np.column_stack([piece.astype(np.int64), words.astype(np.int64)]), axis=0)
            word = pa.array(pairs[:, 1]).value_counts()
            own = [*np.asarray(word.field(0)).tolist(), None]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([*np.asarray(word.field(1)).tolist(), len(np.unique(piece))], pa.int64()), pa.array([0] * (len(own) - 1) + [len(words)], pa.int64())], names=["word", "n", "words"])

    return items.select("item_id", "text").mapInArrow(run, "word long, n long, words long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def shards(items: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[list[tuple[int, str]], tuple | None]]:
    """(the items, at most about shard_bytes of text at a time; what Index needs to know of all of them)."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // shard_bytes))
    if n == 1:
        yield [tuple(r) for r in items.select("item_id", "text").collect()], None
        return
    counts = cut(pieces_of(items))
    whole = counts.where("word is null").first()
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        own = counts.join(pieces_of(part).select("word"), "word").where("n > 1").select("word", "n").collect()  # as many as a shard has words
        yield [tuple(r) for r in part.select("item_id", "text").collect()], (whole.n, whole.words / max(1, whole.n), dict(map(tuple, own)))


def contaminated(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, item_id, passage, bm25_share, question_overlap, answer_overlap: a row for each document and test item in it."""
    docs = docs_of(docs)
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and item_id is not null")
    found = None
    for part in shards(items, shard_bytes):
        index, name = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], index=index, name=name) -> Iterator[pa.RecordBatch]:
            held = per_worker("bm25", dict)  # a worker keeps one index, built once
            if name not in held:
                held.clear()
                held[name] = Index(*index.value)
            for b in slices(batches, "text", CHUNK):
                rows = search(held[name], b.column(0).to_pylist(), *text_buffers(b.column(1)))
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in HITS]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, HITS, strict=True)], schema=HITS)

        hits = docs.mapInArrow(frugal(run), HITS_DDL)
        found = hits if found is None else found.unionByName(hits)
    return found


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no test item lies; columns as they are. Rows of a null doc_id stay."""
    (leaked,) = fresh(docs, "leaked")
    hits = contaminated(docs, items).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(hits, F.col("doc_id") == F.col(leaked), "left_anti")
