"""What finds candidates for repeated passages of `width` units (words or bytes), and cuts passages out.

Every window of `width` units has an anchor: the leftmost of its least-hashed grams of `gram` units, so equal windows
have equal anchors wherever they lie. Only grams that anchor twice can anchor a repeated window; stretches around them
are exchanged, everything else stays where it is. Anchors are a few hundredths of all positions.

A gram that anchors very often is hot: its windows are dealt out one by one by their content, so no task gets them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_buffers
from .tokens import range_hashes, sliding_min

CHUNK, BITS = 1 << 19, 44
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def anchors(values: np.ndarray, first: np.ndarray, width: int, gram: int):
    """(key, text, place, lo, hi) of all anchors: gram hash, text, its place in values, and the first and last window it anchors."""
    n = len(values) - gram + 1
    empty = np.zeros(0, np.int64)
    if n < 1:
        return empty, empty, empty, empty, empty
    at = np.arange(n)
    keys = range_hashes(values, at, at + gram)
    place_bits = np.uint64(32)  # the same everywhere, so equal windows break ties alike: leftmost
    least = sliding_min((keys >> place_bits << place_bits) | at.astype(np.uint64), width - gram + 1)
    window = np.arange(len(least))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
    inside = window + width <= first[text + 1]
    window, text = window[inside], text[inside]
    place = (least[inside] & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    if not len(window):
        return empty, empty, empty, empty, empty
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(window)) - 1
    return (keys[place[lo]] >> np.uint64(64 - BITS)).astype(np.int64), text[lo], place[lo], window[lo], window[hi]


def recurring(docs: DataFrame, units: Units, width: int, gram: int, across: bool, hot_above: int) -> DataFrame:
    """doc_id, keys, hot (keys that anchor more than hot_above times): a document's anchors that occur again (across: in another document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            key, text, *_ = anchors(*units(*text_buffers(b.column(1))), width, gram)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[text]), pa.array(key)], names=["doc_id", "key"])

    rows = docs.mapInArrow(run, "doc_id long, key long")
    if across:
        counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    else:
        counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    counts = cut(counts)  # so both sides of the join are dealt out anew, and Spark can split the tasks of a hot anchor
    hot = F.when(F.col("n") > hot_above, F.col("key"))
    return rows.join(counts, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"), F.collect_set(hot).alias("hot"))


def stretches(batches: Iterator[pa.RecordBatch], units: Units, width: int, gram: int):
    """For batches (doc_id, text, keys, hot): (data, offsets, per anchor that is listed: row, key, hot, place, lo, hi), by chunk."""
    for b in slices(batches, "text", CHUNK):
        data, offsets = text_buffers(b.column("text"))
        values, first = units(data, offsets)
        key, text, place, lo, hi = anchors(values, first, width, gram)
        own, hot = ((np.repeat(np.arange(b.num_rows), np.diff(b.column(n).offsets.to_numpy())), b.column(n).flatten().to_numpy()) for n in ("keys", "hot"))
        wanted = member(text, key, *own)
        text, key, place, lo, hi = (x[wanted] for x in (text, key, place, lo, hi))
        yield b.column("doc_id").to_numpy(), data, offsets, first, text, key, member(text, key, *hot), place, lo, hi


def member(text, key, of, keys) -> np.ndarray:
    """Whether each (text, key) is among the pairs (of, keys)."""
    mix = lambda t, k: (t.astype(np.uint64) << np.uint64(BITS)) | k.astype(np.uint64)
    return np.isin(mix(text, key), mix(of, keys))


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (doc_id, text) with spans (list of starts and stops, in units), null where none."""
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.join(lists, "doc_id", "left")


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping and touching spans as maximal ones, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def candidates(docs: DataFrame, units: Units, width: int, gram: int, across: bool, hot_above: int) -> DataFrame:
    """docs with keys and hot: only those that have a recurring anchor."""
    keys = cut(recurring(docs, units, width, gram, across, hot_above))
    return docs.join(keys, "doc_id")
