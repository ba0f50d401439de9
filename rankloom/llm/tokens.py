"""Words and their hashes over whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

from .common import per_worker

U = np.uint64
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Separates words; UTF-8 never has this byte, and U+0000 may be part of a word.
SEP = 255
#: What each byte becomes. EXACT: white space separates. FOLDED: A-Z lower-cased too. PLAIN: ASCII punctuation separates too.
EXACT = np.array([SEP if b in (32, 9, 10, 11, 12, 13) else b for b in range(256)], np.uint8)
FOLDED = np.array([b + 32 if 65 <= b <= 90 else EXACT[b] for b in range(256)], np.uint8)
PLAIN = np.array([b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else SEP for b in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k < n or more."""

    def make(size):
        with np.errstate(over="ignore"):
            return [np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, U(b))])) for b in (BASE, INVERSE)]

    held = per_worker("powers", dict)  # one pair of arrays, replaced by a larger one when a text needs it
    if len(held.get("pair", [()])[0]) < n:
        held["pair"] = make(max(1 << 16, n + n // 8))
    return held["pair"]


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = EXACT):
    """(bytes after `table`, start of each word, its end, first: words before each text, and in all)."""
    flat = table[data]
    mask = flat != SEP
    edge = np.zeros(len(flat) + 1, bool)
    edge[0] = edge[offsets] = True
    before = np.zeros(len(flat) + 1, bool)
    before[1:] = mask
    after = np.zeros(len(flat) + 1, bool)
    after[:-1] = mask
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return flat, starts, ends, np.searchsorted(starts, offsets)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair; equal ranges have equal hashes wherever they lie."""
    power, inverse = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(U) + U(1)) * power[: len(values)], out=total[1:])
        return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * MIX2)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(flat, starts, ends)


def text_of(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all runs of n words; a text of fewer words has its whole sequence as one, an empty one none."""
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), size)
    at = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[:-1], size)
    return range_hashes(words, at, at + np.minimum(n, count[text])), text


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(x[i:i + w]) for all i with i + w <= len(x)."""
    n, span = len(x), 1
    if n < w:
        return x[:0]
    out = x
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: n - w + 1], out[rest : rest + n - w + 1]) if rest else out[: n - w + 1]
