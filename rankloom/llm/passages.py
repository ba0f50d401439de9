"""Substring dedup by repeated-phrase automata.

Passages of WIDTH words that recur are confirmed by count and compiled into Aho-Corasick automata (one after another in
each shard, each of bounded size). All stretches of documents around anchors that recur stream through them in the order
of documents; the automaton locates every occurrence, and whose is first owns the passage. A word goes if a passage that
covers it also starts in a document with a smaller id. Stretches that a scan task has already read word for word in a
smaller document are settled there, so that copies are sent once.

Null texts have no words. Documents of fewer words than a passage lose nothing. Repeated (doc_id, text) rows are one
document twice: they don't remove each other. Rows of a null doc_id are left out. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of
from .repeats import candidates, merged, removed, stretches
from .tokens import EXACT, SEP, range_hashes, split_words, word_hashes

WIDTH, GRAM = 50, 12
BREAK = bytes([SEP])
#: Occurrences beyond which an anchor's windows are dealt out one by one.
HOT = 2_000
#: Windows that one automaton is compiled from, at most (a group of fewer than HOT stretches is never split).
AUTOMATON = 20_000
#: Names of pieces that a scan task remembers to settle equal ones before they are sent.
SEEN = 300_000
SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat, starts, ends, first = split_words(data, offsets, EXACT)
    return word_hashes(flat, starts, ends), first


class Shard:
    """Groups of stretches (doc, start, words): confirms the passages that recur, compiles them, and locates every occurrence."""

    def __init__(self, width: int):
        self.width, self.rows, self.windows = width, [], 0

    def add(self, doc: int, start: int, text: bytes) -> None:
        own = text.split(b" ")
        self.rows.append((doc, start, own))
        self.windows += len(own) - self.width + 1

    def confirmed(self, coded: list[tuple[int, int, tuple]]) -> Iterator[tuple]:
        """Passages (as word numbers) that occur more than once, by count of their hashes."""
        words = np.concatenate([np.array(own, np.int64) for *_, own in coded])
        size = np.array([len(own) for *_, own in coded])
        first = np.cumsum(size) - size
        n = size - self.width + 1
        row = np.repeat(np.arange(len(size)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        _, place, count = np.unique(range_hashes(words, first[row] + at, first[row] + at + self.width), return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[place] > 1)
        for r, k in zip(row[again].tolist(), at[again].tolist(), strict=True):
            yield coded[r][2][k : k + self.width]

    def located(self) -> Iterator[tuple[int, int, int]]:
        """(doc, start, stop) of what an earlier document has too."""
        import ahocorasick

        number: dict[bytes, int] = {}
        coded = [(doc, start, tuple(number.setdefault(w, len(number) + 1) for w in own)) for doc, start, own in self.rows]
        self.rows, self.windows = [], 0
        if not coded:
            return
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for passage in self.confirmed(coded):
            if not automaton.exists(passage):
                automaton.add_word(passage, len(automaton))
        if not len(automaton):
            return
        automaton.make_automaton()
        # documents stream through it from the smallest on: who has a passage first owns it
        owner: list[int | None] = [None] * len(automaton)
        for doc, start, own in sorted(coded, key=lambda x: x[:2]):
            run = None
            for last, k in automaton.iter(own):
                if owner[k] is None:
                    owner[k] = doc
                if owner[k] == doc:
                    continue
                a, b = last - self.width + 1, last + 1
                if run and a <= run[1]:
                    run[1] = b
                else:
                    if run:
                        yield doc, start + run[0], start + run[1]
                    run = [a, b]
            if run:
                yield doc, start + run[0], start + run[1]


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, start, stop (in words): what windows cover that an earlier document has too; spans may overlap."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: dict[tuple[int, bytes], int] = {}
        for ids, data, offsets, first, text, key, hot, _, lo, hi in stretches(batches, words, width, gram):
            flat, starts, ends, _ = split_words(data, offsets, EXACT)
            whole = flat.tobytes()
            # pieces: the words of all windows of an anchor, or of each window where the anchor is hot
            single = np.repeat(hot, np.where(hot, hi - lo + 1, 1))
            row = np.repeat(np.arange(len(key)), np.where(hot, hi - lo + 1, 1))
            begin = lo[row] + np.where(single, np.arange(len(row)) - np.searchsorted(row, row), 0)
            last = np.where(single, begin, hi[row]) + width
            out: list[list] = [[], [], [], [], []]
            if len(seen) > SEEN:
                seen.clear()
            for r, a, b, one in zip(row.tolist(), begin.tolist(), last.tolist(), single.tolist(), strict=True):
                doc, at = int(ids[text[r]]), a - int(first[text[r]])
                piece = b" ".join(filter(None, whole[starts[a] : ends[b - 1]].split(BREAK)))
                name = xxhash.xxh3_128_digest(piece)
                group = int(key[r]) if not one else int.from_bytes(name[:8], "little") >> 1 | 1 << 62
                # what an earlier document of this task has word for word is settled here
                settled = seen.setdefault((group, name), doc) < doc
                for c, v in zip(out, (group, doc, at, at + b - a, None if settled else piece), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names=["group", "doc_id", "start", "stop", "piece"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(width), None

        def rows(found):
            cols = list(zip(*found, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=SPANS)

        for b in batches:
            settled = b.column("piece").is_null()
            yield b.filter(settled).select(SPANS.names)
            for group, doc, start, piece in zip(*(b.filter(pa.compute.invert(settled)).column(k).to_pylist() for k in ("group", "doc_id", "start", "piece")), strict=True):
                if shard.windows > AUTOMATON and group != last:
                    yield rows(list(shard.located()))
                last = group
                shard.add(doc, start, piece)
        yield rows(list(shard.located()))

    pieces = candidates(docs, words, width, gram, across=True, hot_above=HOT).select("doc_id", "text", "keys", "hot").mapInArrow(cut_out, "group long, doc_id long, start long, stop long, piece binary")
    return pieces.repartition("group").sortWithinPartitions("group", "doc_id").mapInArrow(locate, "doc_id long, start long, stop long")


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of kept words joined by a space), spans removed (start, stop in words)."""
    docs = docs_of(docs).where("doc_id is not null")
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,stop:long>>"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in batches:
            cols: list[list] = [[], [], [], []]
            for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                own = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                gone = merged([(x["start"], x["stop"]) for x in spans or ()])
                kept = own
                if gone:
                    bounds = [0, *(x for pair in gone for x in pair), len(own)]
                    kept = [w for a, z in zip(bounds[::2], bounds[1::2], strict=True) for w in own[a:z]]
                for c, v in zip(cols, (len(own), len(own) - len(kept), sha256(b" ".join(kept)).hexdigest(), [{"start": a, "stop": z} for a, z in gone]), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return removed(docs, repeated_spans(docs, width, gram)).select("doc_id", "text", "spans").mapInArrow(finish, ddl)
