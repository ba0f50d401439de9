"""Best-two-fit packing of token sequences into fixed-size bins.

Documents are tokenized once, cut into pieces of at most `capacity` tokens, and the pieces are packed. Each packing
task fills bins greedily (largest piece that fits) and then tries to replace the bin's smallest piece by two pieces
not yet packed that fit the widened gap more tightly.

Nulls and empty texts are documents of one token (the separator). Repeated rows are packed as often as they occur.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, docs_of, frugal, per_worker

CAPACITY = 2048
#: Pieces that one packing task handles; a bin left open at its end is the only loss of packing in parallel.
PIECES_PER_TASK = 250_000
#: Distinct chunks and words that a worker keeps encoded during a task; beyond that it starts anew. Speed only.
MEMO = 300_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def unassigned() -> str:
    """Code points without a character in Python's own tables that the newer ones of `regex` have, as ranges."""
    from unicodedata import category

    import regex

    found = regex.findall(r"\P{Cn}", "".join(c for c in map(chr, range(0x110000)) if category(c) == "Cn"))
    ranges: list[list[int]] = []
    for p in map(ord, found):
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class WordBpe:
    """Ids of a lower-casing word-end BPE as bytes (little-endian uint32), memoised by white-space separated chunk.

    A token with a word end is spelled with the byte FF, which UTF-8 never uses, at its end; ranks are the ids.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, spec: str):
        import json
        import unicodedata

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
        ranks = {}
        for token, rank in json.loads(spec)["model"]["vocab"].items():
            stem = token.removesuffix("</w>")
            if stem and all(c in byte_of for c in stem):
                ranks[bytes(byte_of[c] for c in stem) + b"\xff" * (stem != token)] = rank
        special = {"<|startoftext|>", "<|endoftext|>"}
        ranks = {k: v for k, v in ranks.items() if k.decode("latin-1") not in special}
        ranks[b"\xff"] = max(ranks.values()) + 10
        self._piece = tiktoken.Encoding("word_ends", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._split = regex.compile(self.PATTERN).findall
        self._nfc = unicodedata.normalize
        self._whole = Tokenizer.from_str(spec)
        self._whole.encode_special_tokens = True
        # characters of which the tokenizer's own rules may know more than Python's tables
        self._odd = regex.compile(rf"[Σİ\p{{M}}\p{{Cn}}\p{{Co}}\p{{Cs}}{unassigned()}]").search
        self._special = regex.compile(r"<\|(start|end)oftext\|>").search
        self._memo: dict[str, bytes | None] = {}  # None: a chunk for the tokenizer
        self._words: dict[str, bytes] = {}

    def forget(self) -> None:
        self._memo.clear()
        self._words.clear()

    def _chunk(self, chunk: str) -> bytes | None:
        if not chunk.isascii() and max(chunk) >= "\u0130" and self._odd(chunk):  # nothing below is odd
            return None
        chunk = self._nfc("NFC", chunk).lower()
        known, out = self._words, b""
        for word in (chunk,) if chunk.isascii() and chunk.isalpha() else self._split(chunk):
            if word not in known:
                known[word] = array("I", self._piece(word.encode() + b"\xff")).tobytes()
            out += known[word]
        return out

    def __call__(self, text: str) -> bytes:
        # what str.split() takes for white space and the tokenizer doesn't, and spelled-out special tokens
        if not (any(c in text for c in "\x1c\x1d\x1e\x1f") or "<|" in text and self._special(text)):
            memo, chunks = self._memo, text.split()
            try:
                return b"".join([memo[c] for c in chunks])
            except KeyError:
                if len(memo) + len(self._words) > MEMO:
                    self.forget()
                for c in chunks:
                    if c not in memo:
                        memo[c] = self._chunk(c)
                found = [memo[c] for c in chunks]
                if None not in found:
                    return b"".join(found)
            except TypeError:  # an odd chunk
                pass
        import numpy as np

        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of its little-endian unsigned 32-bit ids)."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end, step = separator.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(("word_bpe", zlib.crc32(spec.value.encode())), lambda: WordBpe(spec.value))
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for col, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECES, strict=True)], schema=PIECES)
        encode.forget()

    return docs_of(docs).mapInArrow(frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Shelf:
    """Indexes of unpacked pieces by length, with the set of lengths in stock as bits of one integer."""

    def __init__(self, lengths: list[int]):
        self.stock: dict[int, list[int]] = {}
        for i, n in enumerate(lengths):
            self.stock.setdefault(n, []).append(i)
        self.bits = sum(1 << n for n in self.stock)

    def take(self, n: int) -> int:
        own = self.stock[n]
        i = own.pop()
        if not own:
            self.bits ^= 1 << n
        return i

    def put(self, n: int, i: int) -> None:
        self.stock.setdefault(n, []).append(i)
        self.bits |= 1 << n

    def largest(self, most: int) -> int:
        """The largest length in stock up to `most`, or 0."""
        return max(0, (self.bits & ((2 << most) - 1)).bit_length() - 1) if most > 0 else 0

    def pair(self, most: int, least: int) -> tuple[int, int] | None:
        """Two pieces in stock whose sum is as near as possible to `most` and above `least`."""
        best, found = least, None
        a = self.largest(most - 1)
        while a and 2 * a > best:
            b = self.largest(min(most - a, a))
            if b == a and len(self.stock[a]) < 2:
                b = self.largest(b - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == most:
                    break
            a = self.largest(a - 1)
        return found


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into lengths; every length must be from 1 to capacity."""
    shelf, bins = Shelf(lengths), []
    while shelf.bits:
        own: list[tuple[int, int]] = []
        gap = capacity
        while n := shelf.largest(gap):
            own.append((n, shelf.take(n)))
            gap -= n
        if gap and shelf.bits:
            n, i = own[-1]  # greedily filled: the last is the smallest
            if two := shelf.pair(gap + n, n):
                own[-1:] = [(m, shelf.take(m)) for m in two]
                shelf.put(n, i)
        bins.append([i for _, i in own])
    return bins


def pack(rows: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (1 to capacity); other columns pass through."""
    rows = cut(rows)
    tasks = max(1, -(-rows.count() // per_task))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = [b for b in batches if b.num_rows]
        if not own:
            return
        data = pa.Table.from_batches(own)
        lengths = data.column("length").to_pylist()
        first = TaskContext.get().partitionId() << 40
        seq, offset = [0] * len(lengths), [0] * len(lengths)
        for k, members in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in members:
                seq[i], offset[i] = first + k, at
                at += lengths[i]
        yield from data.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).to_batches()

    dealt = rows.coalesce(1) if tasks == 1 else rows.repartition(tasks, F.xxhash64("doc_id", "piece"))
    return dealt.sortWithinPartitions("doc_id", "piece").mapInArrow(frugal(run), schema)  # the same order whenever a task runs again


def pack_documents(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; tokenizer is the path of a tokenizer file on the driver."""
    path = tokenizer() if callable(tokenizer) else tokenizer
    return pack(pieces(docs, Path(path).read_text(encoding="utf-8"), capacity), capacity)
