"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer becomes two deterministic transducers. The first reads classes of characters and emits where
the tokenizer cuts a text before any merges. It has eight states: texts are dealt into chunks, every chunk is read from
all eight states at once, and the chunks' state maps compose through a parallel prefix scan, which gives each chunk the
state it really starts in. The second reads the bytes of one such cut and annotates every transition with the tokens it
emits: the change of the number of tokens, which is negative where a merge takes tokens back. Its states say which
vocabulary entries may still end ahead and which token stood before each; a token follows another if no merge would
reach over their border. States are compiled when a text first needs them and then kept in a table; every cut starts in
the first state, so the map of a cut is one number.

A text beyond BLOCK bytes goes through block by block with the states of both transducers carried over, so memory does
not grow with a text, even if it is one word. What the character classes are is asked of the tokenizer itself, once for
all code points, so both agree whatever version of Unicode it has.

Null and empty texts have no tokens. Special strings of the tokenizer's file inside a text are one token each, as is the
library's default. Repeated rows and null doc_ids are counted as they are; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_of, frugal, per_worker, slices, text_buffers

LIMIT = 512
#: Bytes handled at once; characters of a chunk of the scan; cuts still going below which steps go one by one.
BLOCK, CHUNK, FEW = 1 << 19, 64, 24
#: Compiled transitions that a worker keeps; beyond that it starts anew. Speed only.
TRANSITIONS = 500_000

# what a character is
LETTER, NUMBER, OTHER, SPACE = range(4)
# what the first transducer reads: a character, an apostrophe that begins a contraction of two or three characters, white
# space before white space or the end, a space or other white space before anything else
A_LETTER, A_NUMBER, AN_OTHER, SHORT, LONG, BLANK, LEAD, LAST_BLANK = range(8)
#: The first character of a text is read as from state 0; what fills up the last chunk changes nothing.
FIRST, FILL = 8, 16
# its states: nothing open, letters, numbers, others, white space, a leading space, one or two more of a contraction
NEW, LETTERS, NUMBERS, OTHERS, BLANKS, LED, ONE_MORE, TWO_MORE = range(8)


def boundary_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a cut begins at the character), both indexed by symbol * 8 + state."""
    begins = {A_LETTER: LETTERS, A_NUMBER: NUMBERS, AN_OTHER: OTHERS, SHORT: ONE_MORE, LONG: TWO_MORE, BLANK: BLANKS, LEAD: LED, LAST_BLANK: NEW}
    goes_on = {(LETTERS, A_LETTER): LETTERS, (NUMBERS, A_NUMBER): NUMBERS, (BLANKS, BLANK): BLANKS, (ONE_MORE, A_LETTER): NEW, (TWO_MORE, A_LETTER): ONE_MORE, (LED, A_LETTER): LETTERS, (LED, A_NUMBER): NUMBERS}
    goes_on |= {(state, symbol): OTHERS for state in (OTHERS, LED) for symbol in (AN_OTHER, SHORT, LONG)}
    to, cut = np.zeros((FILL + 1, 8), np.uint8), np.zeros((FILL + 1, 8), bool)
    for symbol, state in begins.items():
        to[symbol], to[symbol + FIRST], cut[symbol], cut[symbol + FIRST] = state, state, True, True
    for (state, symbol), after in goes_on.items():
        to[symbol, state], cut[symbol, state] = after, False
    to[FILL] = np.arange(8)
    return to.ravel(), cut.ravel()


STEP, CUTS = boundary_machine()


def scan(symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """(whether a cut begins at each symbol, last state), from `state` on."""
    n, chunks = len(symbols), -(-len(symbols) // CHUNK)
    full = np.full(chunks * CHUNK, FILL, np.uint8)
    full[:n] = symbols
    base = np.ascontiguousarray(full.reshape(chunks, CHUNK).T) * np.uint8(8)  # a row for each step of all chunks
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for row in base:
        maps = STEP[row[:, None] + maps]
    span = 1
    while span < chunks:  # maps[i] becomes the map of all chunks up to i
        maps[span:] = np.take_along_axis(maps[span:], maps[:-span].astype(np.intp), 1)
        span *= 2
    now = np.concatenate([[np.uint8(state)], maps[:-1, state]])
    cut = np.empty((CHUNK, chunks), bool)
    for k, row in enumerate(base):
        at = row + now
        cut[k], now = CUTS[at], STEP[at]
    return cut.T.ravel()[:n], int(maps[-1, state])


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point of each character, byte where it begins) of UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        where, first = at[wide], lead[wide]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & np.array([0, 0, 0x1F, 0x0F, 0x07], np.int32)[size]
        for k in (1, 2, 3):
            more = size > k
            follow = data[np.minimum(where + k, len(data) - 1)].astype(np.int32) & 0x3F
            point = np.where(more, point << 6 | follow, point)
        lead[wide] = np.minimum(point, 0x10FFFF)
    return lead, at


def character_classes(spec: str) -> np.ndarray:
    """The class of every code point, as the tokenizer's own rules have it: what it leaves in one piece with letters, numbers or signs."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
    points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000])
    out = np.full(0x110000, OTHER, np.uint8)

    def begins(own, before, after):
        """Whether pieces begin at each of these code points and at what is put after it."""
        width = len(before) + 1 + len(after)
        found = np.zeros(width * len(own) + 1, bool)
        for a in range(0, len(own), 1 << 16):
            found[[width * a + start for _, (start, _) in cut("".join(f"{before}{chr(p)}{after}" for p in own[a : a + (1 << 16)].tolist()))]] = True
        return found[len(before) : -1 : width], found[len(before) + 1 :: width]

    points = points[begins(points, "!", "")[0]]  # signs stay in one piece with a sign before
    alone, apart = begins(points, "x", "1")
    out[points] = np.where(~alone, LETTER, np.where(apart | (points == 32), SPACE, NUMBER))  # a space itself goes with what follows
    return out


class Merges:
    """Vocabulary of a byte-level BPE as a trie, and which token may follow which."""

    def __init__(self, spec: dict):
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
        tokens = [bytes([b]) for b in range(256)]
        number = {t: k for k, t in enumerate(tokens)}
        parts: list[tuple[int, int] | None] = [None] * 256
        self.rank: dict[int, int] = {}
        for pair in spec["model"]["merges"]:
            left, right = (number[bytes(byte_of[c] for c in x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = tokens[left] + tokens[right]
            if whole in number:
                raise ValueError("two merges make one token")
            number[whole] = len(tokens)
            self.rank[left << 20 | right] = len(tokens)
            tokens.append(whole)
            parts.append((left, right))
        never = len(tokens)
        # what stands at either edge of a token while it is merged, with the merge that ends it
        self.right, self.left = ([[(t, never)] for t in range(never)] for _ in range(2))
        for t, pair in enumerate(parts):
            if pair:
                self.left[t] += [(pair[0], t), *self.left[pair[0]][1:]]
                self.right[t] += [(pair[1], t), *self.right[pair[1]][1:]]
        self._joins: dict[int, bool] = {}
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for t, text in enumerate(tokens):
            if parts[t] and not self._whole(*parts[t]):
                continue
            node = 0
            for b in text:
                self.inner[node] = True
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = t

    def _whole(self, left: int, right: int) -> bool:
        """Whether the token merged of these comes out of its own bytes: no earlier merge reaches over their border."""
        return not any((r := self.rank.get(a << 20 | b)) is not None and r < fa and r <= fb for a, fa in self.right[left] for b, fb in self.left[right] if (a, b) != (left, right))

    def joins(self, left: int, right: int) -> bool:
        """Whether the tokens may stand side by side: no merge reaches over their border while both sides are merged."""
        key = left << 20 | right
        if key not in self._joins:
            rank = self.rank
            self._joins[key] = not any((r := rank.get(a << 20 | b)) is not None and r < fa and r <= fb for a, fa in self.right[left] for b, fb in self.left[right])
        return self._joins[key]

    def forget(self) -> None:
        self._joins.clear()


class Transducer:
    """The second machine. A state is a tuple of (trie node of the bytes since a border, token before it, tokens up to it less tokens now)."""

    START = ((0, -1, 0),)
    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, merges: Merges):
        self.merges = merges
        self.forget()

    def forget(self, bits: int = 16) -> None:
        self.merges.forget()
        self.states, self.number, self.known = [self.START], {self.START: 0}, {}
        self._resize(bits)

    def _resize(self, bits: int) -> None:
        self.bits, self.keys, self.values = bits, np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        for key, value in self.known.items():
            self._put(key, value)

    def _put(self, key: int, value: int) -> None:
        at = (key * int(self.MULTIPLIER) & (1 << 64) - 1) >> (64 - self.bits)
        while self.keys[at] >= 0:
            at = (at + 1) & (len(self.keys) - 1)
        self.keys[at], self.values[at] = key, value

    def state(self, entries: tuple) -> int:
        if entries not in self.number:
            self.number[entries] = len(self.states)
            self.states.append(entries)
        return self.number[entries]

    def learn(self, key: int) -> int:
        """Compile a transition: state << 8 | byte to next state << 8 | emitted tokens + 128."""
        if key in self.known:
            return self.known[key]
        byte, m, ahead, found = key & 255, self.merges, [], None
        for node, before, rest in self.states[key >> 8]:
            after = m.child.get(node << 8 | byte)
            if after is None:
                continue
            token = m.token[after]
            if token >= 0 and found is None and (before < 0 or m.joins(before, token)):
                found = token, rest + 1
            if m.inner[after]:
                ahead.append((after, before, rest))
        token, emitted = found
        value = self.state((*((n, b, r - emitted) for n, b, r in ahead), (0, token, 0))) << 8 | emitted + 128
        self.known[key] = value
        if 2 * len(self.known) > len(self.keys):
            self._resize(self.bits + 1)
        else:
            self._put(key, value)
        return value

    def step(self, keys: np.ndarray) -> np.ndarray:
        while True:
            at = ((keys.astype(np.uint64) * self.MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)
            odd = np.flatnonzero(self.keys[at] != keys)
            missing = []
            while len(odd):
                empty = self.keys[at[odd]] < 0
                missing += [keys[odd[empty]]]
                odd = odd[~empty]
                at[odd] = (at[odd] + 1) & (len(self.keys) - 1)
                odd = odd[self.keys[at[odd]] != keys[odd]]
            if not any(map(len, missing)):
                return self.values[at]
            for key in np.unique(np.concatenate(missing)).tolist():
                self.learn(key)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, int]:
        """(tokens of each data[start:end], state at the end of the last); the first starts in state `first`, the others in 0."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        begin, size = starts[order], length[order]
        state, tokens = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        state[np.flatnonzero(order == 0)] = first
        going = np.searchsorted(-size, -np.arange(size[0] + 1), "left") if len(size) else [0]  # how many are longer than k
        k = 0
        while going[k] > FEW:
            n = going[k]
            value = self.step(state[:n] << 8 | data[begin[:n] + k])
            state[:n], k = value >> 8, k + 1
            tokens[:n] += (value & 255) - 128
        for i in range(going[k]):
            now, total = int(state[i]), 0
            for byte in data[begin[i] + k : begin[i] + size[i]].tobytes():
                key = now << 8 | byte
                value = self.known.get(key)
                if value is None:
                    value = self.learn(key)
                now, total = value >> 8, total + (value & 255) - 128
            state[i], tokens[i] = now, tokens[i] + total
        out, last = np.zeros(len(order), np.int64), int(state[np.flatnonzero(order == len(order) - 1)[0]])
        out[order] = tokens
        return out, last


class Counter:
    """Counts tokens of byte-level BPE tokenizers whose file has the usual split pattern and no normaliser."""

    def __init__(self, spec: str, classes: np.ndarray):
        parsed = json.loads(spec)
        pre, added = parsed["pre_tokenizer"], parsed["added_tokens"]
        if parsed["model"]["type"] != "BPE" or parsed["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or any(parsed["model"].get(k) for k in ("ignore_merges", "end_of_word_suffix", "continuing_subword_prefix")):
            raise ValueError("not a byte-level BPE with its own split pattern")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take more than their own string")
        self.classes = classes
        self.machine = Transducer(Merges(parsed))
        names = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.first_bytes = names

    def symbols(self, data: np.ndarray, bounds: np.ndarray, ahead: np.ndarray, fresh: bool) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, first byte) of each character; bounds are the first bytes of texts; ahead is what follows the last."""
        points, at = code_points(np.concatenate([data, ahead]) if len(ahead) else data)
        n = int(np.searchsorted(at, len(data)))
        firsts = np.searchsorted(at, bounds)
        kind = self.classes[points]
        following = np.full(len(points), SPACE, np.uint8)  # as if white space followed the end
        following[:-1] = kind[1:]
        following[firsts[1:] - 1] = SPACE
        out = kind.copy()
        blank = kind == SPACE
        out[blank] = LAST_BLANK
        out[blank & (points == 32)] = LEAD
        out[blank & (following == SPACE)] = BLANK
        for i in np.flatnonzero(points[:n] == 39).tolist():
            end = firsts[k] if (k := int(np.searchsorted(firsts, i, "right"))) < len(firsts) else len(points)
            tail = "".join(map(chr, points[i + 1 : min(i + 3, end)].tolist()))
            out[i] = SHORT if tail[:1] in ("s", "t", "m", "d") else LONG if tail in ("re", "ve", "ll") else AN_OTHER
        out = out[:n]
        out[firsts if fresh else firsts[1:]] += FIRST
        return out, at[:n]

    def run(self, data, bounds, ahead=np.zeros(0, np.uint8), carried=None):
        """(tokens of each text, states at the end); the first text goes on from `carried` if given."""
        symbols, at = self.symbols(data, bounds, ahead, carried is None)
        cut, state = scan(symbols, carried[0] if carried else NEW)
        starts = at[cut]
        goes_on = carried is not None and not cut[0]
        if goes_on:
            starts = np.concatenate([[0], starts])
        first = self.machine.state(carried[1]) if goes_on else 0
        tokens, last = self.machine.run(data, starts, np.append(starts[1:], len(data)), first)
        return np.add.reduceat(tokens, np.searchsorted(starts, bounds)), (state, self.machine.states[last])

    def long(self, data: np.ndarray, block: int) -> int:
        total, carried, a, none = 0, None, 0, np.zeros(1, np.int64)
        while a < len(data):
            self.limit()
            b = min(a + block, len(data))
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b += 1
            ahead = data[b : b + 12]
            whole = np.flatnonzero((ahead & 0xC0) != 0x80)
            if b + 12 < len(data) and len(whole) > 2:
                ahead = ahead[: whole[2]]  # two whole characters
            counts, carried = self.run(data[a:b], none, ahead, carried)
            total, a = total + int(counts[0]), b
        return total

    def limit(self) -> None:
        if len(self.machine.known) > TRANSITIONS:
            self.machine.forget()

    def count(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Tokens of each text data[offsets[i]:offsets[i + 1]]."""
        out = np.zeros(len(offsets) - 1, np.int64)
        text = np.flatnonzero(np.diff(offsets))
        starts, ends = offsets[text], offsets[text + 1]
        raw = data.tobytes()
        if self.special and any(s in raw for s in self.first_bytes):
            pieces = []
            for i, a, b in zip(text.tolist(), starts.tolist(), ends.tolist(), strict=True):
                for m in self.special.finditer(raw, a, b):
                    out[i] += 1
                    pieces.append((i, a, m.start()))
                    a = m.end()
                pieces.append((i, a, b))
            text, starts, ends = np.array([p for p in pieces if p[1] < p[2]], np.int64).reshape(-1, 3).T
        big = ends - starts > block
        for i, a, b in zip(text[big].tolist(), starts[big].tolist(), ends[big].tolist(), strict=True):
            out[i] += self.long(data[a:b], block)
        text, starts, ends = text[~big], starts[~big], ends[~big]
        group = np.cumsum(ends - starts) // block
        for g in np.split(np.arange(len(text)), np.flatnonzero(np.diff(group)) + 1):
            if not len(g):
                continue
            self.limit()
            bounds = np.concatenate([[0], np.cumsum(ends[g] - starts[g])])
            together = ends[g[-1]] - starts[g[0]] == bounds[-1]
            flat = data[starts[g[0]] : ends[g[-1]]] if together else np.concatenate([data[a:b] for a, b in zip(starts[g], ends[g], strict=True)])
            np.add.at(out, text[g], self.run(flat, bounds[:-1])[0])
        return out


@functools.cache
def compiled_classes(spec: str) -> bytes:
    return zlib.compress(character_classes(spec).tobytes())


def counter(spec: str) -> Counter:
    """A counter for the text of a tokenizer file."""
    return Counter(spec, np.frombuffer(zlib.decompress(compiled_classes(spec)), np.uint8))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); tokenizer_path is on the driver."""
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    sent = docs.sparkSession.sparkContext.broadcast((spec, compiled_classes(spec)))  # the size of the tokenizer's file
    name = zlib.crc32(spec.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            text, classes = sent.value
            return Counter(text, np.frombuffer(zlib.decompress(classes), np.uint8))

        own = per_worker(("token_counter", name), make)
        for b in slices(batches, "text", BLOCK):
            data, offsets = text_buffers(b.column(1))
            tokens = own.count(data, offsets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs_of(docs).mapInArrow(frugal(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
