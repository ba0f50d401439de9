"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

The suffixes that matter start at anchors (see repeats.py) that occur more than once, and are as long as the windows of
WIDTH bytes around their anchor need. Scan tasks sort them into runs and front-code each run: of every suffix only what
it does not share with the one before. Runs are exchanged by anchor, and loser trees merge them; a comparison starts
behind the prefix that both sides are known to share with the last suffix put out, and yields the common prefix of
neighbours. A string that starts `o` bytes before an anchor is repeated where the anchor's suffixes share WIDTH - o bytes
and what lies before them, sorted likewise, shares o.

A byte goes if a WIDTH-byte string that covers it also starts earlier, in a smaller document or before in the same.
Null texts are empty. Repeated (doc_id, text) rows are one document twice: they don't remove each other. Rows of a null
doc_id are left out. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, docs_of
from .exact import shared_prefix
from .repeats import merged, recurring, removed, stretches

WIDTH, GRAM = 100, 32
#: Suffixes in a run before it is sorted and sent; suffixes that one merge holds, on average.
RUN, PART = 40_000, 30_000
#: Occurrences beyond which an anchor's windows are dealt out one by one.
HOT = 10_000
FIELDS = ("docs", "places", "nearest", "farthest", "shared", "tail_sizes", "tails", "left_sizes", "lefts")
DDL = "part long, doc_id long, start long, stop long, " + ", ".join(f"{f} binary" for f in FIELDS)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def encode(items: list[tuple]) -> dict[str, bytes]:
    """A sorted run of (suffix, left, doc, place, nearest, farthest), front-coded."""
    shared, before = [], b""
    for x in items:
        shared.append(shared_prefix(before, x[0]))
        before = x[0]
    tails = [x[0][n:] for x, n in zip(items, shared, strict=True)]
    small = lambda v: np.array(v, np.uint16).tobytes()
    wide = lambda k: np.array([x[k] for x in items], np.int64).tobytes()
    return dict(zip(FIELDS, (wide(2), wide(3), small([x[4] for x in items]), small([x[5] for x in items]), small(shared), small(list(map(len, tails))), b"".join(tails), small([len(x[1]) for x in items]), b"".join(x[1] for x in items)), strict=True))


class Run:
    """Decodes a front-coded run one suffix at a time."""

    def __init__(self, blob: dict[str, bytes]):
        small = lambda f: np.frombuffer(blob[f], np.uint16)
        self.docs, self.places = (np.frombuffer(blob[f], np.int64) for f in ("docs", "places"))
        self.nearest, self.farthest, lefts = small("nearest"), small("farthest"), np.cumsum(small("left_sizes"), dtype=np.int64)
        self.lefts = [blob["lefts"][a:b] for a, b in zip([0, *lefts[:-1].tolist()], lefts.tolist(), strict=True)]
        self.shared, self.ends, self.tails = small("shared").tolist(), np.cumsum(small("tail_sizes"), dtype=np.int64).tolist(), blob["tails"]
        self.at, self.suffix = -1, b""

    def step(self) -> int:
        """Go to the next suffix; what it shares with the one before, or -1 at the end."""
        self.at += 1
        if self.at >= len(self.ends):
            self.suffix = None
            return -1
        same = self.shared[self.at]
        self.suffix = self.suffix[:same] + self.tails[self.ends[self.at - 1] if self.at else 0 : self.ends[self.at]]
        return same


class LoserTree:
    """Merges runs. known[r] is what run r's suffix shares with the last winner of its path, so it is never compared again."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.known = [0] * self.size
        for k, r in enumerate(runs):
            if r.step() < 0:
                self.known[k] = -1
        for k in range(len(runs), self.size):
            self.known[k] = -1
        self.losers = [0] * self.size
        self.winner = self.play(1)

    def play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self.play(2 * node), self.play(2 * node + 1)
        w = self.beats(a, b)
        self.losers[node] = b if w == a else a
        return w

    def beats(self, a: int, b: int) -> int:
        """The run with the smaller suffix; the other then knows what it shares with it."""
        known = self.known
        ka, kb = known[a], known[b]
        if ka != kb:
            return a if ka > kb else b
        if ka < 0:
            return a
        x, y = self.runs[a].suffix, self.runs[b].suffix
        same = ka + shared_prefix(x[ka:], y[ka:])
        if same == len(x) or same < len(y) and x[same] < y[same]:
            known[b] = same
            return a
        known[a] = same
        return b

    def merge(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in it, bytes shared with the suffix before) in order."""
        losers, known = self.losers, self.known
        while known[w := self.winner] >= 0:
            run = self.runs[w]
            yield w, run.at, known[w]
            known[w] = run.step()
            node = (w + self.size) // 2
            while node:
                other = losers[node]
                best = self.beats(w, other)
                if best != w:
                    losers[node], w = w, other
                node //= 2
            self.winner = w


def repeated(runs: list[Run], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, stop) of what strings of `width` bytes cover that start earlier too, around the runs' anchors."""
    order = list(LoserTree(runs).merge())
    n = len(order)
    which, at, shared = (np.array(x, np.int64) for x in zip(*order, strict=True))
    pick = lambda f: np.concatenate([getattr(r, f) for r in runs])[np.concatenate([[0], np.cumsum([len(r.ends) for r in runs])])[which] + at]
    docs, places, nearest, farthest = pick("docs"), pick("places"), pick("nearest").astype(np.int64), pick("farthest").astype(np.int64)
    lefts = [runs[r].lefts[k] for r, k, _ in order]
    by_left = sorted(range(n), key=lefts.__getitem__)
    left_shared = np.array([0] + [shared_prefix(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:], strict=False)], np.int64)
    by_left = np.array(by_left)
    age = np.lexsort((places, docs))
    rank = np.empty(n, np.int64)
    changed = np.ones(n, bool)
    changed[1:] = (docs[age][1:] != docs[age][:-1]) | (places[age][1:] != places[age][:-1])
    rank[age] = np.cumsum(changed)
    covered = np.zeros((n, int(farthest.max()) + 3), bool)  # [item, offset + 1]
    nexts = np.append(shared[1:], 0)
    for o in range(int(farthest.max()) + 1):
        depth = width - o
        live = np.flatnonzero((nearest <= o) & (farthest >= o) & ((shared >= depth) | (nexts >= depth)))
        if len(live) < 2:
            continue
        right = np.cumsum(shared < depth)[live]
        group = np.empty(n, np.int64)
        group[by_left] = np.cumsum(left_shared < o)
        key = right * (n + 1) + group[live]
        sort = np.lexsort((rank[live], key))
        first = np.ones(len(live), bool)
        first[1:] = key[sort][1:] != key[sort][:-1]
        oldest = rank[live][sort][np.maximum.accumulate(np.where(first, np.arange(len(live)), 0))]
        covered[live[sort][rank[live][sort] > oldest], o + 1] = True
    edges = np.diff(covered.astype(np.int8), axis=1)
    item, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    return docs[item], places[item] - (high - 1), places[item] - low + width


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, start, stop (in bytes): covered by strings that start earlier too; spans may overlap."""
    keys = cut(recurring(docs, units, width, gram, across=False, hot_above=HOT))
    total = keys.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // PART))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[tuple[bytes, int], tuple] = {}
        part_of: dict[tuple[bytes, int], int] = {}
        settled: list[tuple[int, int, int]] = []

        def flush():
            by_part: dict[int, list] = {}
            for (content, q), (doc, place, near, far) in held.items():
                by_part.setdefault(part_of[content, q], []).append((content[q:], content[:q][::-1], doc, place, near, far))
            rows = [{"part": p} | encode(sorted(own)) for p, own in by_part.items()]
            rows += [{"part": d % parts, "doc_id": d, "start": a, "stop": b} for d, a, b in settled]
            held.clear(), part_of.clear(), settled.clear()
            kinds = [(f, pa.int64()) for f in ("part", "doc_id", "start", "stop")] + [(f, pa.binary()) for f in FIELDS]
            return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], k) for f, k in kinds], names=[f for f, _ in kinds])

        for ids, data, offsets, _, text, key, hot, place, lo, hi in stretches(batches, units, width, gram):
            whole = data.tobytes()
            many = np.where(hot, hi - lo + 1, 1)
            row = np.repeat(np.arange(len(key)), many)
            begin = lo[row] + np.where(hot[row], np.arange(len(row)) - (np.cumsum(many) - many)[row], 0)
            last = np.where(hot[row], begin, hi[row])
            where = np.where(hot[row], begin, place[row])
            of = text[row]
            for doc, base, k, one, a, z, p in zip(ids[of].tolist(), offsets[of].tolist(), key[row].tolist(), hot[row].tolist(), begin.tolist(), last.tolist(), where.tolist(), strict=True):
                content, q = whole[a : z + width], p - a
                mine = (doc, p - base, p - z, p - a)
                old = held.get((content, q))
                if old is None:
                    held[content, q] = mine
                    part_of[content, q] = (xxhash.xxh3_64_intdigest(content) if one else k) % parts
                elif old[:2] != mine[:2]:  # of equal stretches in a run the later one is repeated as a whole
                    first, later = min(old, mine), max(old, mine)
                    held[content, q] = first
                    settled.append((later[0], later[1] - later[3], later[1] - later[2] + width))
            if len(held) >= RUN or len(settled) >= RUN:
                yield flush()
        if held or settled:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = None, []

        def out():
            return pa.RecordBatch.from_arrays(list(map(pa.array, repeated(runs, width))), names=["doc_id", "start", "stop"])

        for b in batches:
            settled = b.column("docs").is_null()
            yield b.filter(settled).select(["doc_id", "start", "stop"])
            for row in b.filter(pa.compute.invert(settled)).to_pylist():
                if row["part"] != part and runs:
                    yield out()
                    runs = []
                part = row["part"]
                runs.append(Run(row))
        if runs:
            yield out()

    rows = docs.join(keys, "doc_id").select("doc_id", "text", "keys", "hot").mapInArrow(sort, DDL)
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "doc_id long, start long, stop long")


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of remaining bytes), spans removed (start, stop in bytes)."""
    docs = docs_of(docs).where("doc_id is not null")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                own = text.as_buffer().to_pybytes() if text.is_valid else b""
                gone = merged([(x["start"], x["stop"]) for x in spans or ()])
                bounds = [0, *(x for pair in gone for x in pair), len(own)]
                kept = b"".join(own[a:z] for a, z in zip(bounds[::2], bounds[1::2], strict=True)) if gone else own
                for c, v in zip(cols, (len(own), len(own) - len(kept), len(gone), sha256(kept).hexdigest(), [{"start": a, "stop": z} for a, z in gone]), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return removed(docs, repeated_spans(docs, width, gram)).select("doc_id", "text", "spans").mapInArrow(finish, ddl)
