"""N-gram Jaccard join by prefix trees.

A document's set holds the hashes of its distinct word n-grams, in one global order. The join is exact:

1. Documents of equal sets form one class; from here on a class is its smallest document.
2. Similar sets share rare members of their prefixes: of the least `1 - t + EXTRA` of each set. Members that no other
   set has in its prefix are useless; a set with too few others has no partner and leaves.
3. The rest meet by the rarest prefix members they need. Each member's group is joined with its smallest document in
   blocks: a trie holds a block's sets, all probes traverse it together, sharing the overlap counted so far, and leave
   subtrees where the members that remain on either side cannot reach the required overlap. This links large groups of
   near copies in linear work.
4. What is left are documents that share prefix members with other components. They leave where too few of these, or
   less than `t` of their whole set, occur under another label. The others are joined with further leads of their groups,
   each time in linear work, and at last across components, in blocks of bounded size.

Groups are dealt out in blocks, so no task holds a whole group. Null and empty texts have an empty set and are linked
with nothing. Repeated rows are copies. Rows of a null doc_id are left out (they can't be told apart). An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, docs_of, forget, frugal, noted, replaced, slices, small, text_buffers
from .components import components
from .tokens import FOLDED, MIX1, mixed, shingle_hashes, split_words, word_hashes

N = 5
#: Jaccard threshold NUM / DEN; the share of a set that its prefix has beyond what one common member needs.
NUM, DEN, EXTRA = 75, 100, 0.10
#: Sets and members in a block of a trie; pairs a document that a group may list; bytes of text handled at once; bits of a member's hash that prefixes are exchanged with.
BLOCK, BLOCK_MEMBERS, PAIRS, CHUNK, BITS = 1024, 1 << 20, 32, 2 << 20, 44
#: Cells (members of a trie times probes) of the table that probes traverse it with at once.
CELLS = 8 << 20
#: Times that documents leave and meet further leads; each round is exact, more of them only narrow what is joined across.
ROUNDS = 3


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, bounds): text k's set is members[bounds[k]:bounds[k + 1]], ascending."""
    flat, starts, ends, first = split_words(data, offsets, FOLDED)
    members, text = shingle_hashes(word_hashes(flat, starts, ends), first, n)
    bounds = np.searchsorted(text, np.arange(len(offsets))).tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        members[a:b].sort()
    new = np.ones(len(members), bool)
    new[1:] = (members[1:] != members[:-1]) | (text[1:] != text[:-1])
    return members[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(offsets) - 1))]).astype(np.int64)


def least_overlap(n: int) -> int:
    """Of a set of n: members it shares at least with any similar set."""
    return -(-NUM * n // DEN)


def required(a: int, b: int) -> int:
    """Overlap at which sets of these sizes are similar."""
    return -(-NUM * (a + b) // (NUM + DEN))


def extra(n: int) -> int:
    return max(1, int(EXTRA * n))


def prefix_size(n: int) -> int:
    return min(n, n - least_overlap(n) + extra(n))


def needed(n: int) -> int:
    """Prefix members that a set of n shares at least with a similar set's prefix, whatever that set's size."""
    return extra(least_overlap(n))


def described(docs: DataFrame, n: int, what: str) -> DataFrame:
    """doc_id and n_shingles with, by `what`: k1, k2 (a set's 128-bit name), or members of the prefix or whole set (binary)."""
    ddl = "doc_id long, n_shingles long, " + ("k1 long, k2 long" if what == "name" else "members binary")
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            members, bounds = sets_of(*text_buffers(b.column(1)), n)
            size = np.diff(bounds)
            if what == "name":
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (members, mixed(members * MIX1))]
                    out = [pa.array((s[bounds[1:]] - s[bounds[:-1]]).astype(np.int64)) for s in sums]
            else:
                take = [prefix_size(x) if what == "prefix" else x for x in size.tolist()]
                out = [pa.array([members[a : a + k].tobytes() for a, k in zip(bounds[:-1].tolist(), take, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), *out], names=names)

    return docs.mapInArrow(run, ddl)


def exploded(sets: DataFrame, bits: int, *also: str) -> DataFrame:
    """sets (doc_id, members, also longs) to doc_id, member: the first `bits` bits of each, and these longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "members", 4 << 20):
            data, size = b.column(1), np.asarray(pa.compute.binary_length(b.column(1))) // 8
            own = np.frombuffer(b"".join(data.to_pylist()), np.uint64) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), size)), pa.array(own.astype(np.int64)), *(pa.array(np.repeat(b.column(c).to_numpy(), size)) for c in also)], names=["doc_id", "member", *also])

    return sets.select("doc_id", "members", *also).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "member", *also)))


class Node:
    __slots__ = ("label", "children", "docs", "low", "high", "rows")

    def __init__(self, label):
        self.label, self.children, self.docs, self.low, self.high = label, {}, [], 1 << 62, 0


class PrefixTree:
    """Ordered sets in a compressed trie; each node knows the smallest and largest set that passes through it."""

    def __init__(self):
        self.root = Node(np.zeros(0, np.uint64))

    def insert(self, doc: int, members: np.ndarray, label: int) -> None:
        node, at, n = self.root, 0, len(members)
        node.low, node.high = min(node.low, n), max(node.high, n)
        while at < n:
            child = node.children.get(key := int(members[at]))
            if child is None:
                child = node.children[key] = Node(members[at:])
                child.low = child.high = n
                node = child
                break
            size = min(len(child.label), n - at)
            differ = np.flatnonzero(child.label[:size] != members[at : at + size])
            same = int(differ[0]) if len(differ) else size
            if same < len(child.label):
                upper = Node(child.label[:same])
                upper.low, upper.high = child.low, child.high
                child.label = child.label[same:]
                upper.children[int(child.label[0])] = child
                node.children[key] = child = upper
            child.low, child.high = min(child.low, n), max(child.high, n)
            node, at = child, at + same
        node.docs.append((doc, label))

    def similar(self, probes: list[np.ndarray], labels: np.ndarray) -> Iterator[tuple[int, int]]:
        """(number of a probe, document) wherever the two sets are similar and the labels differ."""
        nodes, todo = [], [self.root]
        while todo:
            nodes.append(node := todo.pop())
            todo += node.children.values()
        if len(probes) == 1:
            yield from ((0, doc) for doc in self.walk(nodes, probes[0], labels[0]))
            return
        vocabulary = np.unique(np.concatenate([x.label for x in nodes])) if nodes else np.zeros(0, np.uint64)
        if not len(vocabulary):
            return
        for x in nodes:
            x.rows = np.searchsorted(vocabulary, x.label)
        step = max(1, CELLS // len(vocabulary))
        for first in range(0, len(probes), step):
            for k, doc in self.traverse(vocabulary, probes[first : first + step], labels[first : first + step]):
                yield first + k, doc

    def walk(self, nodes: list[Node], probe: np.ndarray, label: int) -> Iterator[int]:
        """traverse for one probe, as most tasks have: its members are looked up for all nodes at once, and sums are numbers."""
        n = len(probe)
        if not n:
            return
        members = np.concatenate([x.label for x in nodes])
        at = np.searchsorted(probe, members)
        held = probe[np.minimum(at, n - 1)] == members
        ends = np.cumsum([len(x.label) for x in nodes])
        upto = np.concatenate([[0], np.cumsum(held)])[ends].tolist()
        # members of the probe up to the label's end; the root has no label and is first
        behind = (at + held)[np.maximum(ends - 1, 0)].tolist() if len(members) else [0]
        for x, before, after, end in zip(nodes, [0, *upto], upto, behind, strict=False):
            x.rows = (after - before, end)
        least, todo = least_overlap(n), [(c, 0, 0) for c in self.root.children.values()]
        while todo:
            node, depth, shared = todo.pop()
            if NUM * node.low > DEN * n or node.high < least:
                continue
            found, end = node.rows
            depth, shared = depth + len(node.label), shared + found
            if shared + min(n - end, node.high - depth) < required(n, max(node.low, depth)):
                continue
            if node.docs and shared >= required(n, depth):
                yield from (doc for doc, other in node.docs if other != label)
            todo += [(c, depth, shared) for c in node.children.values()]

    def traverse(self, vocabulary: np.ndarray, probes: list[np.ndarray], labels: np.ndarray) -> Iterator[tuple[int, int]]:
        n = np.array([len(p) for p in probes])
        has = np.zeros((len(vocabulary), len(probes)), np.uint8)
        for k, p in enumerate(probes):
            at = np.minimum(np.searchsorted(vocabulary, p), len(vocabulary) - 1)
            has[at[vocabulary[at] == p], k] = 1
        upto = np.cumsum(has, 0, np.int32)
        least = -(-NUM * n // DEN)
        todo = [(c, 0, np.zeros(len(probes), np.int64), np.arange(len(probes))) for c in self.root.children.values()]
        while todo:
            node, depth, shared, live = todo.pop()
            fits = (NUM * node.low <= DEN * n[live]) & (node.high >= least[live])
            if not fits.any():
                continue
            shared, live, depth = shared[fits], live[fits], depth + len(node.label)
            rows = has[node.rows] if len(live) * 2 > len(probes) else has[node.rows[:, None], live]
            for k in range(0, len(rows), 255):  # sums of bytes stay bytes
                part = np.add.reduce(rows[k : k + 255], 0, np.uint8)
                shared = shared + (part[live] if len(part) != len(live) else part)
            # what a probe has behind the label's end, and the largest set here, can still add
            left = np.minimum(upto[-1, live] - upto[node.rows[-1], live], node.high - depth)
            able = shared + left >= -(-NUM * (n[live] + max(node.low, depth)) // (NUM + DEN))
            if not able.any():
                continue
            shared, live = shared[able], live[able]
            if node.docs:
                near = live[shared >= -(-NUM * (n[live] + depth) // (NUM + DEN))]
                for doc, label in node.docs:
                    for k in near[labels[near] != label].tolist():
                        yield k, doc
            todo += [(c, depth, shared, live) for c in node.children.values()]


def trie_join(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (task long, probe boolean, doc_id, label) to links (a, b): similar pairs of a task's probes and members of other labels, a < b."""
    found = rows.join(sets.select("doc_id", "members"), "doc_id").select("task", "probe", "doc_id", "members", "label")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tree, docs, probes, labels = None, PrefixTree(), [], [], []

        def met():
            pairs = {(min(docs[k], x), max(docs[k], x)) for k, x in tree.similar(probes, np.array(labels, np.int64))}
            docs.clear(), probes.clear(), labels.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], schema=schema)

        for b in slices(batches, "members", 4 << 20):
            for k, probe, doc, blob, label in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if k != task:
                    if docs:
                        yield met()
                    task, tree = k, PrefixTree()
                members = np.frombuffer(blob, np.uint64)
                if probe:
                    docs.append(doc), probes.append(members), labels.append(label)
                else:
                    tree.insert(doc, members, label)
        if docs:
            yield met()

    return found.repartition("task").sortWithinPartitions("task", "probe", "doc_id").mapInArrow(frugal(run), "a long, b long").distinct()


def block_of(count: Column, members: Column, doc: Column) -> Column:
    """The block of a document in a group of so many documents with so many members in all."""
    return F.pmod(F.xxhash64(F.lit("block"), doc), blocks_in(count, members))


def blocks_in(count: Column, members: Column) -> Column:
    return F.greatest(F.ceil(count / BLOCK), F.ceil(members / BLOCK_MEMBERS))


def lead_tasks(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """pairs (lead, lead_label, doc_id, label): each lead against blocks of its documents. Pairs and tasks are written: a plan that reads a step several times repeats all of it each time, and the driver holds, describes and plans that anew with every stage."""
    pairs = cut(pairs.distinct().join(small(sizes), "doc_id"))
    totals = pairs.groupBy("lead").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    own = pairs.join(totals, "lead").select(F.xxhash64("lead", block_of(F.col("n"), F.col("m"), F.col("doc_id")).alias("block")).alias("task"), "doc_id", "label", "lead", "lead_label")
    own = replaced(cut(own), pairs)
    return replaced(cut(own.select("task", F.lit(False).alias("probe"), "doc_id", "label").union(own.select("task", F.lit(True), "lead", "lead_label").distinct())), own)


def star_tasks(met: DataFrame, sizes: DataFrame, turn: int = 0) -> DataFrame:
    """Each member's group against one of its documents: the smallest, in later turns one that is drawn; met may have labels."""
    rank = F.col("doc_id") if turn == 0 else F.xxhash64(F.lit(turn), "doc_id")
    label = F.col("label") if "label" in met.columns else F.col("doc_id")
    own = met.select("member", "doc_id", label.alias("label"), rank.alias("rank"))
    lead = own.groupBy("member").agg(F.min(F.struct("rank", "doc_id", "label")).alias("lead"))
    apart = own.join(lead, "member").where("label != lead.label").select(F.col("lead.doc_id").alias("lead"), F.col("lead.label").alias("lead_label"), "doc_id", "label")
    return lead_tasks(apart, sizes)


def joined(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """trie_join of tasks, which are deleted; written and counted."""
    return replaced(counted(trie_join(tasks, sets)), tasks)


def cross_tasks(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """met (member, doc_id, label): what could link a group's labels to each other.

    Groups of the same documents count once. Where a group has at most PAIRS pairs of different labels a document, these
    are listed (of fitting sizes), as many groups have them in common. Other groups are joined by blocks: documents of a label that fills more
    than a block lie in blocks of their own, which aren't joined with each other; all others share blocks.
    """
    twin = met.groupBy("member").agg(F.count("*").alias("n"), *(F.sum(F.shiftright(F.xxhash64(F.lit(k), "doc_id"), 32)).alias(f"x{k}") for k in (1, 2, 3, 4)))
    once = twin.groupBy("n", "x1", "x2", "x3", "x4").agg(F.min("member").alias("member")).select("member")
    met = met.join(once, "member").join(small(sizes), "doc_id").select("member", "doc_id", "label", "n_shingles")

    # pairs of different labels that a group has: few where one label has nearly all documents
    each_label = met.groupBy("member", "label").agg(F.count("*").alias("k"))
    crossing = each_label.groupBy("member").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    met = cut(met.join(crossing.select("member", (F.col("n") * F.col("n") - F.col("kk") <= 2 * PAIRS * F.col("n")).alias("few")), "member"))
    short = met.where("few").select("member", "doc_id", "label", "n_shingles")
    other = short.select("member", F.col("doc_id").alias("lead"), F.col("label").alias("label2"), F.col("n_shingles").alias("n2"))
    fits = (F.least("n_shingles", "n2") * DEN >= F.greatest("n_shingles", "n2") * NUM) & (F.col("label") < F.col("label2"))
    pairs = short.join(other, "member").where(fits).select("lead", F.col("label2").alias("lead_label"), "doc_id", "label")

    few = lead_tasks(pairs, sizes)

    large = met.where(~F.col("few")).select("member", "doc_id", "label", "n_shingles")
    filled = large.groupBy("member", "label").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("member", "label", F.lit(True).alias("filled"))
    large = counted(large.join(filled, ["member", "label"], "left").select("member", "doc_id", "label", "n_shingles", F.when(F.col("filled"), F.col("label")).otherwise(F.lit(-1 << 62)).alias("kind")))
    if not noted(large):
        forget(met, large)
        return few
    blocks = cut(large.groupBy("member", "kind").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m")))
    placed = cut(large.join(blocks, ["member", "kind"]).select("member", "kind", block_of(F.col("n"), F.col("m"), F.col("doc_id")).alias("block"), "doc_id", "label"))
    each = blocks.select("member", "kind", F.explode(F.sequence(F.lit(0).cast("long"), (blocks_in(F.col("n"), F.col("m")) - 1).cast("long"))).alias("block"))
    second = each.select("member", F.col("kind").alias("kind2"), F.col("block").alias("block2"))
    both = each.join(second, "member").where((F.struct("kind", "block") <= F.struct(F.col("kind2").alias("kind"), F.col("block2").alias("block"))) & ((F.col("kind") != F.col("kind2")) | (F.col("kind") == -1 << 62)))
    both = cut(both.withColumn("task", F.xxhash64("member", "kind", "block", "kind2", "block2")))
    left = placed.join(both.select("member", "kind", "block", "task"), ["member", "kind", "block"]).select("task", F.lit(False).alias("probe"), "doc_id", "label")
    mine = both.select("member", F.col("kind2").alias("kind"), F.col("block2").alias("block"), "task")
    return replaced(cut(few.union(left).union(placed.join(mine, ["member", "kind", "block"]).select("task", F.lit(True), "doc_id", "label"))), few, met, large, blocks, placed, both)


def with_labels(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return met.withColumn("label", F.col("doc_id"))
    return met.join(small(labels), F.col("doc_id") == F.col("v"), "left").withColumn("label", F.coalesce("label", "doc_id")).drop("v")


def across(met: DataFrame) -> DataFrame:
    """Members of met (member, doc_id, label) that occur under more than one label, with df."""
    return met.groupBy("member").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("member", "df")


def apart(rest: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rest (doc_id, need, own: list of df and member) with label: only members under more than one label, of documents that have `need` of these."""
    met = with_labels(rest.select("doc_id", "need", F.explode("own.member").alias("member")), labels)
    own = met.join(across(met), "member").groupBy("doc_id", "need", "label").agg(F.sort_array(F.collect_set(F.struct("df", "member"))).alias("own"))
    return own.where(F.size("own") >= F.col("need"))


def covered(of: DataFrame, sets: DataFrame) -> DataFrame:
    """Those documents of `of` (doc_id, label) that may be similar to one of another label; written.

    What two sets of different labels share occurs under both labels; a document of which less than the threshold does
    has no partner there.
    """
    of = cut(of)
    own = sets.join(of, "doc_id").select("doc_id", "n_shingles", "label", "members")
    tokens = exploded(own, 60, "label")
    found = tokens.join(across(tokens), "member", "left_semi").groupBy("doc_id").agg(F.count("*").alias("m"))
    return replaced(cut(found.join(own.select("doc_id", "n_shingles"), "doc_id").where(F.col("m") >= F.ceil(F.col("n_shingles") * NUM / DEN)).select("doc_id")), of)


def rarest(rest: DataFrame) -> DataFrame:
    """Of each document's members all but its need - 1 most frequent ones (a partner has at least one of these): member, doc_id, and label if there is one."""
    few = F.slice("own", F.lit(1), (F.size("own") - F.col("need") + 1).cast("int"))
    return rest.select(F.explode(few["member"]).alias("member"), "doc_id", *(["label"] if "label" in rest.columns else []))


def jaccard_links(docs: DataFrame, sizes: DataFrame, n: int = N) -> tuple[DataFrame | None, DataFrame | None]:
    """(links a, b between documents; their components v, label) of the docs that sizes (doc_id, n_shingles) names, whose sets all differ; None: no link."""
    prefixes = described(docs, n, "prefix").join(sizes.select("doc_id"), "doc_id", "left_semi")
    rows = exploded(prefixes, BITS)
    shared = rows.groupBy("member").agg(F.count("*").alias("df")).where("df > 1")
    met = rows.join(shared, "member").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("df", "member"))).alias("own"))  # repeated rows count once
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n_shingles") * NUM / DEN) * EXTRA) - 1)  # needed(n), one less to be safe from rounding
    whole = cut(met.join(sizes, "doc_id").withColumn("need", need.cast("int")).where(F.size("own") >= F.col("need")))
    met = cut(rarest(whole))
    sizes = counted(whole.select("doc_id", "n_shingles"))
    sets = cut(described(docs.join(sizes.select("doc_id"), "doc_id", "left_semi"), n, "set").dropDuplicates(["doc_id"]))
    links = joined(star_tasks(met, sizes), sets)
    labels = components(links) if noted(links) else None
    # what else could be linked; first by the few members that met, then by all of the prefixes
    met = replaced(cut(with_labels(met, labels)), met)
    left = covered(met.join(across(met), "member", "left_semi").select("doc_id", "label").distinct(), sets)
    rest = replaced(counted(apart(whole.join(left, "doc_id", "left_semi"), labels)), whole, left, met)
    for turn in range(1, ROUNDS + 1):
        if not noted(rest):  # nothing is left that could be linked
            forget(sets, sizes, rest)
            return (links, labels) if labels is not None else (None, None)
        more = joined(star_tasks(rarest(rest), sizes, turn), sets)
        if not noted(more):
            break
        links = replaced(counted(links.union(more)), links, more)
        labels = replaced(components(links), labels)
        left = covered(with_labels(rest.select("doc_id"), labels), sets)
        rest = replaced(counted(apart(rest.join(left, "doc_id", "left_semi"), labels)), rest, left)
    more = joined(cross_tasks(rarest(rest), sizes), sets)
    if noted(more):
        links = replaced(counted(links.union(more)), links, more)
        labels = replaced(components(links), labels)
    forget(sets, sizes, rest)
    return (links, labels) if labels is not None else (None, None)


def near_duplicates(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    docs = docs_of(docs).where("doc_id is not null")
    named = cut(described(docs, n, "name"))
    full = named.where("n_shingles > 0")
    classes = full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    _, labels = jaccard_links(docs, classes.select(F.col("rep").alias("doc_id"), "n_shingles"), n)
    of = full.join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "rep")
    if labels is not None:
        of = of.join(labels, F.col("rep") == F.col("v"), "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("rep"))
    return of.select("doc_id", "n_shingles", F.col("rep").alias("component_id")).union(named.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
