"""Exact dedup by Patricia-trie owners.

Texts are compared as UTF-8 bytes without any change. Scan tasks insert full byte strings into compressed radix tries
and hand over each distinct text of a chunk once, so a hot text costs one row per chunk. Rows then meet in partitions
by length and content hash, where tries compare full strings again; a terminal node stores the owner and the count.
A trie over its memory bound spills its heaviest subtrees.

A null text equals an empty one; a null doc_id stays only where no other is. Repeated (doc_id, text) rows count as members of their group each; a row is kept if
its doc_id is the owner's. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of

#: Bytes that one trie takes before it spills subtrees: its strings and so many for each node.
TRIE_BYTES, NODE_BYTES = 48 << 20, 330
OWNERS = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("text", pa.large_binary()), ("owner", pa.int64()), ("members", pa.int64())])


class Node:
    __slots__ = ("label", "children", "owner", "members", "digest")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.members, self.digest = label, {}, None, 0, b""


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal node keeps the smallest (or largest) identifier and a count."""

    def __init__(self, keep: str = "smallest"):
        self.root, self.better, self.size = Node(b""), {"smallest": min, "largest": max}[keep], 0

    def insert(self, key: bytes, ident: int, members: int = 1, digest: bytes = b"") -> bool:
        """Whether the string is new."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(key) - at + NODE_BYTES
                node, at = child, len(key)
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            rest = key[at : at + len(label)]
            same = shared_prefix(label, rest)
            upper = Node(label[:same])
            child.label = label[same:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            self.size += NODE_BYTES
            node, at = upper, at + same
        new = node.owner is None
        node.owner = ident if new else self.better(node.owner, ident)
        node.members += members
        node.digest = digest or node.digest
        return new

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        todo = [(node or self.root, prefix)]
        while todo:
            x, before = todo.pop()
            key = before + x.label
            if x.owner is not None:
                yield key, x
            todo += [(c, key) for c in x.children.values()]

    def weight(self, node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.label) + NODE_BYTES
            todo += x.children.values()
        return total

    def spill(self, target: int) -> Iterator[tuple[bytes, Node]]:
        """Cut off the heaviest subtrees below the root until `target` bytes are left, and yield their terminals."""
        for weight, byte in sorted(((self.weight(c), b) for b, c in self.root.children.items()), reverse=True):
            if self.size <= target:
                return
            yield from self.terminals(self.root.children.pop(byte))
            self.size -= weight


def shared_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def distinct_texts(docs: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: length, digest (SHA-256), text (bytes), owner (doc_id that stays), members."""

    def rows(found) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], [], [], []]
        held = 0
        for key, node in found:
            for c, v in zip(cols, (len(key), node.digest, key, node.owner, node.members), strict=True):
                c.append(v)
            held += len(key)
            if held > trie_bytes // 4:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OWNERS, strict=True)], schema=OWNERS)
                cols, held = [[], [], [], [], []], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OWNERS, strict=True)], schema=OWNERS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(keep)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                key = text.as_buffer().to_pybytes() if text.is_valid else b""
                trie.insert(key, doc)
            if trie.size > trie_bytes:
                yield from rows(hashed(trie.spill(trie_bytes // 2)))
        yield from rows(hashed(trie.terminals()))

    def hashed(found):
        import hashlib

        for key, node in found:
            node.digest = hashlib.sha256(key).digest()
            yield key, node

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by length and digest: when the bucket changes, all strings before are whole and may spill
        trie, last = PatriciaTrie(keep), None
        for b in batches:
            for length, digest, key, owner, members in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if trie.size > trie_bytes and (length, digest) != last:
                    yield from rows(trie.spill(0))
                last = (length, digest)
                trie.insert(key, owner, members, digest)
        yield from rows(trie.terminals())

    nobody = F.lit((1 << 63) - 1 if keep == "smallest" else -(1 << 63))
    schema = "length long, digest binary, text binary, owner long, members long"
    local = docs_of(docs).select(F.coalesce("doc_id", nobody), "text").mapInArrow(scan, schema)
    merged = local.repartition("length", "digest").sortWithinPartitions("length", "digest").mapInArrow(merge, schema)
    return merged.withColumn("owner", F.nullif("owner", nobody))


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex)."""
    owners = distinct_texts(docs, keep).select(F.lower(F.hex("digest")).alias("text_sha256"), F.col("owner").alias("keep_id"), F.col("members").alias("group_size"))
    own = docs_of(docs).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return own.join(owners, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
