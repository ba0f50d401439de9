"""Merkle manifest of a dataset: a node store in Parquet, a level at a time.

Each row's fields are hashed into a leaf where the row is read; from then on only digests travel. Leaves are dealt by
ranges of (tree, identifier), sorted in runs and numbered; that is level 0. A level is written from the one before,
which is read once in the order of its coordinates (tree, place): every `fanout` consecutive nodes become one, whose row
also keeps its children's digests, and one folder `level=k` holds each level sorted by coordinate. Nothing but one level's
rows is ever in flight. Proofs come from merge joins by coordinate, from the root down: a node's path is the siblings in
its run followed by its parent's path, so a path is handed to `fanout` children at a time and never gathered. The roots
of all trees are the leaves of one more tree of the same kind.

Values are written with their length in UTF-8 bytes, so no two different rows spell the same leaf; a null is a dash.
Null doc_ids come first in a tree, ties follow the leaf's digest, repeated rows each have a leaf of their own. A null
tree comes before all others. A lone leaf is its tree's root and has an empty proof. An empty table has no root and an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, scratch
from .order import numbered

FANOUT, WIDTH = 8, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def spelled(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    """Digest (32 bytes) of a row."""
    return F.unhex(F.sha2(F.concat(*map(spelled, fields)), 256))


def hex_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def digest_of(digests: Column) -> Column:
    """Digest of digests that stand one after the other, spelled in hexadecimal."""
    return F.unhex(F.sha2(hex_of(digests), 256))


def tree_key(c: Column) -> Column:
    """Never null, and sorted as the values are: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


class Store:
    """The levels of a forest. Level 0: tree, place, size (nodes of the tree at this level), node; above also children."""

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT):
        """leaves: tree, place, size, node, written already."""
        spark, self.fanout = leaves.sparkSession, fanout
        self.path = scratch(spark, "merkle-")
        self.levels = [leaves]
        while not (below := self.levels[-1].where("size > 1")).isEmpty():
            up = F.floor(F.col("place") / fanout).alias("place")
            runs = below.select("tree", up, F.ceil(F.col("size") / fanout).alias("size"), F.struct("place", "node").alias("child"))
            # a run's nodes share (tree, place), so ranges of it keep runs whole and no further exchange is needed
            runs = runs.repartitionByRange("tree", "place").sortWithinPartitions("tree", "place").groupBy("tree", "place", "size").agg(F.array_sort(F.collect_list("child")).alias("run"))
            children = F.unhex(F.array_join(F.transform("run", lambda x: F.hex(x["node"])), ""))
            level = runs.select("tree", "place", "size", children.alias("children")).withColumn("node", digest_of(F.col("children")))
            folder = f"{self.path}/level={len(self.levels)}"
            level.sortWithinPartitions("tree", "place").write.parquet(folder)
            self.levels.append(spark.read.schema(level.schema).parquet(folder))

    def roots(self) -> DataFrame:
        """tree, node: the last node of each tree."""
        out = None
        for level in self.levels:
            own = level.where("size = 1").select("tree", "node")
            out = own if out is None else out.unionByName(own)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """tree, place, path of level 0, from the root down; above: tree, path (what follows the tree's root on the way up).

        A path is an array of (left, right), the digests on either side of a node's own in its run.
        """
        out = None
        for level in self.levels[:0:-1]:
            begun = level.where("size = 1").join(above, "tree").select("tree", "place", "children", "path")
            if out is not None:
                begun = begun.unionByName(level.where("size > 1").select("tree", "place", "children").join(out.hint("merge"), ["tree", "place"]))
            out = self.children(begun)
        lone = self.levels[0].where("size = 1").select("tree", "place").join(above, "tree").select("tree", "place", "path")
        return lone if out is None else out.unionByName(lone)

    def children(self, nodes: DataFrame) -> DataFrame:
        """tree, place, path of the children of nodes (tree, place, children, path)."""
        n = (F.octet_length("children") / WIDTH).cast("int")
        each = nodes.select("tree", "place", "children", "path", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
        left = F.expr(f"substring(children, 1, k * {WIDTH})")
        right = F.expr(f"substring(children, (k + 1) * {WIDTH} + 1)")
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        return each.select("tree", (F.col("place") * self.fanout + F.col("k")).alias("place"), F.concat(step, "path").alias("path"))


#: A path of no steps.
NO_PATH = "cast(array() as array<struct<left: binary, right: binary>>)"


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest_of(F.concat(step["left"], node, step["right"])))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level and left to right."""
    return F.aggregate(path, F.lit(b""), lambda all_, step: F.concat(all_, step["left"], step["right"]))


class Manifest:
    """Leaves, store and root of a dataset. rows: identifier, leaf, any carried columns, tree, place, size."""

    def __init__(self, docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", key: str = "doc_id", fanout: int = FANOUT, **carried: Column):
        """carried: further columns of digests, computed where the rows are read (e.g. another version's leaf)."""
        own = [F.col(f"`{c}`") for c in fields]
        narrow = cut(docs.select(F.col(f"`{key}`").alias("key"), tree_key(F.col(f"`{tree}`")).alias("tree"), leaf_of(*own).alias("node"), *(c.alias(name) for name, c in carried.items())))
        self.rows = numbered(narrow, ["tree"], [F.col("key").asc_nulls_first(), F.col("node")], "place", "size")
        forget(narrow)
        self.store = Store(self.rows.select("tree", "place", "size", "node"), fanout)
        tops = cut(self.store.roots().select("tree", "node"))
        lined = numbered(tops.withColumn("all", F.lit("")), ["all"], [F.col("tree")], "place", "size")
        self.trees = lined.select("tree", "place", F.col("node").alias("subroot"))
        self.top = Store(lined.select(F.col("all").alias("tree"), "place", "size", "node"), fanout)
        forget(tops)
        last = self.top.roots().first()  # one digest
        self.root = bytes(last["node"]) if last else None

    def proofs(self) -> DataFrame:
        """rows with subroot and path, from the leaf to the root of all."""
        above = self.top.paths(self.top.roots().select("tree", F.expr(NO_PATH).alias("path")))
        trees = cut(self.trees.join(above.select("place", "path"), "place").select("tree", "subroot", "path"))  # a row for each tree
        paths = self.store.paths(trees.select("tree", "path"))
        return self.rows.join(paths.hint("merge"), ["tree", "place"]).join(trees.select("tree", "subroot"), "tree")


def tampered_leaves(docs: DataFrame, one_in: int = 3) -> dict[str, Column]:
    """A second leaf for rows whose id's checksum is divisible: as if A-Z of the text had been lower-cased; else null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.col("text").cast("string"), upper, upper.lower())
    other = leaf_of(*(lowered if c == "text" else F.col(c) for c in FIELDS))
    return {"tampered": F.when(F.crc32(F.col("doc_id").cast("string")) % one_in == 0, other)}


def manifest_digest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf where there is one), verified."""
    m = Manifest(docs, fanout=fanout, **tampered_leaves(docs))
    root = F.lit(m.root.hex() if m.root else None).cast("string")
    out = m.proofs().select(
        F.col("key").alias("doc_id"), hex_of(F.col("node")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(hex_of(siblings(F.col("path"))), 256).alias("proof_sha256"), hex_of(folded(F.col("path"), F.coalesce("tampered", "node"))).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 9, top_levels: int = 4, fanout: int = FANOUT) -> str:
    """The same in SQL, for up to fanout ** levels leaves a tree and fanout ** top_levels trees."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars")) + f" || {field(text)})"
    step = "list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), {})"
    byte = "xor(a, b)"
    crc = f"xor(list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint), lambda a, b: {step.format(byte)}, 4294967295::bigint), 4294967295::bigint)"
    parts = [
        "d as (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents)",
        f"h as (select doc_id, coalesce('=' || lang, '') as tree, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf('low')} end as tampered from d)",
        "l0 as (select *, leaf as node, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as size from h)",
    ]

    def climb(name: str, n: int) -> None:
        for k in range(n):
            parts.append(f"{name}r{k} as (select tree, place // {fanout} as place, (size + {fanout - 1}) // {fanout} as size, list(node order by place) as kids from {name}{k} where size > 1 group by all)")
            parts.append(f"{name}{k + 1} as (select tree, place, size, sha256(array_to_string(kids, '')) as node from {name}r{k})")

    climb("l", levels)
    parts.append("t0 as (select '' as tree, tree as lang, node, row_number() over (order by encode(tree)) - 1 as place, count(*) over () as size from (" + " union all ".join(f"select tree, node from l{k} where size = 1" for k in range(levels + 1)) + "))")
    climb("t", top_levels)
    parts.append("top as (" + " union all ".join(f"select node from t{k} where size = 1" for k in range(top_levels + 1)) + ")")
    carry, held = "f.doc_id, f.leaf, f.lang, f.subroot", "p0"
    parts.append("p0 as (select doc_id, leaf, tree as lang, null::varchar as subroot, tree, place, coalesce(tampered, leaf) as now, '' as proof from l0)")

    def fold(name: str, n: int, held: str, out: str) -> str:
        for k in range(n):
            i = f"(f.place % {fanout})::int"
            left, right = f"coalesce(array_to_string(r.kids[1:{i}], ''), '')", f"coalesce(array_to_string(r.kids[{i} + 2:], ''), '')"
            parts.append(f"{out}{k + 1} as (select {carry}, f.tree, f.place // {fanout} as place, case when r.kids is null then f.now else sha256({left} || f.now || {right}) end as now, case when r.kids is null then f.proof else f.proof || {left} || {right} end as proof from {held} f left join {name}r{k} r on f.tree = r.tree and f.place // {fanout} = r.place)")
            held = f"{out}{k + 1}"
        return held

    held = fold("l", levels, held, "p")
    parts.append(f"q0 as (select f.doc_id, f.leaf, f.lang, t0.node as subroot, '' as tree, t0.place, f.now, f.proof from {held} f join t0 on f.lang = t0.lang)")
    held = fold("t", top_levels, "q0", "q")
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, top.node as root, sha256(proof) as proof_sha256, now as folded_root, now = top.node as verified from {held} cross join top"
