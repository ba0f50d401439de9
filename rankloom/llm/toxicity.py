"""Toxicity by class-conditional Kneser-Ney models of how texts are spelled.

A text is spelled byte by byte. Each byte ends an n-gram inside its word (the word so far, at most its last ORDER
bytes) and, among the first of a word, one of ORDER bytes that reaches back into the words before it; so a context is
what came before in the word, or before that. All labelled training texts give counts of n-grams for each class. A class's
model interpolates its own discounted counts with one backoff that both classes share, the Kneser-Ney continuation
counts of short n-grams. All n-grams take part, however rare; one never seen takes what both classes leave to the
backoff in its context. A text is scored by the difference of length-normalised log-likelihoods,
over the whole text, over its most toxic window of words and over its strong words, and a logistic curve turns these
into a probability. The curve is fitted on labelled documents of a fifth, measured by a model of the other four; the
model that scores has the counts of all of them.

Tasks add their counts up before they exchange them; totals are dealt by context, so all that a context's ratios need
meets in one task. The table of short n-grams that both classes share is broadcast (three bytes: at most 2**24 rows at
any size). Log ratios are stored, each under its
own n-gram, as sorted files in the folder that driver and executors share, which must be mounted on all of them. Workers
map the files; the driver holds their names. Labels are looked up in such files too, so no text is ever
exchanged.
A-Z are lower-cased; ASCII punctuation and digits separate words as white space does.

Null and empty texts score the base rate. Labels other than 0 and 1 and labels of no document count for nothing; a
document labelled more than once is toxic if any says so. Where one class has no training rows all scores are the base
rate. An empty table gives an empty result.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, docs_of, forget, frugal, scratch, slices, text_buffers

ORDER, DISCOUNT, WINDOW = 7, 0.75, 1
#: Marks a context's row in the model, for n-grams never seen in it.
UNSEEN = 1 << 60
#: About so many labelled documents of the fifth at most calibrate the curve (three numbers each); the counts take all.
CALIBRATION_ROWS = 20_000
#: Bytes of text handled at once; counts that a task adds up before it sends them, and sends at once.
CHUNK, COUNTS, PUT_OUT = 1 << 18, 1_500_000, 200_000
#: Mean log ratio a word; that of the most toxic window; what words have above STRONG, by the root of the length.
FEATURES, STRONG = ("whole", "worst", "strong"), 1.0
#: Bytes of words lower-cased; what separates words is 0.
LUT = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, start of each word, number of words that start before each text's end; first 0)."""
    flat = LUT[data]
    begins = np.zeros(len(flat), bool)
    if len(flat):
        begins[0] = True
        begins[1:] = flat[:-1] == 0
        begins[offsets[:-1][offsets[:-1] < len(flat)]] = True
        begins &= flat != 0
    starts = np.flatnonzero(begins)
    return flat, starts, np.searchsorted(starts, offsets)


def grams(flat: np.ndarray, starts: np.ndarray, first: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Twice (index of a byte's word, n-gram that ends at the byte): inside the word, for every byte; across words.

    The first holds the word's bytes so far, at most its last `order`, marked with their number. The second, for bytes
    that have fewer in their word, holds `order` bytes with a 0 before each word; what lies before the text is 0 too.
    """
    letters = np.flatnonzero(flat)
    if not len(letters):
        return
    word = np.searchsorted(starts, letters, "right") - 1
    inside = letters - starts[word] + 1
    # all words one after the other, a 0 before each
    at = np.arange(len(letters)) + word + 1
    line = np.zeros(len(letters) + len(starts), np.uint64)
    line[at] = flat[letters]
    x = line.copy()
    for j in range(1, order):
        x[j:] |= line[:-j] << np.uint64(8 * j)
    heads = at[np.searchsorted(letters, starts)] - 1
    begin = np.repeat(heads[first[:-1][np.diff(first) > 0]], np.diff(first)[np.diff(first) > 0])
    last = lambda n: x[at] & ((np.uint64(1) << (np.uint64(8) * n.astype(np.uint64))) - np.uint64(1))
    n = np.minimum(inside, order)
    yield word, last(n) | (n.astype(np.uint64) << np.uint64(56))
    over = inside < order
    yield word[over], last(np.minimum(at - begin[word] + 1, order))[over] | np.uint64(order << 56)


def fold(x):
    """Brings all bits of a non-negative long down to the lowest; x is a column or an array."""
    return x ^ (x >> 21) ^ (x >> 42) if isinstance(x, np.ndarray) else x.bitwiseXOR(F.shiftright(x, 21)).bitwiseXOR(F.shiftright(x, 42))


def context_of(gram):
    """All but the last byte of an n-gram, marked with their number; gram is a column or an array."""
    spelled = (1 << 56) - 1
    if isinstance(gram, np.ndarray):
        return ((gram & spelled) >> 8) + (((gram >> 56) - 1) << 56)
    return F.shiftright(gram.bitwiseAND(F.lit(spelled)), 8) + F.shiftleft(F.shiftright(gram, 56) - 1, 56)


COUNTED = ("n0", "n1", "m0", "m1")


def counted(labelled: DataFrame, order: int) -> DataFrame:
    """labelled (text, toxic, fifth) to gram and how often it occurs in either class: n0, n1 of four fifths, m0, m1 of the other. Added up by task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # what is added up so far, ascending; of one task, so counts stay small
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add_up():
            both, n = np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([counts, *(n for _, n in held)])
            held.clear()
            order = np.argsort(both).astype(np.int32)
            both, n = both[order], n[order]
            new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
            return both[new], np.add.reduceat(n, new) if len(new) else n

        def flush():
            for a in range(0, len(keys), PUT_OUT):
                own, n = keys[a : a + PUT_OUT], counts[a : a + PUT_OUT]
                gram, kind = (own >> np.uint64(2)).astype(np.int64), own & np.uint64(3)
                columns = [np.where(kind == k, n, 0) for k in range(4)]
                new = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(gram[new]), *(pa.array(np.add.reduceat(c, new)) for c in columns)], names=["gram", *COUNTED])

        for b in slices(batches, "text", CHUNK):
            data, offsets = text_buffers(b.column(0))
            flat, starts, first = words_of(data, offsets)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            kind = (np.asarray(b.column(1)) + 2 * np.asarray(b.column(2))).astype(np.uint64)
            for at, own in grams(flat, starts, first, order):
                found = pa.array((own << np.uint64(2)) | kind[text[at]]).value_counts()
                held.append((np.asarray(found.field(0)), np.asarray(found.field(1)).astype(np.int32)))
            if sum(len(k) for k, _ in held) > COUNTS // 2:
                keys, counts = add_up()
                if len(keys) > COUNTS:
                    yield from flush()
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = add_up()
        yield from flush()

    return labelled.select("text", "toxic", "fifth").mapInArrow(frugal(run), "gram long, " + ", ".join(f"{c} long" for c in COUNTED))


def log_ratios(own: dict[str, np.ndarray], discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, two ratios each): log P(last byte | the bytes before) under the toxic model less that under the ordinary one.

    own: gram, counts and backoff of n-grams sorted by context, contexts whole. The first ratio is that of four fifths of
    the counts, the second that of all. Every n-gram has a key; so has every context, as UNSEEN: the ratio of all n-grams
    that were never seen in it.
    """
    context = context_of(own["gram"])
    new = np.append(True, context[1:] != context[:-1])
    begins, of = np.flatnonzero(new), np.cumsum(new) - 1
    out = np.zeros((len(context) + len(begins), 2), np.float32)
    for model, counts in enumerate(((own["n0"], own["n1"]), (own["n0"] + own["m0"], own["n1"] + own["m1"]))):
        p, left = [], []
        for n in counts:
            c, t = np.add.reduceat(n, begins), np.add.reduceat((n > 0).astype(np.int64), begins)
            some = np.maximum(c, 1)
            left.append(np.where(c > 0, discount * t / some, 1.0))  # what the class leaves to the backoff, which is the same for both
            p.append(np.maximum(n - discount, 0) / some[of] + left[-1][of] * own["backoff"])
        out[: len(context), model] = np.log(p[1] / p[0])
        out[len(context) :, model] = np.log(left[1] / left[0])
    return np.concatenate([own["gram"], context[begins] | UNSEEN]), out


def folder_of(spark) -> str:
    """A new folder among the shared ones, as a path of this machine; only mounted ones have such a path."""
    path = scratch(spark)
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file") or not rest.startswith("/"):
        raise ValueError(f"spark.checkpoint.dir is {path.rpartition('/rankloom-')[0]}: this operator's files need a folder that is mounted on all machines (file:)")
    return "/" + rest.lstrip("/")


#: Where a bucket lies: file, first key, number of keys.
Place = tuple[str, int, int]


def sorted_files(rows: DataFrame, folder: str, make) -> dict[int, Place]:
    """rows come by bucket; make(columns of one bucket) gives (keys, values), stored by key. A task writes two files for all its buckets."""
    names = rows.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/{uuid.uuid4().hex}"  # a task that runs again writes files of its own
        held: list[pa.RecordBatch] = []
        found: list[tuple[int, str, int, int]] = []

        def store(keys_file, values_file):
            whole = pa.Table.from_batches(held)
            bucket = whole.column("bucket")[0].as_py()
            keys, values = make({n: whole.column(n).to_numpy() for n in names})
            order = np.argsort(keys)
            keys_file.write(keys[order].astype(np.int64).tobytes())
            values_file.write(values[order].astype(np.float32).tobytes())
            found.append((bucket, name, sum(found[-1][2:]) if found else 0, len(keys)))
            held.clear()

        with open(f"{name}.keys", "wb") as keys_file, open(f"{name}.values", "wb") as values_file:
            for b in batches:
                if not b.num_rows:
                    continue
                bucket = b.column(names.index("bucket")).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), b.num_rows]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    if held and held[-1].column(names.index("bucket"))[0].as_py() != bucket[a]:
                        store(keys_file, values_file)
                    held.append(b.slice(a, z - a))
            if held:
                store(keys_file, values_file)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["bucket", "name", "start", "size"])

    return {r.bucket: (r.name, r.start, r.size) for r in rows.mapInArrow(frugal(write), "bucket long, name string, start long, size long").collect()}


def mapped(path: str) -> mmap.mmap:
    """A file as memory, without holding a descriptor (before Python 3.13 a map holds one)."""
    with open(path, "rb") as f:
        if sys.version_info >= (3, 13):
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class Stored:
    """Keys and values in sorted files, mapped when first looked into: only what is looked up is read, and workers of a machine share it."""

    def __init__(self, places: dict[int, Place], buckets: int, width: int):
        self.places, self.buckets, self.width = places, buckets, width
        self.files: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def part(self, bucket: int) -> tuple[np.ndarray, np.ndarray] | None:
        name, start, size = self.places.get(bucket, ("", 0, 0))
        if not size:
            return None
        if name not in self.files:
            self.files[name] = np.frombuffer(mapped(f"{name}.keys"), np.int64), np.frombuffer(mapped(f"{name}.values"), np.float32).reshape(-1, self.width)
        return tuple(x[start : start + size] for x in self.files[name])

    def rows(self, wanted: np.ndarray, bucket: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        """(value of each of these distinct keys, 0 where there is none; whether there is one)."""
        order = np.lexsort((wanted, bucket))
        wanted, out, known = wanted[order], np.zeros(len(order), np.float32), np.zeros(len(order), bool)
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            if part := self.part(b):
                (keys, values), (x, z) = part, bounds[b : b + 2].tolist()
                at = np.minimum(np.searchsorted(keys, wanted[x:z]), len(keys) - 1)
                same = keys[at] == wanted[x:z]
                out[order[x:z]], known[order[x:z]] = np.where(same, values[at, column], 0), same
        return out, known


#: (files, buckets) of a stored table.
Files = tuple[dict[int, Place], int]


class Ratios(Stored):
    """The model; column 0 was made without the fifth that calibrates, column 1 with it."""

    def __init__(self, files: Files, column: int):
        super().__init__(*files, 2)
        self.column = column

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Each gram's ratio: its own, or that of n-grams unseen in its context; 0 where the context is unseen too."""
        coded = pa.array(grams.astype(np.int64)).dictionary_encode()
        wanted = np.asarray(coded.dictionary)
        context = context_of(wanted)
        out, known = self.rows(wanted, fold(context) % self.buckets, self.column)
        contexts, place = np.unique(context[~known], return_inverse=True)
        out[~known] = self.rows(contexts + UNSEEN, fold(contexts) % self.buckets, self.column)[0][place]
        return out[np.asarray(coded.indices)]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def model(labelled: DataFrame, order: int, discount: float) -> Files:
    """The stored model of labelled (text, toxic, fifth)."""
    n = partitions(labelled)
    counts = cut(counted(labelled, order).groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTED)))
    suffix = F.col("gram").bitwiseAND(F.lit((1 << 24) - 1))
    # shared backoff: in how many different n-grams the last byte follows the two before it
    types = counts.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("places")).withColumn("short", F.shiftright("suffix", 8))
    places = types.groupBy("short").agg(F.sum("places").alias("all_places"), F.count("*").alias("nexts"))
    backoff = (F.greatest(F.col("places") - discount, F.lit(0.0)) + discount * F.col("nexts") / 256.0) / F.col("all_places")
    shared = F.broadcast(types.join(places, "short").select("suffix", backoff.alias("backoff")))
    context = context_of(F.col("gram"))
    rows = counts.withColumn("suffix", suffix).join(shared, "suffix").drop("suffix").withColumn("bucket", F.pmod(fold(context), F.lit(n)))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", context, "gram")
    files = sorted_files(rows, folder_of(labelled.sparkSession), lambda own: log_ratios(own, discount))
    forget(counts)
    return files, n


def measured(docs: DataFrame, files: Files, order: int = ORDER, window: int = WINDOW, column: int = 1) -> DataFrame:
    """Adds FEATURES to docs, which has a column text, by a column of the stored model."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f, T.DoubleType()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = Ratios(files, column)
        for b in slices(batches, "text", CHUNK):
            data, offsets = text_buffers(b.column("text"))
            flat, starts, first = words_of(data, offsets)
            count = np.diff(first)
            own = np.zeros(len(starts))
            for at, key in grams(flat, starts, first, order):
                own += np.bincount(at, ratio.find(key), len(own))
            total = np.concatenate([[0.0], np.cumsum(own)])
            whole = (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1)
            # a window is `window` words, or all words of a text that has fewer; it ends in the text it starts in
            ends = np.minimum(np.arange(len(starts)) + window, np.repeat(first[1:], count))
            sums = np.append((total[ends] - total[:-1]) / window, 0.0)
            worst = np.zeros(len(count))
            some = np.flatnonzero(count)
            if len(some):
                worst[some] = np.maximum.reduceat(sums[:-1], first[:-1][some])
            strong = np.bincount(np.repeat(np.arange(len(count)), count), np.maximum(own - STRONG, 0), len(count)) / np.sqrt(count + 20)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (whole, worst, strong))], names=[*b.schema.names, *FEATURES])

    return docs.mapInArrow(frugal(run), schema)


class Curve:
    """Logistic regression on standardised features, by Newton's method with a little shrinkage."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        base = (y.sum() + 1) / (len(y) + 2)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        shrink = np.array([0.0] + [0.1] * len(FEATURES))
        self.w = np.array([np.log(base / (1 - base))] + [0.0] * len(FEATURES))
        if len(np.unique(y)) < 2:
            return
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(shrink + 1e-6)
            step = np.linalg.solve(h, z.T @ (y - p) - shrink * self.w)
            self.w += step
            if abs(step).max() < 1e-8:
                break

    def column(self) -> Column:
        z = F.lit(float(self.w[0]))
        for c, w, m, s in zip(map(F.col, FEATURES), self.w[1:], self.mean, self.scale, strict=True):
            z = z + F.lit(float(w)) * (c - F.lit(float(m))) / F.lit(float(s))
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def fifth(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(5)) == 0


def fit(training: DataFrame, order: int = ORDER, discount: float = DISCOUNT, window: int = WINDOW) -> tuple[Files, Curve]:
    """The stored model and the curve, from training (doc_id, text, toxic)."""
    rows = cut(training.select("doc_id", "text", "toxic", fifth(F.col("doc_id")).cast("int").alias("fifth")))
    files = model(rows, order, discount)
    apart = rows.where("fifth = 1")
    rate = CALIBRATION_ROWS / max(1, apart.select("doc_id").count())
    drawn = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(1_000_000)) < rate * 1e6
    found = measured(apart.where(drawn), files, order, window, column=0).select(*FEATURES, "toxic").toPandas()
    forget(rows)
    return files, Curve(found[list(FEATURES)].to_numpy(float), found["toxic"].to_numpy(float))


def training_rows(docs: DataFrame, labels: DataFrame, but: Column | None = None) -> DataFrame:
    """doc_id, text, toxic of labelled documents, except those where `but` holds; labels are looked up, texts stay where they are."""
    n = partitions(docs)
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    dealt = marks.withColumn("bucket", F.pmod(fold(F.col("doc_id")), F.lit(n))).repartition("bucket").sortWithinPartitions("bucket")
    files = sorted_files(dealt, folder_of(docs.sparkSession), lambda own: (own["doc_id"], own["toxic"]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = Stored(files, n, 1)
        for b in slices(batches, "text", CHUNK):
            ids = np.asarray(b.column(0))
            value, known = toxic.rows(ids, fold(ids) % n, 0)
            b = b.filter(pa.array(known))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(value[known].astype(np.int32))], names=["doc_id", "text", "toxic"])

    own = docs_of(docs).where("doc_id is not null")
    return (own if but is None else own.where(~but)).mapInArrow(find, "doc_id long, text string, toxic int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, training: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (with text) plus score (0 to 1); training has doc_id, text, toxic."""
    files, curve = fit(training)
    rows = docs.select(*[F.col(f"`{c}`") for c in (keep or docs.columns)])
    return measured(rows, files).withColumn("score", curve.column())


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; training takes labels of documents that aren't held out."""
    own = docs_of(docs)
    scored = score(own, training_rows(docs, labels, but=held_out(F.col("doc_id"))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)
