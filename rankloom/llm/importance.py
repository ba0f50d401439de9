"""Importance resampling towards a target distribution, from hashed n-grams.

Every task opens an in-memory DuckDB of its own and runs SQL over its texts, a few MB at a time: words are unnested, runs
of words are made by windows, distinct features go once through a registered function (CRC-32 of zlib), and what is left
of a document is how often it has each bucket. These sparse counts are spilled to Parquet through Spark, so texts are
read and cut into words once. Spark then merges the counts of all documents into one row for each bucket (a table whose
size is the number of buckets) and scores documents from the spilled counts: a bucket's gain is the logarithm of what
the target has of it over what the documents have, a document's weight the sum of its gains, its score the weight plus
Gumbel noise that depends on seed and identifier only. The documents with the highest scores are a draw without
replacement in proportion to their weights' exponentials; their ranks come from ranges and counts (`order.numbered`).

Words are lower-cased in A-Z only. Null and empty texts have no features, weigh 0 and are never drawn unless `least`
is 0. A null doc_id has the noise of an empty name. Ties go to the smaller doc_id (null last), then to fewer features;
repeated rows rank one after the other. An empty table gives an empty result; an empty target leaves the gains to the
smoothing. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, docs_of, forget, frugal, slices
from .order import numbered

BUCKETS, SEED, PERCENT, LEAST = 10_000, "2024", 10, 20
#: Bytes of text that one SQL statement takes; what DuckDB may use at most. It never writes to a local disk.
CHUNK, MEMORY = 4 << 20, "500MB"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPARSE = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"


def crc_of(words: pa.Array) -> pa.Array:
    """CRC-32 of each, A-Z lower-cased, as UTF-8 bytes."""
    return pa.array([zlib.crc32(w.encode().lower()) for w in words.to_pylist()], pa.int64())


def features_sql(low: int, high: int, buckets: int) -> str:
    """SQL over t (i, doc_id, text): the sparse bucket counts of each row."""
    spans = [f"select i, w as feature from words where {low} <= 1"] if low <= 1 else []
    for n in range(max(2, low), high + 1):
        run = " || ' ' || ".join(["w", *(f"lead(w, {k}) over own" for k in range(1, n))])
        spans.append(f"select i, feature from (select i, {run} as feature from words window own as (partition by i order by pos)) where feature is not null")
    cuts = f"select i, unnest(found) as w{', generate_subscripts(found, 1) as pos' if high > 1 else ''} from cuts"
    return f"""
        with cuts as materialized (select i, regexp_extract_all(coalesce(text, ''), '{WORD}') as found from t),
        words as ({cuts}),
        counted as materialized (select i, feature, count(*) as c from ({" union all ".join(spans)}) group by all),
        named as materialized (select feature, crc32(feature) % {buckets} as bucket from (select distinct feature from counted)),
        summed as (select i, bucket, sum(c)::bigint as c from counted join named using (feature) group by all),
        rows as (select i, list(bucket::integer order by bucket) as buckets, list(c order by bucket) as counts, sum(c)::bigint as n from summed group by i)
        select t.doc_id, len(cuts.found)::bigint as n_words, coalesce(rows.n, 0)::bigint as n_features, coalesce(rows.buckets, []::integer[]) as buckets, coalesce(rows.counts, []::bigint[]) as counts
        from t join cuts using (i) left join rows using (i) order by i"""


def bucket_counts(docs: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, buckets (ascending), counts of each row of docs (doc_id, text)."""
    if not 1 <= low <= high:
        raise ValueError("runs of words have at least one word")
    sql = features_sql(low, high, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        try:
            con.execute("set temp_directory = ''")
            con.create_function("crc32", crc_of, ["VARCHAR"], "BIGINT", type="arrow")
            for b in slices(batches, "text", chunk):
                rows = pa.Table.from_batches([b]).append_column("i", pa.array(np.arange(b.num_rows)))
                con.register("t", rows)
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("t")
        finally:
            con.close()

    return docs_of(docs).mapInArrow(frugal(run), SPARSE)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def merged(sparse: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often all rows have each bucket; a task sends one row a bucket at most, and so many come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            np.add.at(total, flat(b.column(0))[0], flat(b.column(1))[0])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "c"])

    out = np.zeros(buckets, np.int64)
    for bucket, c in sparse.select("buckets", "counts").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        out[bucket] = c
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of either's share of each bucket, in thousandths, one added to each count."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1.0) * (s + n)) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: str, name: str) -> int:
    h = int(sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(sparse: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (bucket, offsets), (count, _) = flat(b.column(3)), flat(b.column(4))
            total = np.concatenate([[0], np.cumsum(gain[bucket] * count)])
            weight = total[offsets[1:]] - total[offsets[:-1]]
            extra = np.array([noise(seed, "" if d is None else str(d)) for d in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight), pa.array(weight + extra)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return sparse.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, seed: str = SEED, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text), target (text) to doc_id, n_features, weight, score, rank (null: not drawn), one row per document.

    Of the documents with at least `least` words, `percent` in a hundred are drawn.
    """
    sparse = cut(bucket_counts(docs, low, high, buckets))
    aim = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), low, high, buckets)
    scored = cut(scores(sparse, gains(merged(sparse, buckets), merged(aim, buckets)), seed))
    forget(sparse)
    drawn = percent * scored.where(F.col("n_words") >= least).count() // 100
    order = [(F.col("n_words") < least).asc(), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("n_features")]
    placed = numbered(scored, [], order, "place")
    forget(scored)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def oracle(buckets: int = BUCKETS, seed: str = SEED, percent: int = PERCENT, least: int = LEAST) -> str:
    """The same for single words in SQL, with CRC-32 spelled out."""
    step = "list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b))"
    crc = f"xor(list_reduce(list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::int, 2))::bigint), lambda a, b: {step}, 4294967295::bigint), 4294967295::bigint)"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as materialized (select row_number() over () as r, doc_id, {words} as found from documents),
f as materialized (select r, unnest(found) as w from d), g as materialized (select unnest({words}) as w from benchmark),
v as materialized (select w, {crc} % {buckets} as b from (select w from f union select w from g)),
s as (select b, count(*) as n from f join v using (w) group by b), t as (select b, count(*) as n from g join v using (w) group by b),
gain as (select b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from f) + {buckets})::double / ((s.n + 1)::double * ((select count(*) from g) + {buckets})::double)))::bigint as x from s left join t using (b)),
w as (select r, sum(x)::bigint as weight from f join v using (w) join gain using (b) group by r),
h as (select r, doc_id, len(found)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join w using (r)),
p as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from h),
k as (select *, row_number() over (partition by n_features >= {least} order by score desc, doc_id nulls last, n_features) as place, {percent} * (count(*) over (partition by n_features >= {least})) // 100 as drawn from p)
select doc_id, n_features, weight, score, case when n_features >= {least} and place <= drawn then place end as rank from k"""
