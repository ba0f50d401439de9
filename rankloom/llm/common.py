"""Shared plumbing: column selection, lineage cuts, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this package: U+0020 and U+0009 to U+000D.
SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Paths that cut() and scratch() have handed out in this process and that nobody has deleted yet, oldest first.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (in tests, on one machine) a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str = "") -> str:
    """A new path in the shared folder; it goes with sweep(), or at the end of the driver."""
    root = f"{shared_dir(spark)}/rankloom-{spark.sparkContext.applicationId}"
    if not WRITTEN:
        atexit.register(at_end, spark)
    WRITTEN.append(f"{root}/{name}{uuid.uuid4().hex}")
    return WRITTEN[-1]


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.rankloom_path = path
    return out


def counted(df: DataFrame) -> DataFrame:
    """cut(df); its rows are counted while they are written, so noted() asks no query of its own."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    out.rankloom_rows = seen.get.get("rows")  # None where Spark has found the plan to be empty
    return out


def noted(df: DataFrame) -> int:
    """Rows of a written table, which are counted once at most."""
    if df.__dict__.get("rankloom_rows") is None:
        df.rankloom_rows = df.count()
    return df.rankloom_rows


def forget(*tables: DataFrame | None) -> None:
    """Delete what cut() wrote for these, once everything that reads them has been written itself; others are left alone."""
    for df in tables:
        path = df.__dict__.pop("rankloom_path", None) if df is not None else None
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def sweep(spark: SparkSession, mark: int, *kept: DataFrame) -> None:
    """Delete all that was written since len(WRITTEN) was `mark`, but for these tables."""
    stay = {df.__dict__.get("rankloom_path") for df in kept}
    for path in [p for p in WRITTEN[mark:] if p not in stay]:
        remove(spark, path)


def at_end(spark: SparkSession) -> None:
    """What results have read goes with the driver, if its JVM is still there."""
    with contextlib.suppress(Exception):  # an ended session has nothing left to delete with
        for path in list(WRITTEN):
            remove(spark, path)


#: Rows of a few longs up to which a written table is broadcast: some MB, whatever the input.
FEW_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A table that cut() has written, with a hint to broadcast it if it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if "rankloom_path" in df.__dict__ and noted(df) <= FEW_ROWS else df


def replaced(new: DataFrame, *old: DataFrame | None) -> DataFrame:
    """new, which has been written from the old tables; these are deleted."""
    forget(*old)
    return new


def per_worker(key, make):
    """make() once in each Python worker process; tasks unpickle their own globals, so it hangs on sys."""
    kept = sys.__dict__.setdefault("_rankloom_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string), whatever else df carries; null texts stay null."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with so many underscores in front that df has no such column."""
    own = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in own:
            name = f"_{name}"
        out.append(name)
    return out


def text_buffers(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty; no copy of the texts where none is needed."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut by rows so that each holds about `limit` bytes of `column`; one long text may exceed it."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0)).astype(np.int64)
        group = np.cumsum(size) // limit
        start = 0
        for stop in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]:
            if stop > start:
                yield b.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Hand memory that a task has freed back to the system; workers live on and serve other stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run):
    """run (batches to batches), giving memory back at the end of a task."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return held
