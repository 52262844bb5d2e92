"""Helpers the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that separate words: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\f\r"

# Rows up to which a slim table (a few numbers a row) may be broadcast.
BROADCAST_ROWS = 2_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset a folder inside the warehouse is taken, which a cluster shares as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


# Has Spark drop the shuffle files of a query when it ends; else they stay until the driver collects garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: a table that survives lost executors.

    With ``release`` the shuffle files it took are dropped at once.
    """
    spark = frame.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        frame.write.parquet(path)
    finally:
        if release and before is None:
            spark.conf.unset(RELEASE)
        elif release:
            spark.conf.set(RELEASE, before)
    return spark.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Remove what ``written`` wrote for ``frame``, once nothing reads it any more."""
    context = frame.sparkSession.sparkContext
    folders = {file.rsplit("/", 1)[0] for file in frame.inputFiles()}
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A slim written table, marked for broadcast only if it has at most ``limit`` rows."""
    return F.broadcast(frame) if frame.count() <= limit else frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of ``frame`` has (columns compare without case)."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def replacing(frame: DataFrame, columns: dict[str, T.DataType]) -> T.StructType:
    """The schema of ``frame`` without columns named like the new ones, and the new ones behind."""
    new = {c.lower() for c in columns}
    kept = [f for f in frame.schema.fields if f.name.lower() not in new]
    return T.StructType(kept + [T.StructField(n, t) for n, t in columns.items()])


# What Python workers remember from task to task: (modules that use it, how to forget it).
_MEMORIES: list[tuple[tuple[str, ...], Callable[[], None]]] = []


def remembered(forget: Callable[[], None], *modules: str) -> None:
    """Have ``forget`` called when a worker turns to an operator of none of these modules."""
    _MEMORIES.append((modules, forget))


def forget_others(module: str) -> None:
    """Workers outlive stages: they keep the memories of the operator at work only."""
    for modules, forget in _MEMORIES:
        if module not in modules:
            forget()


def give_back() -> None:
    """Return what a task has freed to the system: an idle worker keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def with_rows(
    frame: DataFrame,
    columns: dict[str, T.DataType],
    make: Callable[[list[pa.Array]], list],
    *inputs: str,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """``frame`` with new columns that a Python function makes from whole input columns.

    ``make`` gets the input columns of one Arrow batch and returns one list or array per new
    column. A column of ``frame`` named like a new one is replaced. ``done`` is called at the end of
    each task, before freed memory is returned.
    """
    schema = replacing(frame, columns)
    lists = {n: t for n, t in columns.items()}
    kept = [f.name for f in schema.fields if f.name not in lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        forget_others(make.__module__)
        types = [to_arrow_type(t) for t in lists.values()]
        for batch in batches:
            for part in pieces(batch, inputs):
                made = make([part.column(c) for c in inputs])
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), *made], names=[*kept, *lists]
                )
            batch = part = made = None
        if done:
            done()
        give_back()

    return frame.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, columns: Iterable[str], size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about ``size`` bytes (one row at least)."""
    rows = batch.num_rows
    step = rows
    if rows:
        heaviest = sum(batch.column(c).nbytes for c in columns)
        step = max(1, min(rows, rows * size // max(heaviest, 1)))
    for start in range(0, rows, max(step, 1)):
        yield batch.slice(start, step)


def hex_sha(column: Column) -> Column:
    """Lowercase hex SHA-256 of a text in UTF-8."""
    return F.sha2(column.cast("binary"), 256)


DISK = StorageLevel.DISK_ONLY


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole groups (runs of equal keys in sorted batches), about ``rows`` rows each."""
    held: list[pa.RecordBatch] = []

    def last_start(table: pa.Table) -> int:
        """Where the last group of the table begins."""
        low, high = 0, table.num_rows - 1
        final = [table[k][high].as_py() for k in keys]
        while low < high:
            middle = (low + high) // 2
            if [table[k][middle].as_py() for k in keys] == final:
                high = middle
            else:
                low = middle + 1
        return low

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            whole = pa.Table.from_batches(held)
            cut = last_start(whole)
            if cut:
                yield whole.slice(0, cut)
                held = whole.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(*keys):
    """Start index of each run of equal keys (numpy arrays), and the number of rows behind."""
    import numpy as np

    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), n)
