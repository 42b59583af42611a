"""What the operators of this subpackage share: intermediate tables, size-checked
broadcasts, Arrow batches as byte arrays, and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast (a few longs each: some tens of MB).
BROADCAST_ROWS = 300_000
#: Bytes up to which a side whose rows hold arrays may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Bytes of text worked on at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: Rows sent to a Python worker at once, at most, while a table is written: a batch is held
#: whole on both sides, and its rows may be texts.
BATCH_ROWS = 2000


# --- intermediate tables ---------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (local tests) a temporary folder is chosen once a session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_pathloom_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="pathloom-")
        spark.sparkContext._pathloom_dir = own
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is
    cut, and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with short_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pathloom_path = path
    return out


@contextlib.contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile sends ``BATCH_ROWS`` rows at most to a Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, min(int(was), BATCH_ROWS) if int(was) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def bucketed(df: DataFrame, name: str, n: int, by: str) -> DataFrame:
    """The same with the rows in ``n`` buckets by the column ``by``: tables with as many
    buckets are joined by it bucket by bucket, without a shuffle.  Only a table of the catalog
    has buckets, so it is one until its plan is made."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"pathloom_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, by).saveAsTable(table)
    try:
        out = spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")  # the files stay
    out._pathloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote, once nothing will read it again."""
    path = getattr(df, "_pathloom_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: it does
    so when the driver collects garbage, which may be long after they were read.  (The events
    of a query that has just ended still refer to its plan, so it is asked twice.)"""
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def free_heaps(spark: SparkSession) -> None:
    """Let the executors collect their garbage and give back to the system what their heaps have
    grown by: else a heap only grows from stage to stage, up to its limit, whatever the next one
    needs.  A task for each executor; where explicit collections are off, nothing happens."""
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is in it
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def small_or_shuffled(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it is known to have at most ``bound`` rows;
    otherwise unmarked, so that the join shuffles (and may split skewed keys)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def light_or_shuffled(df: DataFrame, each: Column, bound: int = BROADCAST_BYTES) -> DataFrame:
    """The same by bytes: for rows of about ``each`` bytes besides their fixed part."""
    size = df.agg(F.sum(F.coalesce(each, F.lit(0)) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= bound else df


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for ``rows`` rows at ``each`` a partition, two at least."""
    return max(2, -(-rows // each))


def keep_clear(df: DataFrame, *added: str) -> DataFrame:
    """``df`` with columns named like ones that an operator adds renamed to ``NAME_input``."""
    return df.withColumnsRenamed({c: f"{c}_input" for c in added if c in df.columns})


def original(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that a table had before :func:`keep_clear`, under their names."""
    return df.select(*[F.col(f"{c}_input" if f"{c}_input" in df.columns and f"{c}_input" not in columns else c).alias(c) for c in columns])


# --- Arrow batches ---------------------------------------------------------------


def utf8(column: pa.Array) -> pa.Array:
    """A string column as plain strings without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column and the offsets of its rows in them."""
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most`` bytes of text at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = utf8(batch.column(batch.schema.get_field_index(text)))
        batch = batch.set_column(batch.schema.get_field_index(text), text, column)
        ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Give free memory back to the system: a Python worker stays for later tasks, and between
    them holds no more than what it remembers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


# --- hashing ---------------------------------------------------------------------

_U = np.uint64
_MASK = (1 << 64) - 1
#: An odd base and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random 64-bit values."""
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03) + _U(seed))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 at least of the base and of its inverse."""
    have = len(_powers.get("up", ()))
    if have < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, b & _MASK, _U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray, seed: int) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes the hash of any span."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(byte_table(seed)[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans: equal for equal bytes, wherever they start."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and the row of each."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[data]
    first = np.empty(len(data) + 1, bool)
    first[0] = True
    first[1:-1] = ~word[:-1]
    first[ends] = True
    starts = np.flatnonzero(word & first[:-1])
    last = np.empty(len(data), bool)
    last[:-1] = ~word[1:]
    last[-1] = True
    inner = ends[1:-1]
    last[inner[inner > 0] - 1] = True
    stops = np.flatnonzero(word & last) + 1
    return starts, stops, np.searchsorted(ends, starts, "right") - 1


def spark_hash(x: np.ndarray) -> np.ndarray:
    """What Spark's ``hash`` makes of longs (Murmur3, seed 42), by which it deals them to buckets and partitions."""
    u = np.uint32
    turn = lambda v, k: v << u(k) | v >> u(32 - k)
    x = np.asarray(x, np.int64).view(_U)
    h = np.full(len(x), 42, u)
    for k in (x.astype(u), (x >> _U(32)).astype(u)):
        h = turn(h ^ turn(k * u(0xCC9E2D51), 15) * u(0x1B873593), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return (h ^ h >> u(16)).view(np.int32)


def numbers_in(bucket: int, n: int, start: int) -> Iterator[int]:
    """The numbers from ``start`` on that lie in one of ``n`` buckets."""
    while True:
        some = np.arange(start, start + 16 * n, dtype=np.int64)
        yield from some[spark_hash(some) % n == bucket].tolist()
        start += 16 * n


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
