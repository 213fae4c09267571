"""Shared pieces of the corpus operators: reading, staging, vectorised words."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The six characters that separate words: space, tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one vectorised step handles; keeps a worker's temporaries to some tens of MB.
CHUNK = 1 << 19
#: Rows of a few numbers that a file holds, where their number is known.
ROWS_A_FILE = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """`df`, of which Python workers get so many rows at a time: with whole texts, Spark's 10,000 are tens of MB that the JVM
    and each worker of an executor hold together."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset and both are
    one process (tests). On a cluster the setting is needed: executors would write where nobody else reads."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def staged(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Writes `df` once in the shared folder and reads it back, which cuts its lineage: a lost executor
    costs a reread, not a recomputation. The folder goes when the driver ends. rows: how many there are at most, where
    that is known; then it is written in as many files as these need."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(functools.partial(discard, spark, path))
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """`df`, computed once and held on the executors' disks. For what few steps lie before: partitions that go with a lost
    executor are computed again. The session's clearCache() lets go of it."""
    return df.persist(StorageLevel.DISK_ONLY)


def discard(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def task(run):
    """`run` for mapInArrow; when a task ends, its worker, which waits for more, gives back memory that it no longer uses."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    binary = {pa.large_string(): pa.large_binary()}.get(column.type, pa.binary())
    return [b"" if x is None else x for x in column.cast(binary).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK):
    """(from, to) ranges of rows of about `limit` bytes; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@functools.lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        out = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below at least `size`; those that usual chunks need are kept."""
    bits = max(20, int(size).bit_length())
    return _powers(1 << bits) if bits == 20 else _powers.__wrapped__(1 << bits)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ranges_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of values[start:end] for each range, by differences of one running sum."""
    with np.errstate(over="ignore"):
        up, down = powers(len(values) + 1)
        run = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=run[1:])
        return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """All words of some texts at once. start, end: byte ranges in `buf`; doc: the text's number; hash: 64 bits;
    first: number of each text's first word, and at the end of all words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            buf = _LOWER[buf]
        step = np.diff(np.concatenate(([True], _IS_SPACE[buf], [True])).astype(np.int8))
        self.buf, self.start, self.end = buf, np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, at).astype(np.int64)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.hash = ranges_hash(buf.astype(np.uint64) + np.uint64(1), self.start, self.end)


def list_array(values: np.ndarray | pa.Array, offsets: np.ndarray) -> pa.Array:
    """Lists of values[offsets[i]:offsets[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def documents_select(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text, null as empty, under names that no other column can clash with."""
    return small_batches(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def by_group(batches, work, columns: int):
    """work(rows) for the rows of each value of the first column, which come in a row; rows are tuples of columns."""
    held, at = [[] for _ in range(columns)], None
    for b in batches:
        rows = [c.to_pylist() for c in b.columns]
        first = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(first)]):
            if s == e:
                continue
            if held[0] and first[s] != at:
                yield from work(held)
                held = [[] for _ in range(columns)]
            at = first[s]
            for own, c in zip(held, rows):
                own.extend(c[s:e])
    if held[0]:
        yield from work(held)
