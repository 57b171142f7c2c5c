"""What the operators share: the shared folder, words, hashes and Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same for Java's regular expressions.
WORD_JAVA = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the cluster names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = spark.conf.get("spark.cairnframe.own.dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="cairnframe-")
        spark.conf.set("spark.cairnframe.own.dir", own)
    return own


class Stored:
    """Tables written to the shared folder by one query: they cut lineage and outlive executors. They go when the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._delete, self.at)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        """Removes the n-th table, which nothing will read again."""
        self._delete(f"{self.at}/{n}")

    def _delete(self, at: str) -> None:
        with contextlib.suppress(Exception):  # a table left over does no harm, and at the end the session may be gone
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Has the executors collect their garbage, for use between the stages of a long job.

    An executor's heap grows to its limit under any long stage and is given back only by a full collection; until then it stands beside
    what the next stage's Python workers need.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def pieces(spark: SparkSession, least: int = 8) -> int:
    """How many partitions an explicit exchange gets."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse modulo 2**64 for i < n."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = ODD, inverse
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive elements of h."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


_BYTES = np.arange(256)
_LOWER = (_BYTES + 32 * ((_BYTES >= 65) & (_BYTES <= 90))).astype(np.uint8)
_INK = ~((_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13))


def _word_hashes(data: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    ink = _INK[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = mix(((total[end] - total[begin]) * down[begin]) ^ ((end - begin).astype(np.uint64) << np.uint64(40)))
    return h, np.searchsorted(begin, cuts)


def hashed_words(texts: pa.Array, lower: bool = False, most_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row (nulls have none), and where each text's begin, with the end at last."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    hashes, starts, i, n = [], [np.zeros(1, np.int64)], 0, 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1)
        h, at = _word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        hashes.append(h)
        starts.append(n + at[1:])
        n += len(h)
        i = j
    return np.concatenate(hashes or [np.empty(0, np.uint64)]), np.concatenate(starts)


def _libc():
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim") else None  # glibc


def frugal() -> None:
    """Lets a worker's allocator keep little: one arena, and blocks of 8 MB or more straight from the system."""
    if libc := _libc():
        arenas, mmap_from, trim_from = -8, -3, -1  # fixed values: names of glibc's settings
        for name, value in ((arenas, 1), (mmap_from, 8 << 20), (trim_from, 8 << 20)):
            libc.mallopt(name, value)
        pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and stages share an executor."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def tidy(run):
    """run, a function over batches, that holds little and gives memory back when its partition ends."""

    def to_the_end(batches):
        frugal()
        try:
            yield from run(batches)
        finally:
            give_back()

    return to_the_end


#: Bytes of an Arrow batch, unless the session names another size: rows may be long, and a batch is held by the JVM and by Python.
BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) on small batches, with memory given back at the end of each partition."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) in (f"{_BATCH_DEFAULT}b", str(_BATCH_DEFAULT), "64m"):
        conf.set(_BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(tidy(run), schema)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema)


def slices(batches, most_bytes: int = 4 << 20, text: str = "text"):
    """The batches, cut so that the texts of each part have most_bytes or are one row."""
    for b in batches:
        column = b.column(b.schema.get_field_index(text))
        if b.num_rows < 2 or column.nbytes <= most_bytes:
            if b.num_rows:
                yield b
            continue
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64)
        part = np.cumsum(lengths) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
