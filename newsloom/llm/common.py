"""What the operators of this subpackage share: tables, shared storage, word hashing, salted joins."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words (0x20, 0x09 to 0x0D), as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Over so many tasks a hot key is spread before its rows meet their group.
SALTS = 128
#: Python functions work on slices of about this many bytes of text.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch at most: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of rows and bytes in an Arrow batch, where they are higher."""
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.max{name}PerBatch"
        now = spark.conf.get(name).rstrip("bB")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Names of the tables that each open `scratch` holds, the innermost last.
_scopes: list[list[str]] = []


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    return out


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At its end, deletes the tables that `materialize` wrote inside, but for those given to what it yields: what follows may only read these."""
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._newsloom_path)
        return table

    _scopes.append([])
    try:
        yield keep
    finally:
        made = _scopes.pop()
        if _scopes:
            _scopes[-1].extend(kept)
        delete_tables(spark, [p for p in made if p not in kept])


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables written inside that are left at its end; they are not deleted."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def free(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the frames has."""
    while any(name.lower() == c.lower() for f in frames for c in f.columns):
        name += "_"
    return name


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def group_back(df: DataFrame, keys: list[str], aggs: list[Column], merge: list[Column], salt: Column, salts: int = SALTS) -> DataFrame:
    """Gives each row the aggregates of its group, without sending a hot group to one task.

    aggs are taken per (keys, salt), merge combines their results per keys; a key meets its rows again by
    (keys, salt), so that no task sees more than a salts-th of a group.
    """
    salted = df.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    part = salted.groupBy(*keys, "__salt").agg(*aggs)
    total = part.groupBy(*keys).agg(*merge)
    back = part.select(*keys, "__salt").join(total, keys)
    return salted.join(back, [*keys, "__salt"]).drop("__salt")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `most` bytes of text; a longer text is a run of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def text_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# Word hashing. A word's bytes are taken by eight, each eight mixed together with their place, and the sums mixed again:
# no arithmetic on the word's letters alone makes two words equal. Equal for equal words everywhere.
_BASE = np.uint64(0x9E3779B97F4A7C55)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(int(_BASE), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, which must not be empty."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    sizes = ends - starts
    left = (8 - np.minimum(sizes, 8)).astype(np.uint64) * np.uint64(8)
    hashes = mix((eights[starts] << left) + sizes.astype(np.uint64))
    long = np.flatnonzero(sizes > 8)
    if len(long):
        number = (sizes[long] - 1) >> 3  # eights behind the first
        first = np.cumsum(number) - number
        place = np.arange(number.sum()) - np.repeat(first, number) + 1
        at = np.repeat(starts[long], number) + 8 * place
        short = 8 - np.minimum(np.repeat(ends[long], number) - at, 8)
        more = mix(mix(eights[at] << (short * 8).astype(np.uint64)) + place.astype(np.uint64) * _BASE)
        hashes[long] = mix(hashes[long] + np.add.reduceat(more, first))
    return hashes


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in order, and for each text the number of its words."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _IS_SPACE[data]
    before = np.empty(len(space), bool)
    before[0] = True
    before[1:] = space[:-1]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    hashes = span_hashes(data, starts, ends)
    limits = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, limits))


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside a text, and each run's text; a shorter text is one run."""
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(width)]
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for i, f in enumerate(factors):
        full += mix(words[i : i + len(full)] + np.uint64(i)) * f
    inside = owner[: len(full)] == owner[width - 1 :] if len(full) else np.zeros(0, bool)
    hashes, texts = [mix(full[inside])], [owner[: len(full)][inside]]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = (ends - counts)[short]
        some = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            here = counts[short] > i
            some[here] += mix(words[at[here] + i] + np.uint64(i)) * factors[i]
        hashes.append(mix(some + counts[short].astype(np.uint64)))
        texts.append(short)
    return np.concatenate(hashes), np.concatenate(texts)
