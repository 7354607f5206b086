"""Shared pieces: table reading, reliable checkpoints, word arrays and the Arrow text kernel."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks that separate words, for trim() and for regular expressions.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Let Python workers that share this machine's folders import the library; clusters use --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which driver and executors share.

    A session that names none gets a temporary folder if driver and executors are one process, as in
    tests; on a cluster that would be some machine's own disk, so it is an error there.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="chronofold-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written below the shared folder, to cut lineage where one is read often, and dropped when done with."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.held = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.held)}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((kept, path))
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for kept, path in self.held:
            if any(kept is t for t in tables):
                at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*[kept for kept, _ in self.held if not any(kept is t for t in tables)])


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame) -> Column:
    """Each row as one struct, whatever its columns are called."""
    return F.struct(*[quoted(c) for c in df.columns])


def forget(spark: SparkSession) -> None:
    """Let the driver find shuffles that nothing refers to any more, whose files Spark then deletes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def counted_out(df: DataFrame, low: Column, high: Column, name: str, step: int = 10_000) -> DataFrame:
    """A row of df for each whole number from low to high, as name; none if high is below low.

    Longer ranges than step are dealt out in parts, so that neither an array nor a task holds them.
    """
    here, far = high - low < step, high - low >= step
    short = df.where(here & (high >= low)).withColumn(name, F.explode(F.sequence(low, high)))
    parts = df.where(far).withColumn("__part__", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((high - low) / step)))).repartition(F.col("__part__"), low)
    begin = low + F.col("__part__") * step
    long = parts.withColumn(name, F.explode(F.sequence(begin, F.least(high, begin + step - 1)))).drop("__part__")
    return short.unionByName(long)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the built-in lower() is right, and fast, for pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_by(text: Column, separators: str) -> Column:
    """Words between runs of separators, in order; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def blank_words(text: Column) -> Column:
    return words_by(text, BLANK_RE)


# ---- Arrow text kernel: numpy over the UTF-8 buffer of a whole slice of texts ----

_MULT = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.RandomState(20240229)
_BYTE_CODE = _RNG.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, base: np.uint64, cache: dict = {}) -> np.ndarray:
    got = cache.get(int(base))
    if got is None or len(got) < n + 1:
        got = np.full(max(n + 1, 1 << 16), base, np.uint64)
        got[0] = 1
        with np.errstate(over="ignore"):
            got = np.cumprod(got)
        cache[int(base)] = got
    return got


def text_slices(column, most_bytes: int = 2_000_000):
    """Yield (first row, row count, bytes, row offsets) over an Arrow string column, nulls as empty.

    A slice ends before it would pass most_bytes; one longer text is a slice of its own.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and at[-1] > 0 else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j - i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def find_words(raw: np.ndarray, at: np.ndarray, blank: np.ndarray = IS_BLANK):
    """(start, end, row) of each word: a run of bytes that aren't blank, inside one row."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~blank[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at[:-1]] = True  # rows begin here
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | first[1:-1]
    closes = np.empty(len(raw), bool)
    closes[-1] = solid[-1]
    closes[:-1] = solid[:-1] & (~solid[1:] | first[1:-1])
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def hash_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial over random byte codes, mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(raw)
    up, down = _powers(n, _BASE), _powers(n, _BASE_INV)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[raw] * up[:n], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)
