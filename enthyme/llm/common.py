"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Worker functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["enthyme.llm"])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables, under the one that all executors share."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        top = tempfile.mkdtemp(prefix="enthyme-")
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/enthyme-{sc.applicationId}"


#: While an intermediate table is written, Spark deletes the shuffle files of that query when it has ended, and hands rows to
#: Python in batches bounded by bytes: the texts of a batch are in memory together, on either side.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts its lineage: a lost executor costs no
    recomputation of what led to it, and the shuffle files of what led to it can go."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.select("*").write.option("compression", "lz4").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more: whatever was made from them has been saved in its turn."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._saved_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A list of this many bigint keys (about 30 MB as a hashed relation) may be broadcast; longer ones are shuffled.
BROADCAST_KEYS = 500_000


def sized(df: DataFrame) -> DataFrame:
    """A saved table of keys, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def without(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is not among the (saved) ids; a null id stays."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone"))
    return rows.join(sized(gone), F.col(id_col) == F.col("__gone"), "left_anti")


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application; results that still read them must have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class WordHashes(dict):
    """Word (bytes) to 64-bit hash. Forgets everything at LIMIT entries, so that its memory is bounded."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that low and high bits can serve as hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: An odd multiplier for polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)


class Rolling:
    """Hashes of all runs of k words from prefix sums of a polynomial, exact modulo 2**64."""

    def __init__(self) -> None:
        self.size = 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            powers = np.ones((2, self.size + 1), dtype=np.uint64)
            powers[0, 1:], powers[1, 1:] = BASE, BASE_INVERSE
            self.up, self.down = np.cumprod(powers, axis=1, dtype=np.uint64)

    def runs(self, words: np.ndarray, k: int) -> np.ndarray:
        """One hash for each start of k consecutive words; empty if there are fewer."""
        n = len(words)
        if n < k:
            return np.empty(0, dtype=np.uint64)
        self._powers(n)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * self.up[:n], dtype=np.uint64)])
        return mixed((sums[k:] - sums[:-k]) * self.down[: n - k + 1] + np.uint64(k))


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of a text column, at least one row each."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def member_filter(df: DataFrame, column: str, bits: int = 1 << 25, hashed: bool = False) -> np.ndarray:
    """A bitmap of hashed values of a bigint column with two hash functions (hashed: the values are
    hashes themselves): no value of df is missed, others pass now and
    then. Its size is fixed; when df outgrows it, it lets more pass, and the exact join that follows does more of the work."""
    h = F.col(column) if hashed else F.xxhash64(F.col(column))
    spots = df.select(F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits)))).alias("b"))
    words = spots.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))
    out = np.zeros(bits // 64, dtype=np.int64)
    rows = words.toArrow()
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return out


def passes(filter_bytes: np.ndarray, spark_hashes: np.ndarray) -> np.ndarray:
    """Which hashes (Spark's xxhash64 of the values, or the values if they are hashes) may be in a member_filter."""
    bits = np.uint64(len(filter_bytes) * 64)
    a = np.mod(spark_hashes, np.int64(bits)).astype(np.int64)
    b = ((spark_hashes.view(np.uint64) >> np.uint64(32)) % bits).astype(np.int64)
    return (((filter_bytes[a >> 6] >> (a & 63)) & (filter_bytes[b >> 6] >> (b & 63))) & 1).astype(bool)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
