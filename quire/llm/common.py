"""What the operators share: the shared folder, written tables, and Arrow batches of texts."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch of whole texts; bounds what a Python worker holds at once.
TEXT_ROWS_PER_BATCH = 500
#: Bytes of texts that ``gathered`` puts together.
GATHERED_BYTES = 16 << 20
#: What a word cache holds in words and values, besides some 150 bytes an entry, and from what length a word isn't kept.
MEMO_BYTES, LONG_WORD = 64 << 20, 256

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named in ``spark.checkpoint.dir``.

    Only where the cluster names none (tests on one machine) a temporary folder is used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        _written.append((spark, base))
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: For rows of megabytes: else Parquet looks at sizes every 100 rows, and its buffers hold so many.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def materialize(df: DataFrame, name: str, options: dict = {}) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back; ``options`` are the writer's.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, size: int, fill) -> tuple[str, np.ndarray]:
    """Send ``size`` bytes, which ``fill`` puts into a mapped file, to the executors as a file for ``shipped``; returns its name and the bytes."""
    folder, name = tempfile.mkdtemp(prefix="quire-shipped-"), f"quire-{uuid.uuid4().hex}"
    data = np.memmap(os.path.join(folder, name), dtype=np.uint8, mode="w+", shape=(size,))
    fill(data)
    data.flush()
    spark.sparkContext.addFile(os.path.join(folder, name))
    _written.append((spark, f"file://{folder}"))
    return name, np.asarray(data)


def executor_gb(spark: SparkSession) -> float:
    """The memory of an executor as configured, and 1 where none is; on one machine the driver's."""
    conf = spark.sparkContext.getConf()
    size = conf.get("spark.driver.memory" if spark.sparkContext.master.startswith("local[") else "spark.executor.memory", "1g").strip().lower()
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", size).groups()
    # A number alone counts MiB.
    return int(number) * 1024.0 ** ("kmgt".index(unit or "m") - 2)


def shipped(name: str) -> np.ndarray:
    """The bytes of a file that was shipped, mapped: the workers of an executor share its pages, where each holds its own copy of a broadcast."""
    return np.asarray(np.memmap(SparkFiles.get(name), dtype=np.uint8, mode="r"))


@atexit.register
def _drop_written() -> None:
    """Best effort: delete the written tables when the application ends."""
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            return


def text_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, since one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS_PER_BATCH))


def partitions_of(df: DataFrame) -> int:
    """As many partitions as the input has, and not fewer than the session asks for."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def gathered(batches, size: int = GATHERED_BYTES):
    """Arrow batches put together until they hold ``size`` bytes: a word is then looked up once for more texts."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value's decimal text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """A word cache that lives as long as its Python worker, of bounded size.

    ``fill(words)`` returns the values of words that are not held. ``limit`` bounds the entries and
    ``MEMO_BYTES`` their words' and values' bytes: at a bound the cache starts anew, which costs time
    and changes no result. Words of over ``LONG_WORD`` bytes are held for the call that needs them
    alone. A worker holds one cache at a time: when another begins to learn, the last is emptied.
    """

    _active: dict | None = None

    def __init__(self, fill, limit: int = 1_000_000):
        super().__init__()
        self.fill, self.limit = fill, limit
        self.bytes, self.long = 0, []

    def clear(self) -> None:
        super().clear()
        self.bytes, self.long = 0, []

    def learn(self, words) -> None:
        alone(self)
        words = set(words)
        self._forget_long()
        new = [w for w in words if w not in self]
        if new and self._full(new):
            self.clear()
            new = list(words)
        if new:
            self._take_up(new)

    def values_of(self, words: list) -> list:
        """The values of distinct words; those that aren't held are learned."""
        alone(self)
        self._forget_long()
        values = list(map(self.get, words))
        at = [k for k, v in enumerate(values) if v is None]
        if at:
            new = [words[k] for k in at]
            if self._full(new):
                self.clear()
            for k, v in zip(at, self._take_up(new)):
                values[k] = v
        return values

    def _forget_long(self) -> None:
        for w in self.long:
            self.pop(w, None)
        self.long = []

    def _full(self, new: list) -> bool:
        return bool(self) and (len(self) + len(new) > self.limit or self.bytes + sum(map(len, new)) > MEMO_BYTES)

    def _take_up(self, new: list) -> list:
        size = sum(map(len, new))
        self.long = [w for w in new if len(w) > LONG_WORD]
        values = self.fill(new)
        self.update(zip(new, values))
        self.bytes += size - sum(map(len, self.long))
        self.bytes += sum(len(x) for w, x in zip(new, values) if len(w) <= LONG_WORD) if isinstance(values[0], bytes) else 0
        return values


def alone(cache: dict) -> None:
    """Make ``cache`` the one that this worker holds."""
    if Memo._active is not cache:
        if Memo._active is not None:
            Memo._active.clear()
        Memo._active = cache
