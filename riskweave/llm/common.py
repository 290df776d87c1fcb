"""What the corpus operators share: tables, shared storage, word hashing over Arrow columns."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised loop takes at a time (one longer text is taken alone).
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch while a table is stored.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; where the session names none, a local one on a local master (tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="riskweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def short_batches(spark: SparkSession):
    """Meanwhile Arrow batches have BATCH_ROWS rows at most, so that whole texts take little memory on their way."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with short_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration() if hasattr(df.sparkSession, "_jsc") else df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stored-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def per_worker(key: str, make: Callable):
    """What a Python worker keeps from task to task: made once under its key, in a module of the worker's own."""
    kept = sys.modules.setdefault("riskweave_worker_memory", types.ModuleType("riskweave_worker_memory"))
    if not hasattr(kept, key):
        setattr(kept, key, make())
    return getattr(kept, key)


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))


class Powers:
    """Powers of an odd number modulo 2**64, as many as have been asked for."""

    def __init__(self, base: int):
        self.base, self.have = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.have) < n:
            step = np.uint64(pow(self.base, len(self.have), 1 << 64))
            self.have = np.concatenate([self.have, self.have * step])
        return self.have[:n]


class WordHasher:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of texts, A-Z lower-cased, without a Python loop over words.

    starts and ends tell where the words of the last call lie in its bytes. Hashers of different odd bases are independent.
    """

    def __init__(self, base: int = _R):
        self.up, self.down = Powers(base), Powers(pow(base, -1, 1 << 64))
        self.starts = self.ends = np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: bytes of consecutive texts; bounds: where each begins, and the end. Returns hashes and the texts' bounds in them."""
        n = len(data)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        black = ~_WS[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[bounds] = True
        first = black.copy()
        first[1:] &= ~black[:-1] | cut[1:n]
        last = black.copy()
        last[:-1] &= ~black[1:] | cut[1:n]
        starts, ends = self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * self.up.upto(n), out=total[1:])
        return mix((total[ends] - total[starts]) * self.down.upto(n)[starts]), np.searchsorted(starts, bounds)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' bounds in them; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    bounds = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, bounds


def steps(bounds: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to `most` bytes, or a single longer row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
