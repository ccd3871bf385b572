"""Shared pieces: the cluster's scratch folder, slices of text columns and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset and all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="eventide-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables of one operator run, written to the shared folder so that a lost executor costs no recomputation of the lineage before them.

    What an operator returns may read them, so they stay until `sweep` or the folder's owner deletes them.
    """

    #: Folders made by this process, for sweep.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.made.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        for df in frames:
            _delete(self.spark, df.scratch_path)

    @classmethod
    def sweep(cls, since: int = 0) -> None:
        """Delete the tables of all operators run since `since`, the length of Scratch.made then; for when their results have been written."""
        for s in cls.made[since:]:
            _delete(s.spark, s.root)
        del cls.made[since:]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(column: str, within: str = "") -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col(within + "`" + column.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a worker keeps between its tasks, by the name of who keeps it; tasks of others let it go.
kept: dict[str, dict] = {}


def trimmed(run, keeps: str = ""):
    """A function over Arrow batches that, when its task ends, gives back the memory that its worker holds and no longer uses; workers wait between tasks beside the JVM.

    keeps: the name under which it keeps things in `kept` from task to task; what stands there under other names goes as it begins.
    """

    def out(batches):
        import ctypes
        import gc

        import pyarrow as pa

        from eventide.llm import common  # the worker's own, not a copy sent with this function

        for name in [n for n in common.kept if n != keeps]:
            del common.kept[name]
        try:
            yield from run(batches)
        finally:
            common._powers.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return out


# --- text columns -----------------------------------------------------------------------------------------------

SLICE_BYTES, SLICE_ROWS = 1 << 20, 2048


def text_slices(batch, column: str, most: int = SLICE_BYTES):
    """(first row, uint8 bytes, offsets) for runs of up to SLICE_ROWS rows of about `most` bytes; a longer text gets a run of its own. A null is empty."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        stop = min(stop, row + SLICE_ROWS, n)
        yield row, data[ends[row] : ends[stop]], (ends[row : stop + 1] - ends[row])
        row = stop


U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte, and the odd base of the polynomial over the places in a word.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SHINGLE = _rng.integers(1, 2**63, 8, dtype=np.uint64) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        out = []
        for base in (BASE, BASE_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > 8 * SLICE_BYTES:  # one very long text: don't keep its tables
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def hash_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and for each text the index of its first word (one more at the end).

    breaks: further sorted byte positions at which a unit starts (lines); the index is then of units.
    """
    bounds = offsets if breaks is None else breaks
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = LOWER[data]
    word = ~SEPARATOR[low]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = offsets[offsets < n]
    first[at] = word[at]  # a text starts a new word even where the one before ends without a separator
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[low] * power[:n], out=total[1:])
    words = mix((total[ends] - total[starts]) * inverse[starts])
    return words, np.searchsorted(starts, bounds)


def shingle_sets(words: np.ndarray, index: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its `width`-word shingles; fewer words count as one sequence; no words give an empty set."""
    rolled = np.zeros(0, np.uint64)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k : k + len(rolled)] * SHINGLE[k]
        rolled = mix(rolled)
    out = []
    ix = index.tolist()
    for a, b in zip(ix, ix[1:], strict=False):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix((words[a:b] * SHINGLE[: b - a]).sum(keepdims=True, dtype=np.uint64) + U64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
