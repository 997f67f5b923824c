"""What the corpus operators share: staged tables, and hashing of words and byte ranges with numpy.

Text columns are handled as Arrow string arrays. A null text is an empty text. Hashes of bytes add up strongly mixed
eight-byte pieces, each mixed with its place, so that no family of texts collides by its structure; equal bytes hash
equally in every task and every run. Two seeds together give 128 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
#: Seeds of the two halves of a 128-bit hash.
SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344))
#: Of 0 to 8 bytes, the bits that count.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Bytes of an Arrow batch: a task's Python worker holds about this much text at a time, or one text.
BATCH_BYTES = 8 << 20

_all = np.arange(256)
#: Bytes of words between ASCII white space: the class [^\x20\x09-\x0D].
WORD = ~((_all == 32) | ((_all >= 9) & (_all <= 13)))
#: Lower-cases A-Z only.
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)


def scratch_dir(spark: SparkSession) -> str:
    """A new place for an intermediate table in the shared folder, spark.checkpoint.dir.

    Where that is unset, a session on this machine alone gets a folder of our own; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints/pigmenta"
    return f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "staged_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def bounded(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session's Python tasks by bytes, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where df has such columns already, in any case."""
    own = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in own:
            name += "_"
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(df: DataFrame, part_bytes: int = 256 << 20) -> int:
    """Partitions for a range shuffle of df: the session's number, or more where Catalyst's estimate of the size asks so.

    From a petabyte on, the estimate is Catalyst's word for not knowing.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(shuffle_partitions(df.sparkSession), size // part_bytes if size < 1 << 50 else 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For count[i] entries each: the i of every entry, and its number within i."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def _added(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of runs of count[i] values; 0 where it is 0."""
    out = np.zeros(len(count), dtype=np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(count) - count)[some])
    return out


def hash_bytes(words: np.ndarray, start: np.ndarray, end: np.ndarray, *seeds: np.uint64) -> list[np.ndarray]:
    """The hash of each range [start, end) of the bytes that words = eights(data) has, one array a seed."""
    n = end - start
    long = np.flatnonzero(n > 8)
    of, k = spread((n[long] - 1) >> 3)
    k += 1
    rest = words[start[long][of] + 8 * k] & _LOW[np.minimum(n[long][of] - 8 * k, 8)]
    head = words[start] & _LOW[np.minimum(n, 8)]
    out = []
    for seed in seeds:
        h = mix(head + (n.astype(np.uint64) * GOLD + seed))
        if len(long):
            h[long] += _added(mix(rest + mix(k.astype(np.uint64) * GOLD + seed)), (n[long] - 1) >> 3)
        out.append(mix(h + seed))
    return out


def hash_runs(h: np.ndarray, first: np.ndarray, last: np.ndarray, *seeds: np.uint64) -> list[np.ndarray]:
    """The hash of each run h[first:last] of hashes, one array a seed."""
    n = last - first
    of, k = spread(n)
    one = h[first[of] + k]
    return [mix(_added(mix(one + mix(k.astype(np.uint64) * GOLD + seed)), n) + n.astype(np.uint64) * GOLD + seed) for seed in seeds]


def chain(*hashes: np.ndarray) -> np.ndarray:
    """One hash of several in this order."""
    out = hashes[0]
    for h in hashes[1:]:
        out = mix(out * GOLD + h)
    return out


class Slice:
    """Whole texts that lie together in memory: rows lo to hi of an Arrow array.

    data: their bytes; offs: where each text starts in data, and the end.
    """

    __slots__ = ("data", "hi", "lo", "offs")

    def __init__(self, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.data, self.offs = lo, hi, data, offs

    def __len__(self) -> int:
        return self.hi - self.lo

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """The sum of flags (one per byte) over each text."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offs[1:]] - sums[self.offs[:-1]]

    def words(self, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word; word says which bytes words have."""
        inside = word[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offs] = True
        before = np.zeros(len(inside) + 1, dtype=bool)
        before[1:] = inside
        here = np.zeros(len(inside) + 1, dtype=bool)
        here[:-1] = inside
        start = np.flatnonzero(here & (~before | edge))
        end = np.flatnonzero(before & (~here | edge))
        return start, end, np.searchsorted(self.offs, start, side="right") - 1

    def lower(self) -> np.ndarray:
        """eights() of the bytes with A-Z in lower case."""
        return eights(LOWER[self.data])


def slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[Slice]:
    """Cuts a string array into runs of texts of about limit bytes; one text is never cut."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return
    at = column.offset
    offs = np.frombuffer(column.buffers()[1], dtype=kind)[at : at + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def to_lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Packs values, in order, into one list per count."""
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def read_once(shared):
    """The value of a broadcast, read by a task without being kept in the worker's memory afterwards."""
    value = shared.value
    shared.__dict__.pop("_value", None)
    return value
