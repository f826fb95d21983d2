"""Helpers that several operators share: tables on disk, Arrow text access, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a task works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Word separators of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows in an Arrow batch: the default of 10,000 rows of long texts is more than a small Python worker should hold.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); on a local master, as in tests, one is set where none is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, so that no later stage recomputes it and lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("null"))) % n


def drawn(draw: Column, rows: int, limit: int) -> Column:
    """Whether a row's 64-bit hash falls into the part of all hashes that holds `limit` of `rows` rows and half as many more.

    Ordering what is left and taking `limit` of it gives a bounded sample without
    a task that gathers candidates from every partition.
    """
    if rows <= limit:
        return F.lit(True)
    return draw <= F.lit(min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, 1.5 * limit / rows))))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column without copying; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def steps(column: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of at most size bytes, or one longer row."""
    raw, at = strings(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words `[^\\x20\\x09-\\x0D]+`, and the index of each row's first word (rows + 1 of them)."""
    return spans_where(~IS_SPACE[data], offsets)


def spans_where(inside: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that cross neither a row's edge nor one of the places `cuts`."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Hasher:
    """64-bit hashes of byte ranges by prefix sums of value[b] * BASE**i, so that the work is a few passes however many ranges there are."""

    def __init__(self, fold: np.ndarray = LOWER):
        self.values = BYTE_VALUES[fold]
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, STEP_BYTES + 1)
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each start position, the hash of the words at the given offsets from it; positions without room at the end are left out."""
    room = len(words) - int(offsets[-1])
    if room <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(room, np.uint64)
    for k, o in enumerate(offsets):
        total += words[o : o + room] * np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
    return mix(total)
