"""Document fingerprints from closed syncmers.

A k-mer of the text's UTF-8 bytes is chosen if the least of its inner s-mers
stands first or last in it.  That depends on the k-mer alone, so an edit
elsewhere neither adds nor removes an anchor, and equal passages give equal
anchors at equal distances.  A fingerprint lists the chosen k-mers in text
order, each as its distance from the one before (at most K - S) and 24 bits of
its hash.  Likeness is positional: the share of anchors in the longest chain of
common ones that stand in the same order in both.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mix, partitions, read, strings, text_of

K = 32
S = 8
#: Bytes whose k-mers are hashed at a time.
PIECE = 1 << 18
#: Hash bits of an anchor, and the digits (six bits each) that fingerprints are written in.
HASH = 24
DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
VALUES = np.zeros(256, np.int64)
VALUES[DIGITS] = np.arange(64)
#: Cells of ids for each partition, from which ranges of about equal bytes are made, and the parts of a cell that one id fills.
FINE, PARTS = 8, 16

#: Anchors of a text: hashes (uint32) and byte positions, in order.
Anchors = tuple[np.ndarray, np.ndarray]


def chosen(data: np.ndarray) -> Anchors:
    """The closed syncmers of some bytes; see `anchors`."""
    a = data.astype(np.uint64)
    # s-mers of 8 bytes, by doubling
    a = a[:-1] | a[1:] << np.uint64(8)
    a = a[:-2] | a[2:] << np.uint64(16)
    order = mix(a[:-4] | a[4:] << np.uint64(32))
    inner = K - S + 1  # s-mers in a k-mer
    low, width = order, 1
    while 2 * width <= inner:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < inner:
        low = np.minimum(low[: len(low) - (inner - width)], low[inner - width :])
    n = len(data) - K + 1
    at = np.flatnonzero((order[:n] == low[:n]) | (order[inner - 1 : inner - 1 + n] == low[:n]))
    h = np.zeros(len(at), np.uint64)
    for k in range(0, K, S):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + order[at + k])
    return (h >> np.uint64(64 - HASH)).astype(np.uint32), at


def anchors(data: np.ndarray) -> Anchors:
    """The fingerprint of some bytes.  A text shorter than a k-mer is one anchor, the hash of all of it; an empty one has none."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(data) < K:
        return np.array([int.from_bytes(hashlib.sha256(data.tobytes()).digest()[: HASH // 8], "big")], np.uint32), np.zeros(1, np.int64)
    if len(data) <= PIECE:
        return chosen(data)
    parts = [(i, chosen(data[i : i + PIECE + K - 1])) for i in range(0, len(data) - K + 1, PIECE)]
    return np.concatenate([h for _, (h, _) in parts]), np.concatenate([at + i for i, (_, at) in parts])


def as_text(fingerprint: Anchors) -> str:
    """Five digits for each anchor: one of distance, four of hash."""
    h, at = fingerprint
    value = np.diff(at, prepend=0) << HASH | h.astype(np.int64)
    return DIGITS[value[:, None] >> np.arange(HASH, -1, -6) & 63].tobytes().decode()


def from_text(fingerprint: str) -> Anchors:
    """What as_text wrote."""
    digits = VALUES[np.frombuffer(fingerprint.encode(), np.uint8)].reshape(-1, HASH // 6 + 1)
    h = (digits[:, 1:] << np.arange(HASH - 6, -1, -6)).sum(axis=1)
    return h.astype(np.uint32), np.cumsum(digits[:, 0])


def keyed(h: np.ndarray) -> np.ndarray:
    """Each hash with its number among equal ones."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    number = np.empty(len(h), np.uint64)
    number[order] = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    return h.astype(np.uint64) << np.uint64(64 - HASH) | number


def aligned(a: Anchors, b: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the longest chain of common anchors (equal ones paired by their number) that stand in one order in both."""
    if not len(a[0]) or not len(b[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, i, j = np.intersect1d(keyed(a[0]), keyed(b[0]), assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    if (j[1:] > j[:-1]).all():
        return i, j
    # longest increasing run of j: for each length the least last value and where it stands
    last, where, before = [], [], []
    for k, value in enumerate(j.tolist()):
        at = bisect.bisect_left(last, value)
        before.append(where[at - 1] if at else -1)
        if at == len(last):
            last.append(value), where.append(k)
        else:
            last[at], where[at] = value, k
    chain, k = [], where[-1]
    while k >= 0:
        chain.append(k)
        k = before[k]
    chain.reverse()
    return i[chain], j[chain]


def likeness(a: Anchors, b: Anchors) -> float:
    """Twice the number of anchors in the longest chain over the number of all; two empty fingerprints are alike."""
    n = len(a[0]) + len(b[0])
    return 2.0 * len(aligned(a, b)[0]) / n if n else 1.0


def edited(text: np.ndarray, after: np.ndarray) -> tuple[int, np.ndarray]:
    """Code points of text, and its bytes with the last half of them replaced by as many first ones of `after` (or all)."""
    at = np.flatnonzero((text & 0xC0) != 0x80)
    half = len(at) // 2
    if not half:
        return len(at), text
    begins = np.flatnonzero((after[: 4 * half] & 0xC0) != 0x80)  # a code point has four bytes at most
    more = after[: begins[half]] if len(begins) > half else after[: 4 * half]
    return len(at), np.concatenate([text[: at[len(at) - half]], more])


def id_cells(docs: DataFrame, id_col: str) -> tuple[DataFrame, list]:
    """(id, text, key, h, f, s), and for each cell (f, s) in order its bytes, least and greatest key and least (key, h).

    Cells are FINE ranges of ids for each partition.  An id that fills a cell by
    itself is dealt over PARTS cells by the hash of the text.
    """
    n = FINE * partitions(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    cuts = docs.select(key.alias("key")).approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n))
    many = sorted({c for c, d in zip(cuts, cuts[1:]) if c == d})
    splits = [-np.inf, *sorted({*cuts, *(float(np.nextafter(c, np.inf)) for c in many)} or {0.0}), np.inf]
    rows = docs.select(F.col(id_col).alias("id"), text_of().alias("text"), key.alias("key"), F.xxhash64(text_of()).alias("h")).withColumn("_d", F.col("key").cast("double"))
    rows = Bucketizer(splits=splits, inputCol="_d", outputCol="_f").transform(rows).withColumn("f", F.col("_f").cast("int")).drop("_d", "_f")
    part = F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * PARTS), F.lit(PARTS - 1)).cast("int")
    rows = rows.withColumn("s", F.when(F.col("f").isin([splits.index(c) for c in many]), part).otherwise(0) if many else F.lit(0))
    cells = rows.groupBy("f", "s").agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"), F.min(F.struct("key", "h")).alias("first"))
    return rows, sorted(cells.collect(), key=lambda r: (r["f"], r["s"]))


def ranges_of(cells: list, n: int) -> list[tuple[int, int, int, tuple[int, int]]]:
    """(f, s, range, the range's least (key, h)) of each cell: runs of cells of about a n-th of all bytes; cells of one f that hold several ids stay together, as their order is by id first."""
    target, out, b, held, first = sum(r["bytes"] for r in cells) / n, [], -1, 0, None
    several = {r["f"] for r in cells if r["low"] != r["high"]} | {r["f"] for r, q in zip(cells, cells[1:]) if r["f"] == q["f"] and r["low"] != q["low"]}
    for k, r in enumerate(cells):
        together = k > 0 and r["f"] in several and cells[k - 1]["f"] == r["f"]
        if b < 0 or (held + r["bytes"] > target and not together):
            b, held, first = b + 1, 0, tuple(r["first"])
        held += r["bytes"]
        first = min(first, tuple(r["first"]))
        out.append((r["f"], r["s"], b, first))
    least = {b: first for _, _, b, first in out}
    return [(f, s, b, least[b]) for f, s, b, _ in out]


def with_next(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(b, halo, key, text, id), one range b in a partition, sorted by (b, halo, key, h, text), so that each row's next row follows it.

    Ids are dealt into ranges of about equal bytes; a few numbers for each
    partition reach the driver or are broadcast.  The first row of a range also
    ends the range before it, as a halo row, and the very first one ends the
    last range.  A null id counts as the least; rows of one id stand in the
    order of their texts' hashes.
    """
    spark = docs.sparkSession
    rows, cells = id_cells(docs, id_col)
    found = ranges_of(cells, partitions(spark))
    firsts = dict((b, first) for _, _, b, first in found)
    n = max(partitions(spark), len(firsts))
    # A number for each partition that Spark's hash deals to it, so that no two ranges share one.
    dealt = spark.range(50 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("v"))
    number = dict(dealt.collect())
    cell = spark.createDataFrame([(f, s, b, number[b]) for f, s, b, _ in found], "f int, s int, b int, v long")
    follows = spark.createDataFrame([(*firsts[b], (b - 1) % len(firsts), number[(b - 1) % len(firsts)]) for b in firsts], "first_key long, first_h long, to int, to_v long")
    table = rows.join(F.broadcast(cell), ["f", "s"]).join(F.broadcast(follows), (F.col("key") == F.col("first_key")) & (F.col("h") == F.col("first_h")), "left")
    own = F.struct(F.col("b"), F.col("v"), F.lit(0).alias("halo"))
    both = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("b"), F.col("to_v").alias("v"), F.lit(1).alias("halo"))))
    table = table.select("key", "h", "text", "id", F.explode(both).alias("place"))
    table = table.select("place.b", "place.v", "place.halo", "key", "h", "text", "id").repartition(n, "v").sortWithinPartitions("b", "halo", "key", "h", "text")
    return table.select("b", "halo", "key", "text", "id")


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of each row and its edited text, and their likeness, from rows that their next rows follow."""
    run, row = None, None
    for batch in batches:
        out = []
        b, halo, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
        raw, at = strings(texts)
        for i in range(batch.num_rows):
            if b[i] != run:
                run, row = b[i], None
            if halo[i] and row is None:  # only the first halo row follows a row
                continue
            text = raw[at[i] : at[i + 1]].copy()
            mine = anchors(text)
            if row is not None:
                of, before, theirs = row
                n, other = edited(before, text)
                new = anchors(other)
                out.append((of, n, hashlib.sha256(other.tobytes()).hexdigest(), as_text(theirs), as_text(new), likeness(theirs, new), likeness(theirs, mine)))
            row = None if halo[i] else (batch.column(4)[i], text, mine)
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in cols[0]], batch.column(4).type), *[pa.array(c) for c in cols[1:]]], names=OUT)


OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document's fingerprint, its edited text's, and the likeness of the first to the second and to the next document's.

    Null text counts as empty; an empty text has the empty fingerprint, which is
    like another empty one only.  Rows of one id stand in the order of their
    texts' hashes.  Extra columns are ignored; a table of one row follows itself;
    an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in OUT[2:5]], *[T.StructField(c, T.DoubleType()) for c in OUT[5:]]])
    return with_next(docs, id_col).mapInArrow(compared, schema)


def fingerprint_docs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint) of every document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = strings(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_text(anchors(raw[at[i] : at[i + 1]])) for i in range(batch.num_rows)], pa.string())], names=[id_col, "fingerprint"])

    chosen_cols = docs.select(id_col, text_of().alias("text"))
    return chosen_cols.mapInArrow(run, T.StructType([chosen_cols.schema[id_col], T.StructField("fingerprint", T.StringType())]))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents"))
