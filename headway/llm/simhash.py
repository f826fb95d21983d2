"""SimHash near-dedup with BK-trees.

A fingerprint bit is set if more than half of the shingles' XXH64 values set
it.  Two fingerprints that differ in at most two bits agree in two of four
16-bit blocks at least, so distinct fingerprints meet in shards keyed by two
blocks; one BK-tree is built for each shard and its members follow only the
edges within the radius.  A shard of more than SPLIT members is keyed again by
two of four 8-bit blocks of the other 32 bits; what is then still free is 16
bits, so no tree has more than 65,536 nodes, however hot a shard is.  A shard
sends on one link for each member to its local representative; components come
from minimum labels with pointer jumping over those links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, materialize, partitions, read, steps, text_of, word_spans

WORDS = 3
SEED = 42
RADIUS = 2
SPLIT = 4096
#: Shingles whose bits are unpacked at a time.
PIECE = 1 << 16
#: A-Z in lower case, and every separator a space.
FOLD = LOWER.copy()
FOLD[9:14] = 0x20


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(row, XXH64) of every shingle of a step of text, rows of fewer words last; each row's shingles stand together."""
    starts, ends, first = word_spans(data, offsets)
    text = FOLD[data].tobytes()
    count, rows = np.diff(first), len(offsets) - 1
    row = np.repeat(np.arange(rows), count)
    if len(starts) >= words:
        at = np.flatnonzero(row[: len(row) - words + 1] == row[words - 1 :])
    else:
        at = np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    at_end = at + words - 1
    gaps = starts[1:] - ends[:-1] - 1  # separators beyond one
    wide = np.concatenate([[0], np.cumsum(gaps != 0)])
    plain = wide[at_end] == wide[at]
    digest = xxhash.xxh64_intdigest
    s, e = starts.tolist(), ends.tolist()
    hashes = [digest(text[s[a] : e[b]], seed) for a, b in zip(at.tolist(), at_end.tolist())]
    for k in np.flatnonzero(~plain).tolist():
        a, b = int(at[k]), int(at_end[k])
        hashes[k] = digest(b" ".join(text[s[i] : e[i]] for i in range(a, b + 1)), seed)
    for r in short.tolist():
        hashes.append(digest(b" ".join(text[s[i] : e[i]] for i in range(first[r], first[r + 1])), seed))
    return np.concatenate([row[at], short]), np.array(hashes, dtype="<u8")


def simhash(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprint (uint64) of each row of a step of text."""
    return majority(*shingles(data, offsets, words, seed), len(offsets) - 1)


def majority(owner: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Fingerprint (uint64) of each of so many rows from hashes with their rows, a row's hashes standing together."""
    ones, total = np.zeros((rows, 64), np.int64), np.bincount(owner, minlength=rows)
    for i in range(0, len(values), PIECE):
        own = owner[i : i + PIECE]
        bits = np.unpackbits(values[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        np.add.at(ones, own[begin], np.add.reduceat(bits, begin, axis=0, dtype=np.int64))
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, h, fp long) of every row of docs, h being XXH64 of the text; null text counts as empty, and a text without words has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(data, offsets, words, seed) for _, _, data, offsets in steps(batch.column(2))]
            fp = np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["id", "h", "fp"])

    chosen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    return chosen.mapInArrow(run, T.StructType([chosen.schema["id"], T.StructField("h", T.LongType()), T.StructField("fp", T.LongType())]))


class BKTree:
    """Children of a node are keyed by their integer Hamming distance to it.

    The tree is laid out over arrays: a node's subtree is split by distance, and
    each part's first value is the child.
    """

    def __init__(self, values: np.ndarray):
        self.values, self.children = values, []
        waiting: list[tuple[int, np.ndarray]] = []
        self.children = [{} for _ in values]
        if len(values):
            waiting.append((0, np.arange(1, len(values))))
        while waiting:
            node, below = waiting.pop()
            if not len(below):
                continue
            d = np.bitwise_count(values[below] ^ values[node])
            order = np.argsort(d, kind="stable")
            below, d = below[order], d[order]
            cut = np.flatnonzero(d[1:] != d[:-1]) + 1
            for part, distance in zip(np.split(below, cut), d[np.concatenate([[0], cut])].tolist()):
                self.children[node][distance] = int(part[0])
                waiting.append((int(part[0]), part[1:]))

    def links(self, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, queries within the radius of it), all values being queries that go down the tree together."""
        waiting = [(0, np.arange(len(self.values)))] if len(self.values) else []
        while waiting:
            node, queries = waiting.pop()
            d = np.bitwise_count(self.values[queries] ^ self.values[node]).astype(np.int64)
            near = queries[d <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                going = queries[np.abs(d - edge) <= radius]
                if len(going):
                    waiting.append((child, going))


def shard_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, local representative) for the values of one shard that have a link."""
    if len(values) == 2:
        near = np.bitwise_count(values[:1] ^ values[1:]) <= radius
        return values[1:][near], values[:1][near]
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for node, near in BKTree(values).links(radius):
        top = root(node)
        for q in near[near != node].tolist():
            if (other := root(q)) != top:
                low, high = min(top, other), max(top, other)
                parent[high], top = low, low
    roots = np.array([root(i) for i in range(len(values))])
    moved = np.flatnonzero(roots != np.arange(len(values)))
    return values[moved], values[roots[moved]]


def shard_runs(radius: int):
    """For partitions sorted by shard: links of every shard; a shard's rows are carried over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def of(key_values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            values = np.unique(np.concatenate(key_values))
            return shard_links(values, radius) if len(values) > 1 else (values[:0], values[:0])

        def batch_of(pairs: list) -> pa.RecordBatch:
            a = np.concatenate([p[0] for p in pairs] or [np.zeros(0, np.uint64)]).view(np.int64)
            b = np.concatenate([p[1] for p in pairs] or [np.zeros(0, np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            fps = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(fps)]])
            pairs = []
            for i in np.flatnonzero((end - begin > 1) | (begin == 0) | (end == len(fps))).tolist():
                key, part = tuple(keys[:, begin[i]]), fps[begin[i] : end[i]].copy()
                if key != held_key:
                    if held:
                        pairs.append(of(held))
                    held_key, held = key, []
                held.append(part)
            yield batch_of(pairs)
        if held:
            yield batch_of([of(held)])

    return run


def blocks(fp: Column, start: int, width: int) -> list[Column]:
    """Four blocks of the given width, from bit start upwards."""
    return [F.shiftrightunsigned(fp, start + width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(4)]


def pair_keys(parts: list[Column], width: int) -> Column:
    """(pair, value) of every two of four blocks."""
    return F.array(*[F.struct(F.lit(p).alias("pair"), (parts[i] * (1 << width) + parts[j]).alias("value")) for p, (i, j) in enumerate(combinations(range(4), 2))])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within the radius (2 at most) do."""
    if radius > 2:
        raise ValueError("two equal blocks of four are certain up to two differing bits only")
    spark = distinct.sparkSession
    keyed = distinct.select("fp", F.explode(pair_keys(blocks(F.col("fp"), 0, 16), 16)).alias("k")).select("fp", "k.pair", "k.value")
    large = keyed.groupBy("pair", "value").count().filter(F.col("count") > SPLIT).select("pair", "value", F.lit(True).alias("large"))
    keyed = keyed.join(large, ["pair", "value"], "left")
    # The 32 bits outside the two equal blocks, packed, for the shards that are keyed again.
    free = F.lit(None).cast("long")
    b = blocks(F.col("fp"), 0, 16)
    for p, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = [x for x in range(4) if x not in (i, j)]
        free = F.when(F.col("pair") == p, b[k] * 65536 + b[m]).otherwise(free)
    none = F.array(F.struct(F.lit(-1).alias("pair"), F.lit(0).cast("long").alias("value")))
    keyed = keyed.withColumn("free", free).withColumn("sub", F.explode(F.when(F.col("large"), pair_keys(blocks(F.col("free"), 0, 8), 8)).otherwise(none)))
    shards = keyed.select((F.col("pair") * 8 + F.col("sub.pair") + 1).cast("long").alias("p"), "value", F.col("sub.value").alias("s"), "fp")
    return (
        shards.repartition(partitions(spark), "p", "value", "s")
        .sortWithinPartitions("p", "value", "s", "fp")
        .mapInArrow(shard_runs(radius), "a long, b long")
        .distinct()
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, label): every vertex of the edges (a, b) with the least vertex that can be reached from it.

    Each round takes the least label among a vertex and its neighbours and then
    that label's own label; a written table ends each round's lineage.
    """
    both = materialize(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")), name)
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["v"] == near["a"]).select("v", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("v").alias("j"), F.col("label").alias("to"))
        after = least.join(jump, least["next"] == jump["j"], "left").select("v", "was", F.least("next", F.coalesce("to", "next")).alias("label"))
        moved = Observation()
        after = materialize(after.observe(moved, F.count_if(F.col("label") != F.col("was")).alias("n")), name)
        labels = after.select("v", "label")
        if not moved.get["n"]:
            return labels


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(id, h, fp, component): every row's fingerprint and the least id among the rows that its links reach.

    A row with a null id is linked like any other, but a null is never the least
    id unless its component has no other.  Repeated rows share a fingerprint.
    """
    fps = materialize(fingerprint(docs, id_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    labels = components(links(distinct.select("fp"), radius))
    named = distinct.join(labels, distinct["fp"] == labels["v"], "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label"))
    named = materialize(named, "named")
    smallest = named.groupBy("label").agg(F.min("least_id").alias("component"))
    # A written table on both sides of the last join, which Spark then splits where one fingerprint is hot.
    table = materialize(named.select("fp", "label").join(smallest, "label").select("fp", "component"), "table")
    return fps.join(table, "fp").select(F.col("id").alias(id_col), "h", "fp", "component")


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component of groups (id, h, component), the one of least id, and of repeated rows of it one.

    A row with a null id goes if its component has a row with an id, and stays
    otherwise.  Different texts under one id are told apart by their texts.
    """
    found = materialize(groups.select(F.col(id_col).alias("id"), "h", "component"), "found")
    gone = found.filter(~F.col("id").eqNullSafe(F.col("component"))).select("id", "h").distinct()
    kept = docs.join(gone, docs[id_col].eqNullSafe(gone["id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == gone["h"]), "left_anti")
    again = found.filter(F.col("id") == F.col("component")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.isEmpty():
        return kept
    again = materialize(again.select("id"), "again")
    several = kept[id_col] == again["id"]
    return kept.join(again, several, "left_anti").unionByName(kept.join(again, several, "left_semi").dropDuplicates([id_col, text_col]))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
