"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Texts meet by SimHash first: fingerprints over the same shingles that differ in
two bits at most are found by `simhash`'s BK-trees, and the pairs that they give
are compared by their exact sets.  At a similarity of 0.8 fingerprints differ in
about 10 of 64 bits, more than equal blocks can make certain, so what is not yet
one class meets by MinHash: of 32 bands of four minima a pair at 0.8 shares one
with all but 5e-8 probability, a more similar pair all the more.  Bands whose
texts SimHash has joined already are not looked into.

A band's texts meet in one task with their sets, groups of the same texts once,
and each group sends on a link of exactly compared texts for every two classes
that it joins: no more links than texts, however many pairs are similar.  A text
is compared with all others at once, and only those outside the largest class
need it, as any link that is still to be found has one of them at an end.  A
group whose sets are over SPLIT shingles is dealt over several tasks; then the
texts outside its largest class are sent to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, mix, partitions, steps, text_of
from .simhash import components, links, majority, shingles

WORDS = 5
#: Similarity from which texts are near copies, as a fraction of whole numbers.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 4
#: Shingles of a group's sets that meet in one task.
SPLIT = 1 << 21
FACTORS, ADDENDS, BAND_FACTORS = (mix(np.arange(k, k + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1) for k in (1, 1001, 2001))


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): each row's different shingles in order, and the index of its first one (rows + 1 of them)."""
    owner, values = shingles(data, offsets, WORDS)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(offsets)))


def names_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """XXH64 of each row's set, as texts of equal sets are one text here."""
    return np.array([xxhash.xxh64_intdigest(values[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], np.uint64)


def fingerprints_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash fingerprint of each row's set."""
    return majority(np.repeat(np.arange(len(first) - 1), np.diff(first)), values, len(first) - 1)


def bands_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS keys for each row's set."""
    out = np.zeros((len(first) - 1, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for k in range(BANDS * ROWS):
            out[some, k // ROWS] += mix(np.minimum.reduceat(values * FACTORS[k] + ADDENDS[k], first[some])) * BAND_FACTORS[k]
    return out


def listed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, h, name, n, fp, bands) of every row, h being XXH64 of the text, n the size of its shingle set and fp the set's SimHash; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in steps(batch.column(2)):
                values, first = sets_of(data, offsets)
                bands = listed(bands_of(values, first).ravel(), np.arange(j - i + 1) * BANDS)
                cols = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names_of(values, first).view(np.int64)), pa.array(np.diff(first)), pa.array(fingerprints_of(values, first).view(np.int64)), bands]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "name", "n", "fp", "bands"])

    chosen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    return chosen.mapInArrow(run, T.StructType([chosen.schema["id"], *T.StructType.fromDDL("h long, name long, n long, fp long, bands array<long>").fields]))


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, shingles) of batches (text)."""
    for batch in batches:
        for _, _, data, offsets in steps(batch.column(0)):
            values, first = sets_of(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(names_of(values, first).view(np.int64)), listed(values, first)], names=["name", "shingles"])


def group_links(values: np.ndarray, first: np.ndarray, classes: np.ndarray, pivots: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of similar sets (by index) that join the classes which all similar pairs with a pivot join; all sets hold something."""
    size, (p, q) = np.diff(first), SIMILAR
    ids = np.unique(values, return_inverse=True)[1]
    mark = np.zeros(int(ids.max()) + 1, bool)
    cls = np.unique(classes, return_inverse=True)[1]
    out, waiting = [], pivots.copy()
    while True:
        largest = np.bincount(cls).argmax()
        # Without an end outside the largest class a link joins nothing; pivots that are all there is must all be asked.
        next_ = np.flatnonzero(waiting & (cls != largest)) if pivots.all() else np.flatnonzero(waiting)
        if not len(next_):
            return out
        x = int(next_[0])
        waiting[x] = False
        other = cls != cls[x]
        if not other.any():
            continue
        own = ids[first[x] : first[x + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[ids], first[:-1], dtype=np.int64)
        mark[own] = False
        near = np.flatnonzero(other & (common * (p + q) >= p * (size[x] + size)))
        found, at = np.unique(cls[near], return_index=True)
        out += [(x, int(near[k])) for k in at]
        cls[np.isin(cls, found)] = cls[x]


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, chunk, pivot, name, label, shingles), sorted by the first three, to links (a, b); a group is carried over batches."""
    held_key, held = None, []

    def of(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        name, label, pivot = (rows.column(c).to_numpy() for c in ("name", "label", "pivot"))
        lists = rows.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        at = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[at[0] : at[-1]].view(np.uint64)
        pairs = np.array(group_links(values, at - at[0], label, pivot), np.int64).reshape(-1, 2)
        return name[pairs[:, 0]], name[pairs[:, 1]]

    def batch_of(pairs: list) -> pa.RecordBatch:
        cols = [np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        pairs = []
        for i, j in zip(np.concatenate([[0], cut]).tolist(), [*cut.tolist(), batch.num_rows]):
            if (key := tuple(keys[:, i])) != held_key:
                if sum(b.num_rows for b in held) > 1:
                    pairs.append(of(held))
                held_key, held = key, []
            held.append(batch.slice(i, j - i))
        yield batch_of(pairs)
    if sum(b.num_rows for b in held) > 1:
        yield batch_of([of(held)])


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): names of texts to compare, those that BK-trees link by fingerprints within two bits, and neighbours by name of one fingerprint."""
    some = texts.filter("n > 0").select("name", "fp")
    firsts = materialize(some.groupBy("fp").agg(F.min("name").alias("first")), "firsts")
    side = lambda end, name: firsts.select(F.col("fp").alias(end), F.col("first").alias(name))
    across = links(firsts.select("fp")).withColumnsRenamed({"a": "p", "b": "q"}).join(side("p", "a"), "p").join(side("q", "b"), "q").select("a", "b")
    same = some.select("name", F.lag("name").over(Window.partitionBy("fp").orderBy("name")).alias("b")).filter("b is not null").select(F.col("name").alias("a"), "b")
    return across.unionByName(same)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of names whose sets are similar, compared exactly."""
    p, q = SIMILAR
    side = lambda end: sets.select(F.col("name").alias(end), F.col("shingles").alias(f"of_{end}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return rows.filter(F.size(F.array_intersect("of_a", "of_b")) * (p + q) >= p * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def groups_of(texts: DataFrame) -> DataFrame:
    """(key, total, parts): bands' keys of several texts, one for all groups of the same texts, and the shingles of the group."""
    members = texts.filter("n > 0").select("name", "n", F.explode("bands").alias("key"))
    same = [F.count(F.lit(1)).alias("c"), F.min("name").alias("low"), F.max("name").alias("high"), *[F.bit_xor(F.xxhash64("name", F.lit(k))).alias(f"x{k}") for k in (1, 2)]]
    groups = members.groupBy("key").agg(*same, F.sum("n").alias("total")).filter("c > 1")
    groups = groups.groupBy("c", "low", "high", "x1", "x2").agg(F.min("key").alias("key"), F.first("total").alias("total"))
    return groups.select("key", "total", F.ceil(F.col("total") / SPLIT).alias("parts"))


def dealt(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the groups (key, part, chunk) of rows (.., pivot, name, label)."""
    full = rows.join(sets, "name").select("key", "part", "chunk", "pivot", "name", "label", "shingles")
    return full.repartition(partitions(rows.sparkSession), "key", "part", "chunk").sortWithinPartitions("key", "part", "chunk", "name").mapInArrow(linked, "a long, b long")


def part_of(name: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(name), parts)


def near_links(docs: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """(v, label): for every text (name, n, fp, least id and hash, bands) with a near copy, the least name that pairs of near copies reach."""
    groups = materialize(groups_of(texts), "groups")
    members = texts.filter("n > 0").select("name", "n", F.explode("bands").alias("key")).join(groups, "key")
    members = materialize(members.select("key", "parts", "name", "n", part_of("name", F.col("parts")).alias("part")), "members")
    pairs = materialize(simhash_pairs(texts), "pairs")
    # The row of least id stands for the copies of a text, which don't meet then.
    met = members.select("name").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = texts.join(met, "name", "left_semi").select(F.col("least.id").alias("least_id"), F.col("least.h").alias("least_h"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    chosen = rows.join(wanted, rows["id"].eqNullSafe(wanted["least_id"]) & (rows["h"] == wanted["least_h"]), "left_semi").dropDuplicates(["h"])
    sets = materialize(chosen.select("text").mapInArrow(shingle_sets, "name long, shingles array<long>"), "sets")
    sure = materialize(similar(pairs, sets), "sure")
    known = components(sure)
    members = members.join(known, members["name"] == known["v"], "left").withColumn("label", F.coalesce("label", "name")).drop("v")
    several = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    members = materialize(members.join(several, "key", "left_semi"), "open")
    zero, yes = F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("pivot")
    edges = materialize(dealt(members.select("key", "part", zero, yes, "name", "label"), sets).union(sure).distinct(), "edges")
    labels = components(edges)
    members = members.drop("label")
    split = members.filter("parts > 1")
    if split.isEmpty():
        return labels
    split = materialize(split.join(labels, split["name"] == labels["v"], "left").withColumn("label", F.coalesce("label", "name")).drop("v"), "split")
    main = split.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    outside = split.join(main, "key").filter("label <> main").drop("main")
    chunks = materialize(outside.groupBy("key").agg(F.ceil(F.sum("n") / SPLIT).alias("chunks")), "chunks")
    outside = outside.join(chunks, "key").select("key", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), part_of("name", F.col("chunks")).alias("chunk"), yes, "name", "label")
    inside = split.join(chunks, "key").select("key", "part", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), F.lit(False).alias("pivot"), "name", "label")
    more = dealt(inside.unionByName(outside), sets).filter("a <> b")
    return components(edges.union(materialize(more.distinct(), "edges")))


def near_copies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, h, component): every row's text hash and the least id among the rows that near copies join it with.

    Texts with equal shingle sets are joined, those without words among
    themselves.  A row with a null id is joined like any other, but a null is
    never the least id unless its component has no other.
    """
    found = materialize(signatures(docs, id_col), "signatures")
    least = F.coalesce(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h"))), F.min(F.struct("id", "h")))
    texts = materialize(found.groupBy("name").agg(least.alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "texts")
    labels = near_links(docs, texts, id_col)
    named = materialize(texts.join(labels, texts["name"] == labels["v"], "left").select("name", F.col("least.id").alias("least_id"), F.coalesce("label", "name").alias("label")), "named")
    smallest = named.groupBy("label").agg(F.min("least_id").alias("component"))
    table = materialize(named.join(smallest, "label").select("name", "component"), "table")
    return found.select("id", "h", "name").join(table, "name").select(F.col("id").alias(id_col), "h", "component")
