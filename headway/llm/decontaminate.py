"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose six of nine neighbouring tokens, so a changed token spoils
only the seeds that look at it.  Seeds of the benchmark and of the documents
meet by their hash; around each hit the two token runs are laid side by side,
and a window of WINDOW tokens with at most CHANGES differences is a verified
overlap.  The two masks find every such window: whichever two of 13 tokens
change, one mask fits beside them.

An item of SPAN to WINDOW - 1 tokens must stand whole, with one change at most;
its seeds are its two halves, of which one is unchanged then.  A shorter item
must stand whole and unchanged.  A token is a run of letters and digits; in
scripts without spaces between words every character is one.

The benchmark is the stated query set.  Its distinct texts are worked through
in blocks of at most BLOCK_TOKENS tokens.  One operator reads every document
against the blocks one after another and holds one block at a time, without a
shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, Hasher, grams, read, spans_where, steps, text_of

#: Positions of a seed's tokens (fixed masks).
MASKS = ((0, 1, 2, 5, 7, 8), (0, 2, 3, 6, 7, 8))
SPAN = 9
WINDOW = 13
CHANGES = 2
#: The pipeline keeps documents that hold an item of fewer tokens, as so few stand in clean texts too.
LEAST_TOKENS = 5
BLOCK_TOKENS = 400_000
#: Bytes of text that a worker takes through all blocks at once, if there are several.
GROUP_BYTES = 64 << 20

IS_TOKEN = np.zeros(256, bool)
IS_TOKEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and U+00C0 to U+00DE in lower case."""
    out = LOWER[data]
    if len(out) > 1:
        accent = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accent] += 0x20
    return out


def tokens(hasher: Hasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (runs of letters and digits) of a step, and the index of each row's first (rows + 1)."""
    text = folded(data)
    starts, ends, first = spans_where(IS_TOKEN[text], offsets, unspaced(text))
    return hasher(text, starts, ends), first


def unspaced(text: np.ndarray) -> np.ndarray | None:
    """Where characters of scripts without spaces begin and end: U+3000 to U+9FFF (kana, Han) and U+0E00 to U+0EBF (Thai, Lao); None without any."""
    lead = (text >= 0xE3) & (text <= 0xE9)
    lead[:-1] |= (text[:-1] == 0xE0) & (text[1:] >= 0xB8) & (text[1:] <= 0xBA)
    at = np.flatnonzero(lead)
    return np.concatenate([at, at + 3]) if len(at) else None


def allowed(size: int) -> tuple[int, int]:
    """(tokens that must lie side by side, changes among them) for an item of so many tokens."""
    return min(WINDOW, size), CHANGES if size >= WINDOW else 1 if size >= SPAN else 0


class Block:
    """Tokens and sorted seeds of some benchmark items."""

    def __init__(self, ids: list[str], texts: list[str]):
        data = np.frombuffer("\n".join(texts).encode(), np.uint8)
        sizes = [len(t.encode()) for t in texts]
        ends = np.cumsum([s + 1 for s in sizes])
        offsets = np.minimum(np.concatenate([[0], ends]), len(data)).astype(np.int64)
        self.ids = ids
        self.words, self.first = tokens(Hasher(), data, offsets)
        self.item = np.repeat(np.arange(len(ids)), np.diff(self.first))
        size = np.diff(self.first)
        small = sorted({n for n in size.tolist() if 0 < n < WINDOW})
        #: (places of a seed's tokens, the size of items that it is for; 0: those of WINDOW tokens and more)
        self.masks = [(np.array(m), 0) for m in MASKS]
        for n in small:
            parts = (np.arange(n),) if n < SPAN else (np.arange(n // 2), np.arange(n // 2, n))
            self.masks += [(m, n) for m in parts]
        self.seeds = []
        for mask, n in self.masks:
            h = grams(self.words, mask)
            if n:
                at = self.first[:-1][size == n]
            else:
                at = np.flatnonzero(self.item[: len(h)] == self.item[int(mask[-1]) : int(mask[-1]) + len(h)]) if len(h) else np.zeros(0, np.int64)
                at = at[size[self.item[at]] >= WINDOW]
            order = np.argsort(h[at], kind="stable")
            self.seeds.append((h[at][order], at[order]))
        self.filter = [np.zeros(1 << (22 if n == 0 else 16), bool) for _, n in self.masks]
        for f, (h, _) in zip(self.filter, self.seeds):
            f[h >> np.uint64(65 - len(f).bit_length())] = True

    def overlaps(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, tokens in verified windows) for a step's rows."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found = []
        for (mask, _), may, (seeds, places) in zip(self.masks, self.filter, self.seeds):
            h = grams(words, mask)
            at = np.flatnonzero(may[h >> np.uint64(65 - len(may).bit_length())])
            at = at[row[at] == row[at + int(mask[-1])]]
            low, high = np.searchsorted(seeds, h[at], "left"), np.searchsorted(seeds, h[at], "right")
            n = high - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            place = places[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            found.append(np.stack([np.repeat(row[at], n), self.item[place], np.repeat(at, n) - place], axis=1))
        best: dict[tuple[int, int], int] = {}
        for r, i, shift in np.unique(np.concatenate(found), axis=0).tolist():
            a, b = int(self.first[i]), int(self.first[i + 1])
            low, high = max(a, int(first[r]) - shift), min(b, int(first[r + 1]) - shift)
            same = self.words[low:high] == words[low + shift : high + shift]
            need, changes = allowed(b - a)
            if high - low < need:
                continue
            sums = np.concatenate([[0], np.cumsum(same)])
            good = sums[need:] - sums[:-need] >= need - changes
            if good.any():
                cover = np.convolve(good, np.ones(need, np.int64)) > 0
                best[r, i] = max(best.get((r, i), 0), int(cover.sum()))
        return [(r, i, n) for (r, i), n in best.items()]


def blocks(benchmark: DataFrame, id_col: str, limit: int, least: int) -> Iterator[Block]:
    """The distinct texts of `least` tokens or more in order of their least ids, in blocks of at most `limit` bytes / 2 tokens; only one block at a time is on its way to the driver."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), text_of().alias("text"), F.col(id_col).alias("order"))
    items = items.groupBy("text").agg(F.min("order").alias("order"), F.array_join(F.sort_array(F.collect_set("id")), " ").alias("ids")).orderBy("order", "text")
    ids, texts, size, hasher = [], [], 0, Hasher()
    for r in items.toLocalIterator():
        data = np.frombuffer(r["text"].encode(), np.uint8)
        if not len(data) or len(tokens(hasher, data, np.array([0, len(data)]))[0]) < max(least, 1):
            continue
        n = len(data) // 2 + 1
        if ids and size + n > limit:
            yield Block(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["ids"] or "null")
        texts.append(r["text"])
        size += n
    if ids:
        yield Block(ids, texts)


class Blocks:
    """All blocks as broadcasts, of which a task's worker holds one at a time: with several, each is read from the executor's disk when it is its turn.

    A broadcast holds a block's pickled bytes, made by value like the tasks'
    functions, so executors don't need this package.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, item_col: str, limit: int, least: int):
        self.shared = [docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(b)) for b in blocks(benchmark, item_col, limit, least)]
        self.only: Block | None = None

    def each(self) -> Iterator[Block]:
        for shared in self.shared:
            block = self.only or pickle.loads(shared.value)
            if len(self.shared) > 1:
                vars(shared).pop("_value", None)  # what the worker read stays cached there otherwise
            else:
                self.only = block
            yield block

    def grouped(self, batches: Iterator[pa.RecordBatch], place: int) -> Iterator[list[pa.RecordBatch]]:
        """The batches as they come, or with several blocks in groups of GROUP_BYTES of text, so that blocks are read once for a group."""
        group, size = [], 0
        for batch in batches:
            group.append(batch)
            size += batch.column(place).nbytes
            if len(self.shared) <= 1 or size >= GROUP_BYTES:
                yield group
                group, size = [], 0
        if group:
            yield group

    def overlaps(self, hasher: Hasher, group: list[pa.RecordBatch], place: int) -> Iterator[tuple[int, int, str, int]]:
        """(batch of the group, row, ids of the items of one text, tokens) of everything found."""
        for block in self.each():
            for k, batch in enumerate(group):
                for i, _, data, offsets in steps(batch.column(place)):
                    for r, item, n in block.overlaps(*tokens(hasher, data, offsets)):
                        yield k, i + r, block.ids[item], n


FOUND = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("tokens", T.LongType())]))


def search(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_TOKENS, least: int = 1) -> DataFrame:
    """docs with `overlaps`: the benchmark items found in each row, with the number of tokens in verified windows.

    `item` holds the ids of all items with that text, joined by spaces.  Null
    texts on either side count as empty and match nothing, and so do texts
    without tokens and items of fewer tokens than `least`.  Rows, repeated ones
    too, keep all their columns; an existing column `overlaps` is replaced.
    """
    out = docs.drop("overlaps").withColumn("overlaps", F.array().cast(FOUND))
    place, last, found_in = out.columns.index(text_col), len(out.columns) - 1, Blocks(docs, benchmark, item_col, limit, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for group in found_in.grouped(batches, place):
            found = [[[] for _ in range(batch.num_rows)] for batch in group]
            for k, row, item, n in found_in.overlaps(hasher, group, place):
                found[k][row].append({"item": item, "tokens": n})
            for batch, rows in zip(group, found):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, batch.column(last).type)], names=batch.schema.names)

    return out.mapInArrow(run, out.schema)


def without_passages(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_TOKENS, least: int = LEAST_TOKENS) -> DataFrame:
    """The rows of docs that hold no verified passage of a benchmark item of at least `least` tokens, all columns as they are."""
    place, found_in = docs.columns.index(text_col), Blocks(docs, benchmark, item_col, limit, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for group in found_in.grouped(batches, place):
            clean = [np.ones(batch.num_rows, bool) for batch in group]
            for k, row, _, _ in found_in.overlaps(hasher, group, place):
                clean[k][row] = False
            for batch, kept in zip(group, clean):
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark passages, and which."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = search(docs, read(spark, sf_dir, "benchmark")).filter(F.size("overlaps") > 0)
    return found.select(
        "doc_id",
        F.size("overlaps").cast("long").alias("n_items"),
        F.array_join(F.sort_array(F.transform("overlaps", lambda o: o["item"])), ",").alias("items"),
        F.coalesce(F.array_max(F.transform("overlaps", lambda o: o["tokens"])), F.lit(0)).cast("long").alias("longest"),
    )
