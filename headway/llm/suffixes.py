"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at content-selected positions: for every window of LEAST
words, the position of the least hash of its first STARTS runs of GRAM words.
Equal windows choose the same position, wherever they stand, so a passage of
LEAST words or more shares a kept suffix with its copies.

1. Each kept suffix is named by the hash of its first PREFIX words; only names
   that occur in different texts go on.
2. Their documents' texts give the words after the prefix and before the suffix.
3. Suffixes are sorted by name and what follows, over ranges of that order, and
   neighbours compared.  For each number of words to the left, runs of
   neighbours that agree far enough to the right are split by what precedes;
   where texts differ, both hold the window.  Words are compared by 64-bit
   hashes, and the union of windows extends each match to its ends.
4. The order is read in pieces of about CHUNK suffixes, wherever a name ends.  A
   run that touches the edge of a piece may go on beyond it: for each of its
   windows the piece hands on one row if texts differ in it already, and its
   suffixes if not, and an aggregation by window joins the pieces' rows.

So one way serves names of every size, and no task holds more than a piece.
Rows meet the shared names and windows in joins of two written tables, which
Spark splits where one key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Hasher, grams, materialize, mix, partitions, read, steps, text_of, word_spans

LEAST = 50
PREFIX = 20
GRAM = 5
STARTS = LEAST - PREFIX + 1
#: Words on either side of a prefix that a window of LEAST words can hold.
SIDE = LEAST - PREFIX
#: Suffixes of the sorted order that are compared at a time.
CHUNK = 20_000
#: Bytes of a word's hash in a context.
WIDTH = 8
#: Suffixes whose contexts are laid out at a time.
PIECE = 1 << 14
PLAIN = np.arange(256, dtype=np.uint8)


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def kept(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions (over a step's words) of the suffixes that some window of LEAST words chooses."""
    if len(words) < LEAST:
        return np.zeros(0, np.int64)
    order = grams(words, np.arange(GRAM))
    order[order == 0] = 1
    n = len(words) - LEAST + 1  # starts of windows
    least = sliding(order, STARTS, np.minimum)[:n].copy()
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    least[row[:n] != row[LEAST - 1 :]] = 0  # a window that crosses an edge chooses nothing
    padded = np.concatenate([np.zeros(STARTS - 1, np.uint64), least, np.zeros(STARTS - 1, np.uint64)])
    chosen = sliding(padded, STARTS, np.maximum)
    return np.flatnonzero(chosen == order[: len(chosen)])


def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, t, pos) of the kept suffixes; pos counts words from the start of the row."""
    hasher = Hasher(PLAIN)
    for batch in batches:
        t = batch.column(0).to_numpy(zero_copy_only=False)
        for i, _, data, offsets in steps(batch.column(1)):
            starts, ends, first = word_spans(data, offsets)
            words = hasher(data, starts, ends)
            at = kept(words, first)
            row = np.searchsorted(first, at, "right") - 1
            name = grams(words, np.arange(PREFIX))[at] if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(t[i + row]), pa.array((at - first[row]).astype(np.int32))], names=["name", "t", "pos"])


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, one, text, positions) to (name, t, one, pos, n_left, n_right, left, right): the words beside each prefix, nearest first, zeros where there are none."""
    hasher = Hasher(PLAIN)
    for batch in batches:
        t, one, at_list = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(3).to_pylist()
        for i, j, data, offsets in steps(batch.column(2)):
            starts, ends, first = word_spans(data, offsets)
            words = hasher(data, starts, ends)
            at = np.concatenate([np.array(at_list[r], np.int64) + first[r - i] for r in range(i, j)])
            row = np.searchsorted(first, at, "right") - 1
            name = grams(words, np.arange(PREFIX)).view(np.int64)
            raw = words.astype(">u8").view(np.uint8).reshape(-1, WIDTH)
            step = np.arange(SIDE)
            for lo in range(0, len(at), PIECE):
                a, r = at[lo : lo + PIECE], row[lo : lo + PIECE]
                n_left, n_right = np.minimum(SIDE, a - first[r]), np.minimum(SIDE, first[r + 1] - a - PREFIX)
                cols = []
                for index, n in ((a[:, None] - 1 - step, n_left), (a[:, None] + PREFIX + step, n_right)):
                    side = raw[np.clip(index, 0, len(words) - 1)]
                    side[step >= n[:, None]] = 0
                    cols.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIDE * WIDTH), len(a), [None, pa.py_buffer(np.ascontiguousarray(side))]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[a]), pa.array(t[i + r]), one.take(pa.array(i + r)), pa.array((a - first[r]).astype(np.int32)), pa.array(n_left.astype(np.int32)), pa.array(n_right.astype(np.int32)), *cols],
                    names=["name", "t", "one", "pos", "n_left", "n_right", "left", "right"],
                )


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbers(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [column(batch, c).to_numpy(zero_copy_only=False) for c in columns]


def sides(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Context words as a matrix of integers."""
    return np.frombuffer(b"".join(column(batch, name).to_pylist()), ">u8").reshape(batch.num_rows, SIDE).astype(np.uint64)


def running(matrix: np.ndarray, most: int = SIDE) -> np.ndarray:
    """Hashes of the first 0, 1, ... `most` words of each row."""
    out = np.zeros((len(matrix), most + 1), np.uint64)
    for k in range(most):
        out[:, k + 1] = mix(out[:, k] * np.uint64(0x9E3779B97F4A7C15) + matrix[:, k] + np.uint64(1))
    return out


def windows_of(
    name: np.ndarray, t: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, left: np.ndarray, right: np.ndarray, within: bool, before_open: bool, after_open: bool
) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Of suffixes sorted by name and what follows: for each and each number of words to the left, the index of another text's suffix that has that window too, or -1.

    With `within`, a repeat inside the same text counts as well (its index is the suffix's own).
    Where the order goes on before or after these suffixes, the second value has
    the windows of the runs at that edge: (window's hash, lowest and highest
    index by text, number of suffixes, words to the left or -1).  A window that
    is settled here is one such row, of any other each suffix is one.
    """
    n = len(name)
    partner = np.full((n, SIDE + 1), -1)
    open_: list[tuple[np.ndarray, ...]] = []
    differ = right[1:] != right[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), SIDE)
    lcp = np.minimum(lcp, np.minimum(n_right[1:], n_right[:-1]))
    lcp[name[1:] != name[:-1]] = -1
    before, by_text = running(left), np.argsort(t, kind="stable")
    for o in range(SIDE + 1):
        need = SIDE - o
        run = np.concatenate([[0], np.cumsum(lcp < need)])
        able = by_text[((n_left >= o) & (n_right >= need))[by_text]]
        if not len(able):
            continue
        group = mix(run[able].astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + before[able, o])
        order = np.argsort(group, kind="stable")
        g, who = group[order], able[order]  # a group's suffixes stand in the order of their texts
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(begin, len(g)))
        first, last = who[begin], who[begin + size - 1]
        low, high = np.repeat(first, size), np.repeat(last, size)
        partner[who, o] = np.where(t[low] != t[high], np.where(t[who] == t[low], high, low), np.where(within & (np.repeat(size, size) > 1), who, -1))
        goes_on = (before_open & (run[first] == run[0])) | (after_open & (run[first] == run[-1]))
        settled = np.flatnonzero(goes_on & (partner[first, o] >= 0))
        alone = who[np.repeat(goes_on, size) & (partner[who, o] < 0)]
        for a, b, k, at in ((first[settled], last[settled], size[settled], -1), (alone, alone, np.ones(len(alone), np.int64), o)):
            if len(a):
                after = running(right[a], need)[:, need]
                w = mix(name[a].view(np.uint64) + mix(before[a, o] + np.uint64(o)) * np.uint64(3) + mix(after))
                open_.append((w.view(np.int64), a, b, k, np.full(len(a), at)))
    return partner, open_


def found(t: np.ndarray, one: pa.Array, pos: np.ndarray, partner: np.ndarray, open_: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows of COMPARED: windows that start at words lo to hi and that the document `other` holds too (w is null), then the windows that may go on."""
    held, n = partner >= 0, partner.shape[1]
    same = (partner[:, 1:] == partner[:, :-1]) & held[:, 1:]
    edge = np.zeros((len(partner), 1), bool)
    row, low = np.nonzero(held & ~np.concatenate([edge, same], axis=1))
    _, high = np.nonzero(held & ~np.concatenate([same, edge], axis=1))
    w, a, b, k, o = (np.concatenate(x) for x in zip(*open_)) if open_ else [np.zeros(0, np.int64)] * 5
    lo, hi = np.concatenate([pos[row] - high, pos[a] - o]), np.concatenate([pos[row] - low, pos[a] - o])
    in_run = np.arange(len(lo)) < len(row)
    who, other = np.concatenate([row, a]), np.concatenate([partner[row, low], b])
    of = lambda x, absent: pa.array(x, mask=absent)
    settled = np.concatenate([np.zeros(len(row), bool), o < 0])
    return pa.RecordBatch.from_arrays(
        [
            of(np.concatenate([np.zeros(len(row), np.int64), w]), in_run),
            pa.array(t[who]), one.take(pa.array(who)), pa.array(t[other]), one.take(pa.array(other)),
            of(np.concatenate([np.ones(len(row), np.int64), k]), in_run), of(lo.astype(np.int64), settled), of(hi.astype(np.int64), settled),
        ],
        names=["w", "t", "one", "other_t", "other", "n", "lo", "hi"],
    )


def compared(within: bool):
    """For partitions that are ranges of the order by name and what follows, read CHUNK suffixes at a time."""

    def of(b: pa.RecordBatch, before_open: bool, after_open: bool) -> pa.RecordBatch:
        name, t, pos, n_left, n_right = numbers(b, "name", "t", "pos", "n_left", "n_right")
        return found(t, column(b, "one"), pos, *windows_of(name, t, n_left, n_right, sides(b, "left"), sides(b, "right"), within, before_open, after_open))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        goes_on = True  # the first name may have begun in the range before
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            if rest.num_rows < CHUNK:
                continue
            (name,) = numbers(rest, "name")
            if cut := int(np.searchsorted(name, name[-1])):
                yield of(rest.slice(0, cut), goes_on, False)
                rest, goes_on = rest.slice(cut), False
            if rest.num_rows >= CHUNK:
                yield of(rest, goes_on, True)
                rest, goes_on = None, True
        if rest is not None and rest.num_rows:
            yield of(rest, goes_on, True)

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, ranges of window starts) to (t, spans), the maximal spans of words (start, end) in order, each with the documents that hold some of its windows too."""
    for batch in batches:
        out = []
        for ranges in batch.column(1).to_pylist():
            spans: list[tuple[list[int], set[str]]] = []
            for r in ranges:
                if spans and r["lo"] <= spans[-1][0][1]:
                    spans[-1][0][1] = max(spans[-1][0][1], r["hi"] + LEAST)
                else:
                    spans.append(([r["lo"], r["hi"] + LEAST], set()))
                spans[-1][1].add(r["other"])
            out.append([{"start": a, "end": b, "others": sorted(others)} for (a, b), others in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPANS_ARROW)], names=["t", "spans"])


SPANS = "array<struct<start: bigint, end: bigint, others: array<string>>>"
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("others", pa.list_(pa.string()))]))
COMPARED = "w long, t long, one string, other_t long, other string, n long, lo long, hi long"
CONTEXT = "name long, t long, one string, pos int, n_left int, n_right int, left binary, right binary"


def repeats(docs: DataFrame, id_col: str = "doc_id", within: bool = False) -> DataFrame:
    """(id, n_words, spans): the documents with passages of LEAST words or more that stand in another document too.

    Words are runs without white space, compared as they are; spans are maximal
    runs of words (start, end exclusive) that lie in windows of LEAST words
    which another document holds.  `others` of a span are ids (as text) of
    documents, one at least for every window, that hold windows of it.  With
    `within`, passages that repeat inside one document only are found as well;
    its own id is among the others then.  Documents of one id count as one, and
    a null id as an id.  Null and shorter texts have no spans; extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = text_of()
    table = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.md5(text).alias("digest"), F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long").alias("n_words"))
    table = materialize(table.filter(F.col("n_words") >= LEAST), "texts")
    ident = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    # Copies of whole texts; one of them stands for the text from here on.
    copies = materialize(table.groupBy("t", "digest").agg(F.min(ident).alias("one"), F.max(ident).alias("other"), F.max("n_words").alias("words")), "copies")
    keyed = docs.select(F.xxhash64(text).alias("t"), text.alias("text"))
    suffixes = materialize(keyed.mapInArrow(names, "name long, t long, pos int"), "suffixes")
    if within:  # a copy's suffixes are the text's own
        suffixes = suffixes.distinct()
    shared = suffixes.groupBy("name").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n"))
    shared = materialize(shared.filter("n > 1" if within else "a <> b").select("name"), "shared")
    places = suffixes.join(shared, "name").groupBy("t").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    one = copies.groupBy(F.col("t").alias("ct")).agg(F.min("one").alias("one"))
    places = places.join(one, places["t"] == one["ct"]).select(F.col("t").alias("pt"), "one", "at")
    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.xxhash64(text).alias("t"), text.alias("text"))
    chosen = named.join(places, (named["t"] == places["pt"]) & (named["name"] == places["one"])).select("t", "one", "text", "at")
    if within:  # repeated rows of one id and text would be read as repeats
        chosen = chosen.dropDuplicates(["t"])
    beside = materialize(chosen.mapInArrow(contexts, CONTEXT), "contexts")
    order = ("name", "right", "t", "pos")
    windows = beside.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(compared(within), COMPARED)
    windows = materialize(windows, "windows")
    ends = [F.min(F.struct("t", "one")).alias("a"), F.max(F.struct(F.col("other_t").alias("t"), F.col("other").alias("one"))).alias("b"), F.sum("n").alias("k")]
    several = windows.filter("w is not null").groupBy("w").agg(*ends)
    several = materialize(several.filter("k > 1" if within else "a.t <> b.t").select("w", "a", "b"), "several")
    partner = F.when(F.col("t") == F.col("a.t"), F.col("b.one")).otherwise(F.col("a.one"))
    alone = windows.filter("w is not null and lo is not null").select("w", "t", "lo", "hi")
    ranges = windows.filter("w is null").select("t", "lo", "hi", "other").unionByName(alone.join(several, "w").select("t", "lo", "hi", partner.alias("other")))
    spans = ranges.groupBy("t").agg(F.sort_array(F.collect_set(F.struct("lo", "hi", "other"))).alias("r")).mapInArrow(merged, f"t long, spans {SPANS}")
    result = copies.join(spans, "t", "left").filter("one <> other or spans is not null").select("t", "digest", "one", "other", "words", "spans")
    own = table.withColumn("ident", ident).join(result, ["t", "digest"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("words").alias("end"), F.array(F.when(F.col("ident") == F.col("one"), F.col("other")).otherwise(F.col("one"))).alias("others")))
    return own.select(F.col("id").alias(id_col), "n_words", F.when(F.col("one") != F.col("other"), whole).otherwise(F.col("spans")).alias("spans"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("repeated_words"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["others"])))), ",").alias("others"),
    )
