"""Alignment of two tokenizers' tokens over the same bytes, and counts of aligned id pairs over the corpus.

Tokenizer A is byte-level BPE read from its JSON file (encoded by tiktoken with
the same vocabulary and merge order), B a SentencePiece model (encoded by its
library, whose ids `pieces` gives too, but more slowly).  All tokens of both are
sorted together by their start; a group of tokens breaks where a start reaches
the running maximum of the ends before it, so groups end where tokens of both
end.  Inside a group every A token is linked with every B token.

Documents are worked through in blocks of about 4 MB.  A block carries its
distinct id pairs and the number of its documents that hold each, and only these
are counted over the corpus and looked up again, not every document's links; a
pair that all documents hold comes once for each block.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import BYTE, MARK, MODEL, Model
from .shared import materialize, read, steps

BYTE_LEVEL = "byte_bpe_50k.json"
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Columns that `align` adds, and those that it works with.
ADDED = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}
OWN = ("_block", "_facts", "_at", "_times", "_pairs", "_held")
FACTS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
#: How a byte-level vocabulary cuts texts into words (a fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from U+0100 on."""
    prints = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    other = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level BPE vocabulary: the bytes of every id but the special ones.

    Raises ValueError for a file of another kind, or one whose merges are not in the order of the ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        before, model = found["pre_tokenizer"], found["model"]
        special = {t["content"] for t in found["added_tokens"] if t["special"]}
        letters = byte_letters()
        self.tokens: list[bytes] = [b""] * len(model["vocab"])
        for token, i in model["vocab"].items():
            if token not in special:
                self.tokens[i] = bytes(letters[c] for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rising = [model["vocab"][a + b] for a, b in merges]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or found["normalizer"] or rising != sorted(rising):
            raise ValueError(f"{path} is no byte-level BPE vocabulary in the order of its merges")

    def coder(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks={t: i for i, t in enumerate(self.tokens) if t}, special_tokens={})


def surfaces(model: Model) -> list[bytes]:
    """The bytes that a piece stands for."""
    return [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds)]


class Table:
    """Bytes of a vocabulary's tokens, to lay out a run of ids."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)]


def coalesced(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals by their start, and the number of each one's group in that order: a group breaks where a start reaches all ends before it."""
    order = np.lexsort((-ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def expanded(group: np.ndarray, a_side: np.ndarray, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair keys, times) of all links, keys being row << 34 | A id << 17 | B id in order.

    Within a group the distinct ids of either side meet once, with the product
    of their numbers, so a group of many equal tokens costs little.
    """
    sides = []
    for side in (a_side, ~a_side):
        key, times = np.unique((group[side] << 17) | ids[side], return_counts=True)
        sides.append((key >> 17, key & 0x1FFFF, times))
    (ga, a, na), (gb, b, nb) = sides
    low, high = np.searchsorted(gb, ga, "left"), np.searchsorted(gb, ga, "right")
    n = high - low
    at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    of = np.zeros(int(group[-1]) + 1 if len(group) else 0, np.int64)
    of[group] = row
    key = (of[np.repeat(ga, n)] << 34) | (np.repeat(a, n) << 17) | b[at]
    times = np.repeat(na, n) * nb[at]
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(times, new) if len(new) else times


class Aligner:
    """Both tokenizers; one for a task."""

    def __init__(self, a: ByteLevel, b: Model):
        self.a, self.b = a.coder(), b.library()
        self.tables = Table(a.tokens), Table(surfaces(b))
        self.size = max(len(a.tokens), len(b.pieces))
        self.said = [f"{sign}{i}" for sign in ",|;" for i in range(self.size)]

    def rows(self, texts: list[bytes]) -> Iterator[tuple[tuple[int, int, int, int, str], np.ndarray, np.ndarray]]:
        """((n_a, n_b, n_groups, n_links, groups_sha256), distinct pairs, times of each) for each text."""
        spaced = [b" " + t if t else b"" for t in texts]
        ids_a = [self.a.encode_to_numpy(t.decode(), disallowed_special=()).astype(np.int64) if t else np.zeros(0, np.int64) for t in spaced]
        ids_b = [np.array(ids, np.int64) for ids in self.b.encode([t.decode() for t in texts], num_threads=1)]
        for k, want in enumerate(spaced):
            same = all(len(got := table.spell(ids[k])) == len(want) and got.tobytes() == want for table, ids in zip(self.tables, (ids_a, ids_b)))
            if not same:
                ids_a[k] = ids_b[k] = np.zeros(0, np.int64)
        firsts = [np.concatenate([[0], np.cumsum([len(i) for i in ids])]) for ids in (ids_a, ids_b)]
        flats = [np.concatenate([*ids, np.zeros(0, np.int64)]) for ids in (ids_a, ids_b)]
        ends = [np.cumsum(table.size[flat]) for table, flat in zip(self.tables, flats)]
        starts = [e - table.size[flat] for e, table, flat in zip(ends, self.tables, flats)]
        order, group = coalesced(np.concatenate(starts), np.concatenate(ends))
        ids = np.concatenate(flats)[order]
        a_side = order < len(flats[0])
        row = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(f)) for f in firsts])[order]
        pairs, times = expanded(group, a_side, ids, row)
        # As text: a group's A ids, then its B ids.
        said = np.lexsort((~a_side, group))
        g, s = group[said], a_side[said]
        sign = np.zeros(len(said), np.int64)
        sign[1:] = np.where(g[1:] != g[:-1], 2, s[1:] != s[:-1])
        words = sign * self.size + ids[said]
        first = firsts[0] + firsts[1]
        cut = np.searchsorted(pairs, np.arange(len(texts) + 1) << 34)
        last = np.concatenate([[-1], group])
        n_groups = np.where(np.diff(first) > 0, last[first[1:]] - last[first[:-1]], 0)
        for k in range(len(texts)):
            low, high = cut[k], cut[k + 1]
            line = "".join(map(self.said.__getitem__, words[first[k] : first[k + 1]].tolist()))[1:]
            sha = hashlib.sha256(line.encode()).hexdigest() if line else ""
            yield (len(ids_a[k]), len(ids_b[k]), int(n_groups[k]), int(times[low:high].sum()), sha), pairs[low:high] & ((1 << 34) - 1), times[low:high]


def packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype("<i8" if len(numbers) and numbers.max() >= 1 << 31 else "<i4").tobytes(), 1)


def links(docs: DataFrame, a: ByteLevel, b: Model, text_col: str = "text") -> DataFrame:
    """docs with what `align` counts: _block, _facts of the row itself, _at (places of its pairs among the block's) and _times, packed, and in a block's first row _pairs and _held, the block's distinct pairs and the documents that hold each."""
    out = docs.selectExpr("*", "cast(0 as bigint) _block", "cast(null as struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>) _facts", "cast(null as binary) _at", "cast(null as binary) _times", "cast(null as array<bigint>) _pairs", "cast(null as array<int>) _held")
    place, n = out.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in range(n, batch.num_columns)]
            for i, j, data, at in steps(batch.column(place), BLOCK_BYTES):
                facts, found = [], []
                # About 1 MB of text at a time.
                for p, q, _, _ in steps(batch.column(place).slice(i, j - i)):
                    for fact, pairs, times in aligner.rows([data[x:y].tobytes() for x, y in zip(at[p:q], at[p + 1 : q + 1])]):
                        facts.append(fact)
                        found.append((pairs, times))
                every, where, held = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True, return_counts=True)
                cut = np.concatenate([[0], np.cumsum([len(p) for p, _ in found])])
                gaps = [np.diff(where[x:y], prepend=0) for x, y in zip(cut, cut[1:])]
                names = [f.name for f in kinds[1]]
                columns = [
                    pa.array(np.full(j - i, block), kinds[0]),
                    pa.array([dict(zip(names, f)) for f in facts], kinds[1]),
                    pa.array([packed(g) for g in gaps], kinds[2]),
                    pa.array([packed(t) for _, t in found], kinds[3]),
                    pa.array([every.tolist()] + [None] * (j - i - 1), kinds[4]),
                    pa.array([held.tolist()] + [None] * (j - i - 1), kinds[5]),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:n], *columns], names=batch.schema.names)
                block += 1

    return out.mapInArrow(run, out.schema)


def unpacked(raw: bytes, n: int | None = None) -> np.ndarray:
    data = zlib.decompress(raw)
    return np.frombuffer(data, "<i8" if n is not None and len(data) == 8 * n else "<i4").astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n_docs, best) over all blocks: how many documents hold the pair linked, and whether that is the most of its A id; an A id has no more rows than B has ids."""
    each = rows.filter("_pairs is not null").select(F.explode(F.arrays_zip("_pairs", "_held")).alias("p"))
    counts = each.groupBy(F.col("p._pairs").alias("pair")).agg(F.sum("p._held").alias("n_docs"))
    of_a = Window.partitionBy(F.shiftright("pair", 17))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_a))


def align(docs: DataFrame, a: ByteLevel, b: Model, text_col: str = "text") -> DataFrame:
    """docs without its text, with the columns ADDED.

    n_best and count_sum look at the pairs' counts of documents over all rows.
    A text that is null, empty, or not spelled by both tokenizers' tokens has no
    tokens: zeros and ''.  Repeated rows count as documents of their own, null
    ids too; columns of docs with the names ADDED are replaced, those of OWN go.
    """
    kept = docs.drop(*ADDED, *OWN)
    rows = materialize(links(kept, a, b, text_col).drop(text_col), "links")
    asked = rows.filter("_pairs is not null").select("_block", F.posexplode("_pairs").alias("place", "pair"))
    known = asked.join(pair_counts(rows), "pair").select(F.col("_block").alias("block"), "place", "n_docs", "best")
    rest = [c for c in kept.columns if c != text_col]
    shape = rows.select(*rest).schema
    for name, kind in ADDED.items():
        shape = shape.add(name, kind)

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        n = len(right)
        place = right.column("place").to_numpy()
        count, best = np.zeros(n, np.int64), np.zeros(n, bool)
        count[place] = right.column("n_docs").to_numpy()
        best[place] = right.column("best").to_numpy()
        n_best, count_sum = [], []
        for at, times in zip(left.column("_at").to_pylist(), left.column("_times").to_pylist()):
            at = np.cumsum(unpacked(at))
            times = unpacked(times, len(at))
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * count[at]).sum()))
        facts = {k: [f[k] for f in left.column("_facts").to_pylist()] for k in FACTS} | {"n_best": n_best, "count_sum": count_sum}
        out = left.select(rest)
        for name, kind in ADDED.items():
            out = out.append_column(name, pa.array(facts[name], pa.string() if kind == "string" else pa.int64()))
        return out

    held = rows.select(*rest, "_block", "_facts", "_at", "_times")
    return held.groupBy("_block").cogroup(known.groupBy("block")).applyInArrow(total, shape)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and corpus-wide pair counts of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, ByteLevel(public_tokenizers.path(BYTE_LEVEL)), Model(public_tokenizers.path(MODEL)))
