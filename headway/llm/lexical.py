"""Ranked lexical search: accumulator-limited term-at-a-time over shards of an index.

The index has a row for each document: its number of terms, its distinct terms
as 64-bit hashes, and how often each occurs.  It knows no query and is written
once; the corpus' counts (documents, terms, documents that hold a term) are
aggregations of it.

A task turns its documents into shards of postings.  In a shard an item's terms
are taken one after another, the rarest of the corpus first.  A document that a
term meets for the first time gets an accumulator until the bounds of the terms
that are left (the most that each adds to any document of the shard) can't lift
a new document to the k-th best partial score; from then on only documents that
have an accumulator are updated, and their scores end exact.  Each shard gives
its k best documents for every item, of which the k best stay.

Items are the stated query set: they are taken in blocks of bounded size, one
block at a time on the driver, each of which passes over the index once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Hasher, materialize, read, spans_where, steps

#: Results for each item.
K = 10
#: Terms of all items in a block.
BLOCK_TERMS = 500_000
#: Postings and documents of a shard.
SHARD_POSTINGS = 2_000_000
SHARD_DOCS = 1 << 16
#: Shards of an item that are ranked together before the last ranking.
SALTS = 64

IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def counted(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, how often, first term of each row) of the distinct terms of n rows."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.concatenate([at, [len(h)]])), np.searchsorted(row[at], np.arange(n + 1))


def index(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """rows without their text, with `n` (terms), `terms` (distinct, as hashes) and `tfs` (how often each); columns of these names are replaced.

    A term is a longest run of ASCII letters, digits and characters over U+007F;
    only A-Z are lower-cased.  Null texts have none.
    """
    out = rows.drop("n", "terms", "tfs").selectExpr("*", "0L n", "cast(array() as array<bigint>) terms", "cast(array() as array<int>) tfs")
    place = out.columns.index(text_col)
    shape = out.drop(text_col).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for i, j, data, offsets in steps(batch.column(place)):
                starts, ends, first = spans_where(IS_TERM[data], offsets)
                row = np.repeat(np.arange(j - i), np.diff(first))
                terms, tfs, at = counted(row, hasher(data, starts, ends).view(np.int64), j - i)
                kinds = [batch.schema.field(c).type for c in ("n", "terms", "tfs")]
                at = pa.array(at, pa.int32())
                added = [pa.array(np.diff(first), kinds[0]), pa.ListArray.from_arrays(at, pa.array(terms)).cast(kinds[1]), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32())).cast(kinds[2])]
                kept = [c for k, c in enumerate(batch.slice(i, j - i).columns[:-3]) if k != place]
                yield pa.RecordBatch.from_arrays([*kept, *added], names=[x for x in batch.schema.names if x != text_col])

    return out.mapInArrow(run, shape)


class Items:
    """A block of items: their numbers and their terms, rarest first, with weights."""

    def __init__(self, numbers: list[int], terms: list[list[tuple[int, int]]]):
        self.numbers = np.array(numbers, np.int64)
        flat = np.array([t for of in terms for t, _ in of], np.int64)
        self.vocabulary, place = np.unique(flat, return_inverse=True)
        self.weights = np.zeros(len(self.vocabulary), np.int64)
        self.weights[place] = [w for of in terms for _, w in of]
        cuts = np.cumsum([0, *map(len, terms)])
        self.terms = [place[a:b] for a, b in zip(cuts, cuts[1:])]


def gain(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score, in whole numbers."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Postings of some documents for a block's vocabulary, by term, with what each adds and the most that any does."""

    def __init__(self, items: Items, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray):
        self.n = len(m)
        order = np.argsort(term, kind="stable")
        self.doc, term = doc[order], term[order]
        self.gain = gain(items.weights[term], tf[order], m[self.doc])
        self.first = np.searchsorted(term, np.arange(len(items.vocabulary) + 1))
        held = self.first[1:] > self.first[:-1]
        self.most = np.zeros(len(items.vocabulary), np.int64)
        self.most[held] = np.maximum.reduceat(self.gain, self.first[:-1][held]) if held.any() else 0
        self.created = 0

    def scores(self, terms: np.ndarray, k: int) -> np.ndarray:
        """Scores of the documents that got an accumulator, 0 for others; exact for all that may be among the k best."""
        terms = terms[self.most[terms] > 0]
        left = np.cumsum(self.most[terms][::-1])[::-1]
        total, limited = np.zeros(self.n, np.int64), False
        for i, t in enumerate(terms.tolist()):
            if i and not limited and self.n > k:
                limited = left[i] < np.partition(total, self.n - k)[self.n - k]
            at = slice(self.first[t], self.first[t + 1])
            doc, plus = self.doc[at], self.gain[at]
            if limited:
                has = total[doc] > 0
                doc, plus = doc[has], plus[has]
            total[doc] += plus
        self.created += int((total > 0).sum())
        return total

    def best(self, terms: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best over 0, equal scores by id, null ids last."""
        total = self.scores(terms, k)
        least = max(1, int(np.partition(total, self.n - k)[self.n - k])) if self.n > k else 1
        found = np.flatnonzero(total >= least)
        found = found[np.lexsort((ids[found], nulls[found], -total[found]))[:k]]
        return found, total[found]


def searched(entries: DataFrame, items: Items, n_docs: int, n_terms: int, id_col: str, k: int) -> DataFrame:
    """(number, id_col, score, salt): every shard's k best documents for each item."""
    shape = entries.selectExpr("0L number", f"`{id_col}`", "0L score", "0 salt").schema

    def shard_of(batches: list[pa.RecordBatch]) -> tuple[Shard, np.ndarray, np.ndarray, pa.Array]:
        docs, terms, tfs, at = [], [], [], 0
        for batch in batches:
            term = batch.column("terms")
            flat = term.flatten().to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(items.vocabulary, flat), max(0, len(items.vocabulary) - 1))
            hit = np.flatnonzero(items.vocabulary[place] == flat) if len(items.vocabulary) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(batch.num_rows), term.value_lengths().to_numpy(zero_copy_only=False))
            docs.append(row[hit] + at)
            terms.append(place[hit])
            tfs.append(batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[hit].astype(np.int64))
            at += batch.num_rows
        n = np.concatenate([b.column("n").to_numpy() for b in batches])
        ids = pa.chunked_array([b.column(id_col) for b in batches]).combine_chunks()
        m = 100 - 90 + (90 * n * n_docs) // max(1, n_terms)
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        return Shard(items, *map(np.concatenate, (docs, terms, tfs)), m), ids.fill_null(0).to_numpy(zero_copy_only=False), nulls, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for group in shards(batches):
            shard, ids, nulls, column = shard_of(group)
            for number, terms in zip(items.numbers, items.terms):
                found, score = shard.best(terms, ids, nulls, k)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), number)), column.take(pa.array(found)), pa.array(score), pa.array(np.full(len(found), salt, np.int32))], names=shape.names)
            salt = (salt + 1) % SALTS

    return entries.filter("n > 0").select(id_col, "n", "terms", "tfs").mapInArrow(run, shape)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of about SHARD_POSTINGS terms and at most SHARD_DOCS documents or one batch more."""
    group, size, docs = [], 0, 0
    for batch in batches:
        group.append(batch)
        size += len(batch.column("terms").flatten())
        docs += batch.num_rows
        if size >= SHARD_POSTINGS or docs >= SHARD_DOCS:
            yield group
            group, size, docs = [], 0, 0
    if group:
        yield group


def blocks(items: DataFrame, limit: int) -> Iterator[Items]:
    """The items (number, terms with weights) in blocks of at most `limit` terms, or one longer item."""
    numbers, terms, size = [], [], 0
    for r in items.toLocalIterator():
        if numbers and size + len(r["weighed"]) > limit:
            yield Items(numbers, terms)
            numbers, terms, size = [], [], 0
        numbers.append(r["number"])
        terms.append([(t["term"], t["w"]) for t in r["weighed"]])
        size += len(r["weighed"])
    if numbers:
        yield Items(numbers, terms)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", k: int = K, limit: int = BLOCK_TERMS) -> DataFrame:
    """(item_col, rank, id_col, score): each item's k best documents with a score over 0, equal scores by ascending id, null ids last.

    Every row of docs is a document and every row of queries an item, repeated
    ones too: rows of queries with one id give a ranking each.  Null texts have
    no terms; without documents or terms nothing is found.  Other columns play
    no part.
    """
    entries = materialize(index(docs.select(id_col, text_col), text_col), "index")
    asked = materialize(index(queries.select(item_col, F.monotonically_increasing_id().alias("number"), text_col), text_col), "items")
    n_docs, n_terms = entries.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = entries.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2.0 * F.col("df") + 1))).alias("w")
    weighed = asked.select("number", F.explode("terms").alias("term")).join(df, "term").select("number", F.struct("df", "term", weight).alias("t"))
    weighed = weighed.groupBy("number").agg(F.sort_array(F.collect_list("t")).alias("weighed"))
    found = [materialize(searched(entries, block, n_docs, n_terms, id_col, k), "found") for block in blocks(weighed, limit)]
    if not found:
        found = [searched(entries.limit(0), Items([], []), 0, 0, id_col, k)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last(id_col)]
    for keys in (("number", "salt"), ("number",)):
        every = every.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    named = asked.select("number", F.col(item_col).alias("_item"))
    return every.join(named, "number").select(F.col("_item").alias(item_col), "rank", id_col, "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, docs),
parts AS (SELECT item_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))) AS part
    FROM b JOIN tf USING (term) JOIN weights USING (term) JOIN size USING (doc_id), corpus),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts GROUP BY item_id, doc_id HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores
QUALIFY rank <= 10
"""
