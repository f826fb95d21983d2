"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length (words) for each source.  A source's
target is reached in three steps: every document is taken floor(target / size)
times; of what remains, the same share of every length is taken, rounded
down; the small budget left then is filled from the unused documents by a
bounded-knapsack dynamic program over length counts.  The plan is a table of
(source, length, count).  Documents are then chosen by a seeded hash, so a
rerun chooses the same ones.

Only length counts meet in one task.  Choosing `count` of the documents of one
length ranks seeded hash buckets first and documents only inside the bucket
that the count cuts, so that one very common length is dealt over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE, materialize, read, text_of

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
SEED = 17
#: Words that the dynamic program fits exactly; before it, whole documents of the longest lengths fill what exceeds this.
FIT_WORDS = 1 << 16
#: Documents of one source and length in a hash bucket, on average.
BUCKET_ROWS = 512


def words_in(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text; null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, words) to (source, words, target): share of all words by weight, none above ceiling times its own words, the excess reshared by weight among the others.

    Weights follow the sources' order by code point, null last.  Each round
    closes the sources that are full; only sums reach the driver, so any number
    of sources will do.
    """
    # A source's number is its place in its range of sources and the number of sources in the ranges before.
    order = [F.col("source").isNull(), F.col("source")]
    ranged = materialize(totals.repartitionByRange(*order).select("source", "words", F.spark_partition_id().alias("p")), "ranges")
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("p").orderBy(*order)) - 1 + F.col("before")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int"))
    open_ = materialize(ranged.join(before, "p").select("source", "words", weight.alias("weight")), "sources")
    left, done = share * float(open_.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]), []
    while True:
        each = left / (open_.agg(F.sum("weight")).first()[0] or 1.0)
        full = open_.filter(F.col("weight") * each > ceiling * F.col("words"))
        used = full.agg(F.sum(ceiling * F.col("words"))).first()[0]
        if used is None:
            out = open_.withColumn("target", F.col("weight") * each)
            break
        done.append(full.withColumn("target", ceiling * F.col("words")))
        left -= used
        open_ = open_.filter(F.col("weight") * each <= ceiling * F.col("words"))
    for part in done:
        out = out.unionByName(part)
    return out.select("source", "words", "target")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to budget as can be, never above it."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.astype(np.int64)
    # exact integer floor of counts * budget / total without overflow
    take[:] = [int(c) * budget // total for c in counts]
    left, spare = budget - sum(int(a) * int(b) for a, b in zip(lengths, take)), counts - take
    for i in np.argsort(-lengths, kind="stable"):
        if left <= FIT_WORDS:
            break
        if lengths[i] > 0:
            n = int(min(spare[i], (left - FIT_WORDS + lengths[i] - 1) // lengths[i], left // lengths[i]))
            take[i] += n
            spare[i] -= n
            left -= n * int(lengths[i])
    if left > FIT_WORDS:  # every document that would fit is taken
        return take
    # Bounded knapsack: bit s of `reach` says that s words can be made; a length with n spare documents enters as parts of 1, 2, 4, ... documents.
    # `by` keeps for each sum the part that first made it, which only needs earlier parts beside it.
    reach, mask, parts, by = 1, (1 << (left + 1)) - 1, [], np.full(left + 1, -1)
    for i in range(len(lengths)):
        size, n = int(lengths[i]), int(spare[i])
        if size <= 0 or size > left:
            continue
        n, part = min(n, left // size), 1
        while n > 0 and not reach >> left & 1:
            part = min(part, n)
            new = reach << (size * part) & mask & ~reach
            by[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little"))] = len(parts)
            parts.append((i, part))
            reach |= new
            n -= part
            part *= 2
    at = reach.bit_length() - 1
    while at > 0:
        i, part = parts[by[at]]
        take[i] += part
        at -= int(lengths[i]) * part
    return take


def plan_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies of every document and further ones by length, for one source's length counts."""
    rows = rows.sort_values("size", kind="stable").reset_index(drop=True)
    target, words = float(rows["target"].iloc[0]), int((rows["size"] * rows["n"]).sum())
    copies = int(target // words) if words else 0
    copies = min(copies, int(CEILING))
    budget = 0 if not words or copies >= CEILING else int(round(target - copies * words))
    extra = fit(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), budget) if budget > 0 else np.zeros(len(rows), np.int64)
    return pd.DataFrame({"source": rows["source"], "size": rows["size"], "n": rows["n"], "copies": np.int64(copies), "extra": extra, "source_size": np.int64(words), "target": target})


PLAN_SCHEMA = "source string, size long, n long, copies long, extra long, source_size long, target double"


def mix_sources(docs: DataFrame, id_col: str = "doc_id", weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """(id, h, source, size, source_size, target, copies): how often the mix takes each document (0, 1 or 2); h is XXH64 of the text.

    Null text: size 0, taken as often as its source's documents at least.  Null
    source: a source of its own, the last.  Equal rows are told apart by their
    order in the seeded hash, then by a random-free tie of equal rows: equal
    (id, text) rows hash alike and are ranked in any order, which changes no
    total.  Empty input gives an empty result.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col("source").cast("string").alias("source"),
            words_in(F.col("text")).alias("size"),
            F.xxhash64(text_of()).alias("h"),
            F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("draw"),
        ),
        "sized",
    )
    counts = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    goals = targets(totals, weights, share, ceiling).select(F.col("source").alias("goal_source"), "target")
    plan = (
        counts.join(goals, F.col("source").eqNullSafe(F.col("goal_source")))
        .select("source", "size", "n", "target")
        .groupBy("source")
        .applyInPandas(plan_source, PLAN_SCHEMA)
    )
    plan = materialize(plan.withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS)), "plan")
    keyed = sized.alias("s").join(
        plan.withColumnsRenamed({"source": "plan_source", "size": "plan_size"}),
        F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("size") == F.col("plan_size")),
    )
    keyed = keyed.withColumn("bucket", F.pmod(F.col("draw"), F.col("buckets"))).drop("plan_source", "plan_size", "buckets")
    # A length's buckets are filled one after another; the one in which the count ends is ranked.
    filled = keyed.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"), F.first("n").alias("of"))
    before = (
        filled.filter("in_bucket < of")
        .withColumn("before", F.sum("in_bucket").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), F.coalesce("before", F.lit(0)).alias("before"))
    )
    many = keyed.filter(f"n > {BUCKET_ROWS} and extra > 0 and extra < n").join(
        before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket")), "left"
    ).withColumn("before", F.coalesce("before", F.lit(0))).drop("b_source", "b_size", "b_bucket")
    few = keyed.filter(f"n <= {BUCKET_ROWS} and extra > 0 and extra < n").withColumn("before", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", "id"))
    ranked = few.unionByName(many).withColumn("more", ((F.col("before") + rank) <= F.col("extra")).cast("long"))
    alike = keyed.filter("extra = 0 or extra = n").withColumn("more", (F.col("extra") > 0).cast("long"))
    cols = [F.col("id").alias(id_col), "h", "source", "size", "source_size", "target", (F.col("copies") + F.col("more")).alias("copies")]
    return ranked.select(*cols).unionByName(alike.select(*cols))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that the mix takes, with `size`, `source_size`, `target` and `copies` (these names are replaced where docs has them).

    Rows of one id and text share what the mix takes of them: each gets its
    part, and the first ones one more where it does not divide.
    """
    new = ["size", "source_size", "target", "copies"]
    # Keys without nulls, so that the window below finds its rows where the join has dealt them.
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    origin = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    shared = mix_sources(docs, id_col, **how).groupBy(name.alias("_name"), F.col("h").alias("_h"), origin.alias("_from"), "size", "source_size", "target").agg(F.sum("copies").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
    shared = shared.filter("_taken > 0").withColumnsRenamed({c: f"_{c}" for c in new[:3]})
    keys = ["_name", "_h", "_from"]
    both = docs.withColumns({"_name": name, "_h": F.xxhash64(text_of(text_col)), "_from": origin}).join(shared, keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    both = both.withColumn("_copies", F.expr("_taken div _rows") + (rank <= F.expr("_taken % _rows")).cast("long")).filter("_copies > 0")
    return both.select(*[c for c in docs.columns if c not in new], *[F.col(f"_{c}").alias(c) for c in new])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
