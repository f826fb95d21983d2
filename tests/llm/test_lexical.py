import math
import re
from collections import Counter

import numpy as np
import pytest

from headway.llm import lexical
from headway.llm.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """[(item position, rank, doc id, score)] by the contract, every document scored for every item."""
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for place, (_, text) in enumerate(items):
        found = []
        for (i, _), c, n in zip(docs, counts, sizes):
            m = 100 - 90 + (90 * n * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in {*terms(text)} if c[t])
            if score > 0:
                found.append((i, score))
        found.sort(key=lambda f: (-f[1], f[0] is None, f[0] or 0))
        out += [(place, rank, i, s) for rank, (i, s) in enumerate(found[:k], 1)]
    return out


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "x-y", "don't", "NAÏVE", "日本", "a\x00b", "İ"]
    p = 1 / np.arange(1, len(words) + 1)
    say = lambda k: " ".join(words[i] for i in rng.choice(len(words), k, p=p / p.sum()))
    docs = [(i * 3 % n, say(int(rng.integers(0, 80)))) for i in range(n)]
    return docs + docs[:5] + [(None, docs[3][1]), (None, None), (9001, ""), (9002, "... --"), (9003, "w1 " * 300_000)], say


def named(rows, items):
    return sorted((str(items[p][0]), r, str(i), s) for p, r, i, s in rows)


@pytest.mark.parametrize("limit, postings", [(lexical.BLOCK_TERMS, lexical.SHARD_POSTINGS), (40, 500)])
def test_equals_brute_force(spark, monkeypatch, limit, postings):
    """One shard and block or many; ties, repeated rows, null ids and texts, a text over 1 MB, items that share terms, clashing names."""
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    docs, say = corpus(5, 400)
    items = [(i, say(int(n))) for i, n in enumerate([1, 2, 3, 5, 8, 13, 21, 34, 55])] + [(50, None), (51, "unheard"), (None, "w5 w6 w7 w8"), (52, docs[7][1]), (53, "w2 w2 W2")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, score string").repartition(3)
    asked = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, number string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    got = lexical.search(frame, asked, limit=limit).collect()
    assert sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in got) == named(plain(docs, items), items)


def test_repeated_items_give_a_ranking_each(spark):
    docs, say = corpus(6, 60)
    items = [(1, "w3 w4"), (1, "w3 w4"), (1, say(6))]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3).collect()
    assert sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in got) == named(plain(docs, items, 3), items)


def test_creation_stops_and_survivors_stay_exact():
    """A rare term decides; common ones make no accumulators of their own any more."""
    rng = np.random.default_rng(1)
    n = 5000
    items = lexical.Items([0], [[(1, 9000), (2, 8000), (3, 40), (4, 20)]])
    doc = np.concatenate([np.arange(0, 40), np.arange(20, 60), *[rng.choice(n, 3000, replace=False) for _ in range(2)]])
    term = np.searchsorted(items.vocabulary, np.repeat([1, 2, 3, 4], [40, 40, 3000, 3000]))
    tf, m = rng.integers(1, 5, len(doc)), rng.integers(50, 200, n)
    shard = lexical.Shard(items, doc, term, tf, m)
    found, score = shard.best(items.terms[0], np.arange(n), np.zeros(n, bool), 10)
    full = np.zeros(n, np.int64)
    np.add.at(full, doc, lexical.gain(items.weights[term], tf, m[doc]))
    want = np.lexsort((np.arange(n), -full))[:10]
    assert shard.created == 40 and found.tolist() == want.tolist() and score.tolist() == full[want].tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(none, asked).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), asked.limit(0)).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "...")], "doc_id long, text string"), asked).count() == 0


def test_query_and_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    docs, items = (con.execute(f"SELECT * EXCLUDE (text), text FROM {t}").fetchall() for t in ("documents", "benchmark"))
    docs, items = [(r[0], r[-1]) for r in docs], [(r[0], r[-1]) for r in items]
    got = sorted(map(tuple, QUERIES["op11_lexical"](spark, SF).collect()))
    assert got == sorted((items[p][0], r, i, s) for p, r, i, s in plain(docs, items)) == sorted(con.execute(ORACLE_SQL["op11_lexical"]).fetchall())
