import zlib

import numpy as np
import pytest

from headway.llm import quality as Q
from headway.llm.shared import Hasher


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(6)
    good = ["the", "river", "runs", "under", "old", "bridge", "while", "people", "walk", "home", "and", "talk"]
    rows = []
    for i in range(500):
        words = [good[j] for j in rng.integers(0, len(good), rng.integers(10, 60))]
        if i % 4 == 0:
            words = [w.upper() + "!!" if i % 8 else w + " |" for w in words]
        rows.append((i, " ".join(words) + ".", int(i % 4 != 0)))
    return rows


@pytest.fixture(scope="module")
def model(spark, corpus):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in corpus], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus] + [(None, 1), (3, None)], "doc_id long, quality int")
    return Q.fit(docs, labels)


def test_held_out_accuracy(spark, corpus, model):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    got = {r["doc_id"]: int(r["score"] >= Q.THRESHOLD) for r in Q.score(docs, model).collect()}
    held = [got[i] == y for i, _, y in corpus if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean(held) > 0.95


def test_edge_texts(spark, model):
    docs = spark.createDataFrame([(0, ""), (1, None), (2, " \n"), (3, "word " * 100_000), (4, "the old bridge")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, model).collect()}
    assert len(got) == 5 and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1]


def test_context_vectors_equal_a_plain_count(spark):
    texts = ["a b c a", "", "A b\nc 12!", None]
    vectors, count = Q.contexts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want, seen = np.zeros((Q.BUCKETS, Q.SIZE)), np.zeros(Q.BUCKETS)
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        b, _ = Q.buckets_of(Hasher(Q.PLAIN), data, np.array([0, len(data)]))
        for i in range(len(b)):
            seen[b[i]] += 1
            for j in range(max(0, i - 2), min(len(b), i + 3)):
                if i != j:
                    for k in range(Q.NONZERO):
                        want[b[i], Q.PLACES[b[j], k]] += Q.SIGNS[b[j], k]
    assert (vectors == want).all() and (count == seen).all() and seen.sum() == 9 + 1


def test_temperature_lowers_the_held_out_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + 1.5 * rng.normal(size=600) > 0).astype(float)
    net = Q.Network(x, y)
    fresh = rng.normal(size=(4000, 5))
    truth = (fresh[:, 0] + 1.5 * rng.normal(size=4000) > 0).astype(float)
    loss = lambda p: -np.log(np.where(truth == 1, p, 1 - p)).mean()
    plain = 1 / (1 + np.exp(-net.raw(fresh)))
    assert loss(np.clip(net(fresh), 1e-9, 1 - 1e-9)) <= loss(np.clip(plain, 1e-9, 1 - 1e-9)) + 0.01


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score(docs, Q.fit(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert Q.score(one, Q.fit(one, labels)).first()["score"] == 0.5
