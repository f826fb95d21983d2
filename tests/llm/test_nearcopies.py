import re

import numpy as np
import pytest

import corpus_pipeline as cp
from headway.llm import nearcopies as N


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def classes(sets):
    """Least id by components of brute-force pairs."""
    least = list(range(len(sets)))
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(least[i], least[j])
            changed |= least[i] != low or least[j] != low
            least[i] = least[j] = low
    return least, near


@pytest.mark.parametrize("split", [2_000, 1 << 21])
def test_planted_copies_equal_brute_force(spark, monkeypatch, split):
    """Copies with 0 to 10 % of their words changed, a large group of them, and short texts."""
    monkeypatch.setattr(N, "SPLIT", split)
    rng = np.random.default_rng(8)
    say = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    texts = ["", None, " \n", "one", "ONE", "one two three four five six", "One two  three four five six", "one two three four five"]
    for k in range(40):
        base = say(int(rng.integers(30, 400)))
        texts.append(" ".join(base))
        for share in (0.0, 0.01, 0.02, 0.03, 0.05, 0.1):
            copy = list(base)
            for at in rng.choice(len(base), int(round(share * len(base))), replace=False):
                copy[at] = "changed"
            texts.append("\t".join(copy))
    base = say(300)
    for k in range(60):
        copy = list(base)
        start = int(rng.integers(0, 280))
        copy[start : start + 12 + k % 8] = say(12 + k % 8)
        texts.append(" ".join(copy))
    sets = [plain(t) for t in texts]
    least, near = classes(sets)
    assert sum(sets[i] != sets[j] for i, j in near) > 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = N.near_copies(docs)
    assert {r["doc_id"]: r["component"] for r in groups.collect()} == dict(enumerate(least))
    assert {r["doc_id"] for r in cp.drop_near_copies(spark, docs, "").collect()} == {i for i, c in enumerate(least) if i == c}


def test_group_links_join_what_all_pairs_join():
    """Random sets around two centres, in one group: whole, and with some of them as pivots."""
    rng = np.random.default_rng(4)
    for case in range(30):
        centres = [rng.choice(500, 40, replace=False) for _ in range(2)]
        sets = []
        for k in range(25):
            c = set(centres[k % 2].tolist())
            for x in rng.choice(sorted(c), int(rng.integers(0, 9)), replace=False):
                c.remove(int(x)), c.add(int(rng.integers(1000, 9000)))
            sets.append(c)
        sets.append(sets[0] | {1})
        first = np.concatenate([[0], np.cumsum([len(c) for c in sets])])
        values = np.concatenate([np.sort(list(c)) for c in sets]).astype(np.uint64)
        pivots = np.ones(len(sets), bool) if case % 2 else rng.random(len(sets)) < 0.3
        similar = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
        want = [(i, j) for i in range(len(sets)) for j in range(i) if similar(i, j) and (pivots[i] or pivots[j])]
        got = N.group_links(values, first, np.arange(len(sets)), pivots)
        assert all(similar(i, j) for i, j in got) and len(got) < len(sets) and joined(len(sets), got) == joined(len(sets), want)


def joined(n, pairs):
    least = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    return least


def test_empty_table(spark):
    assert N.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash_joins_what_it_reaches_without_minhash(spark, monkeypatch):
    """With no band looked into, BK-trees over fingerprints within two bits join near copies; texts of one fingerprint that aren't similar stay apart."""
    groups_of = N.groups_of
    monkeypatch.setattr(N, "groups_of", lambda texts: groups_of(texts).filter("false"))
    rng = np.random.default_rng(3)
    texts = []
    for k in range(20):
        base = [f"w{i}" for i in rng.integers(0, 9000, 1500)]
        texts += [" ".join(base), " ".join([*base, "one", "more"]), " ".join([*base[:700], "changed", *base[701:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = N.signatures(docs, "doc_id").collect()
    fp = {r["id"]: r["fp"] & (2**64 - 1) for r in found}
    reached = [(i, j) for i in fp for j in range(i // 3 * 3, i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    assert len(reached) > 10
    got = {r["doc_id"]: r["component"] for r in N.near_copies(docs).collect()}
    assert got == dict(enumerate(joined(len(texts), reached)))
    sets = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4]), (3, [1, 2, 3, 9])], "name long, shingles array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 2)], "a long, b long")
    assert [tuple(r) for r in N.similar(pairs, sets).collect()] == [(1, 2)]
    texts = spark.createDataFrame([(n, 5, 7) for n in (1, 2, 3)], "name long, n long, fp long")
    assert sorted(map(tuple, N.simhash_pairs(texts).collect())) == [(2, 1), (3, 2)]
