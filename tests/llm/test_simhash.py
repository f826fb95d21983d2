import re

import numpy as np
import pytest
import xxhash

from headway.llm import simhash as S


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """Least id by components of brute-force links."""
    least = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 2 and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["Ab", "c", "DE", "f", "éü", "x1", "zz"]
    texts = ["", None, "  ", "one", "One  Two", "one\ttwo\n", "a  b\tc d", "a b c d", "Ä b c"]
    for _ in range(60):
        base = [words[i] for i in rng.integers(0, len(words), rng.integers(1, 60))]
        texts.append(" ".join(base))
        if rng.random() < 0.5:
            base[rng.integers(0, len(base))] = "changed"
            texts.append("\n".join(base))
    texts += [texts[-1], "word " * 3000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r["doc_id"]: r for r in S.simhash_dedup(docs).collect()}
    fps = {i: plain(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == fps
    assert {i: r["component"] for i, r in got.items()} == classes(fps)


@pytest.mark.parametrize("split", [1, 4096])
def test_links_of_close_values(spark, monkeypatch, split):
    """Crowded shards, keyed once and twice, join what all pairs join."""
    monkeypatch.setattr(S, "SPLIT", split)
    rng = np.random.default_rng(3)
    values = {0, 1, 3, 7, (1 << 63) | 5}
    for c in rng.integers(0, 1 << 62, 6).tolist():
        for _ in range(15):
            flips = rng.integers(0, 64, rng.integers(0, 5))
            values.add(int(np.bitwise_xor.reduce([c, *[1 << int(f) for f in flips]])))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    label = {r["v"]: r["label"] for r in S.components(S.links(frame)).collect()}
    want = classes({v: v & (1 << 64) - 1 for v in signed})
    assert {v: label.get(v, v) for v in signed} == want


def test_null_ids(spark):
    """Null ids are linked like others, and are the least id of a component without another only."""
    rows = [(None, "a b c d"), (5, "a b c d"), (4, "A b\tc d"), (None, "quite another text here"), (None, ""), (9, None)]
    got = S.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component"])) for r in got) == [("4", "4"), ("5", "4"), ("9", "9"), ("None", "4"), ("None", "9"), ("None", "None")]


def test_empty_table(spark):
    assert S.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 10, 300).astype(np.uint64))
    got = {(min(a, b), max(a, b)) for a, near in S.BKTree(values).links(2) for b in near.tolist() if a != b}
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if np.bitwise_count(values[a] ^ values[b]) <= 2}
    assert got == want
