import hashlib

import numpy as np

from headway.llm import syncmers as S


def plain_anchors(data: bytes):
    """(position, k-mer) of the closed syncmers by definition: the least inner s-mer's hash is at an edge."""
    kept = []
    for i in range(len(data) - S.K + 1):
        kmer = data[i : i + S.K]
        order = [int(S.mix(np.array([int.from_bytes(kmer[j : j + S.S], "little")], np.uint64))[0]) for j in range(S.K - S.S + 1)]
        if min(order) in (order[0], order[-1]):
            kept.append((i, kmer))
    return kept


def of(text):
    return S.anchors(np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8))


def test_anchors_are_the_closed_syncmers(monkeypatch):
    data = ("Lorem ipsum dolor sit amet ünd so weiter. " * 3 + "abc" * 30 + "x" * 40).encode()
    kmers = plain_anchors(data)
    h, at = of(data)
    one = {k: of(k)[0].tolist()[0] for _, k in kmers}
    assert at.tolist() == [i for i, _ in kmers] and h.tolist() == [one[k] for _, k in kmers]
    assert max(np.diff(at)) <= S.K - S.S + 1 <= 63
    back = S.from_text(S.as_text((h, at)))
    assert (back[0] == h).all() and (back[1] == at).all()
    monkeypatch.setattr(S, "PIECE", 7)
    assert of(data)[0].tolist() == h.tolist() and of(data)[1].tolist() == at.tolist()


def plain_likeness(a: str, b: str):
    """By the definition, with the longest common subsequence of numbered anchors."""
    number = lambda hs: [(x, hs[:k].count(x)) for k, x in enumerate(hs)]
    x, y = number(of(a)[0].tolist()), number(of(b)[0].tolist())
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
    return 2 * table[-1][-1] / (len(x) + len(y)) if x or y else 1.0


def test_order_counts():
    rng = np.random.default_rng(5)
    passages = [" ".join(f"w{k}" for k in rng.integers(0, 9000, 60)) + ". " for _ in range(20)]
    text, turned = "".join(passages), "".join(reversed(passages))
    assert S.likeness(of(text), of(text)) == 1 and S.likeness(of(text), of(turned)) < 0.15
    assert S.likeness(of(text), of("New words at the start. " + text)) > 0.98
    assert len(S.as_text(of(text))) < 0.5 * len(text)
    i, j = S.aligned(of(text), of("x" * 100 + text))
    assert (of("x" * 100 + text)[1][j] - of(text)[1][i] == 100).all()


def test_edits_and_next_documents(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "béta", "gamma𝒳", "delta", "x"]
    rows = [(-3, None), (0, ""), (1, "a"), (2, "éé"), (9, "𝒳" * 9), (12, "ab"), (1 << 60, "same " * 30), ((1 << 60) + 1, "same " * 30)]
    rows += [(20 + i, " ".join(words[j] for j in rng.integers(0, 5, rng.integers(1, 90)))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, b string").repartition(5)
    got = {r["doc_id"]: r for r in S.fingerprint_edits(docs).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        r, f = got[i], lambda x: S.as_text(of(x))
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f(t), f(edit))
        assert (r["near_edited"], r["near_next"]) == (plain_likeness(t, edit), plain_likeness(t, after))
    assert got[1 << 60]["near_next"] == 1.0


def test_repeated_ids_and_long_texts(spark):
    """One id with a third of all rows, null ids, repeated rows and a very long text."""
    import xxhash

    rng = np.random.default_rng(3)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 500, n))
    rows = [(7, say(int(rng.integers(1, 60)))) for _ in range(300)] + [(None, say(20)) for _ in range(100)] + [(i, say(int(rng.integers(0, 40)))) for i in range(100, 600)]
    rows += [(50, say(30_000)), (700, "same"), (700, "same"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    h = lambda t: int.from_bytes(xxhash.xxh64(t.encode(), 42).digest(), "big", signed=True)
    ordered = sorted((-(1 << 63) if i is None else i, h(t or ""), t or "") for i, t in rows)
    want = []
    for k, (i, _, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][2]
        edit = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), S.likeness(of(t), of(after))))
    got = S.fingerprint_edits(docs).collect()
    assert sorted((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"]) for r in got) == sorted(want)
    ranges = {}
    for r in S.with_next(docs).filter("halo = 0").select("b", "key", "text", S.F.spark_partition_id().alias("p")).collect():
        ranges.setdefault((r["b"], r["p"]), []).append(r)
    assert len({p for _, p in ranges}) == len({b for b, _ in ranges}) == len(ranges)
    assert len({b for (b, _), rs in ranges.items() for r in rs if r["key"] == 7}) >= 2


def test_one_row_and_none(spark):
    one = S.fingerprint_edits(spark.createDataFrame([(None, "a text that follows itself")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(None, 1.0)]
    assert S.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_of_small_fingerprints():
    a = (np.array([1, 1, 2, 3], np.uint32), np.arange(4))
    none = (a[0][:0], a[1][:0])
    assert S.likeness(a, (np.array([1, 2, 9], np.uint32), np.arange(3))) == 4 / 7
    assert S.likeness(a, a) == 1 and S.likeness(a, none) == 0 and S.likeness(none, none) == 1
    assert S.likeness(a, (np.array([3, 2, 1, 1], np.uint32), np.arange(4))) == 4 / 8
