import numpy as np
import pytest

from headway.llm import suffixes as S


def plain(rows, within=False):
    """Spans of words in windows of LEAST words that documents of another id hold, or that stand twice in one."""
    where = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - S.LEAST + 1):
            where.setdefault(tuple(w[k : k + S.LEAST]), set()).add((i, k) if within else i)
    out = []
    for i, t in rows:
        w, spans = (t or "").split(), []
        for k in range(len(w) - S.LEAST + 1):
            if len(where[tuple(w[k : k + S.LEAST])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + S.LEAST
                else:
                    spans.append([k, k + S.LEAST])
        if spans:
            out.append((str(i), tuple(map(tuple, spans))))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(3000)]
    say = lambda n, v=vocab: [v[i] for i in rng.integers(0, len(v), n)]
    passages = [say(n) for n in (49, 50, 51, 60, 80, 140, 400)]
    rows, base = [], say(300)
    for i in range(80):
        words = say(int(rng.integers(0, 200)))
        for _ in range(int(rng.integers(0, 3))):
            p, at = passages[rng.integers(0, len(passages))], int(rng.integers(0, len(words) + 1))
            cut = int(rng.integers(0, 12))
            words[at:at] = p[cut:] if rng.random() < 0.3 else p
        rows.append((i, "  ".join(words)))
    for i in range(15):  # near copies
        copy = list(base)
        for c in rng.integers(0, 300, i % 4):
            copy[c] = f"new{i}"
        rows.append((100 + i, " ".join(copy)))
    few = ["a", "b"]
    rows += [(200 + i, " ".join(say(120, few))) for i in range(3)] + [(210, "same " * 400), (211, "x " + "same " * 90), (212, "lone " * 300)]
    rows += [(300, " ".join(say(60))), (301, None), (302, ""), (303, " ".join(say(49)))]
    own = " ".join(say(70))
    rows += [(310, own + " middle " + own), (311, " ".join(say(30)))]
    rows += [(320, rows[100 - 5][1]), (321, rows[3][1]), (321, rows[3][1])]
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 20_000])
def test_equals_brute_force(spark, monkeypatch, rows, chunk):
    """Pieces of any size, a name over many of them too, give the same windows."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 2 if chunk < 10 else 10_000)
    try:
        equals_brute_force(spark, rows)
    finally:
        spark.conf.set(size, before)


def equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, t int").repartition(6)
    found = S.repeats(docs).collect()
    assert sorted((str(r["doc_id"]), tuple((s["start"], s["end"]) for s in r["spans"])) for r in found) == plain(rows)
    words = {str(i): (t or "").split() for i, t in rows}
    held = {i: {tuple(w[k : k + S.LEAST]) for k in range(len(w) - S.LEAST + 1)} for i, w in words.items()}
    for r in found:  # every repeated window of a span stands in one of its others, and each of them holds one
        own = words[str(r["doc_id"])]
        for s in r["spans"]:
            windows = [tuple(own[k : k + S.LEAST]) for k in range(s["start"], s["end"] - S.LEAST + 1)]
            assert str(r["doc_id"]) not in s["others"] and all(any(w in held[o] for w in windows) for o in s["others"])
            repeated = [w for w in windows if any(w in h for i, h in held.items() if i != str(r["doc_id"]))]
            assert repeated and all(any(w in held[o] for o in s["others"]) for w in repeated)
    both = sorted((str(r["doc_id"]), tuple((s["start"], s["end"]) for s in r["spans"])) for r in S.repeats(docs, within=True).collect())
    assert sorted(set(both)) == sorted(set(plain(rows, within=True))) and len(both) == len(plain(rows, within=True))


def test_a_text_over_a_step(spark):
    """Two texts of over 1 MB with one passage in common, at their ends."""
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"word{k}" for k in rng.integers(0, 1 << 40, n))
    passage = say(70)
    rows = [(1, say(90_000) + " " + passage), (2, passage + " " + say(90_000)), (3, say(100))]
    assert min(len(t) for _, t in rows[:2]) > 1 << 20
    got = S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], [(s["start"], s["end"], s["others"]) for s in r["spans"]]) for r in got) == [(1, [(90_000, 90_070, ["2"])]), (2, [(0, 70, ["1"])])]


def test_empty_table(spark):
    assert S.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
