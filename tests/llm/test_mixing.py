import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from headway.llm import mixing as M


def plain_targets(words):
    """The contract's rule over exact fractions: reshare until no source is above its ceiling."""
    from fractions import Fraction

    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    total, fixed = Fraction(3, 2) * sum(words.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * words[s]]
        if not over:
            return {s: float(v) for s, v in (fixed | share).items()}
        fixed |= {s: Fraction(2 * words[s]) for s in over}


def test_targets(spark):
    rng = np.random.default_rng(6)
    cases = [{}, {None: 0}, {"a": 0, "b": 0}, {"é": 900, "𝒳": 3, "\uffee": 40, "a": 10, None: 500}]
    cases += [{f"s{k}": int(10 ** rng.uniform(0, 4)) for k in range(n)} for n in (2, 5, 9)]
    for words in cases:
        rows = spark.createDataFrame(list(words.items()), "source string, words long")
        got = {r["source"]: r["target"] for r in M.targets(rows).collect()}
        assert got == pytest.approx(plain_targets(words)), words


def test_many_sources(spark):
    """More sources than a driver's list should hold; all of them are full or share one level."""
    rows = spark.range(30_000).selectExpr("concat('s', lpad(id, 6, '0')) source", "1 + id * 7919 % 1000 words")
    out = M.targets(rows).toPandas()
    assert len(out) == 30_000 and out["target"].sum() == pytest.approx(1.5 * out["words"].sum()) and (out["target"] <= 2 * out["words"] + 1e-6).all()
    weight = np.array(M.WEIGHTS, float)[out["source"].str[1:].astype(int) % 3]
    level = (out["target"] / weight)[out["target"] < 2 * out["words"] - 1e-6]
    assert level.max() - level.min() < 1e-6


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_fit_is_the_best_subset_sum(items, budget):
    lengths, counts = (np.array(x) for x in zip(*items))
    take = M.fit(lengths, counts, budget)
    assert ((take >= 0) & (take <= counts)).all()
    total = int((lengths * counts).sum())
    floor = [int(c) * min(budget, total) // total for c in counts]
    best = max(s for t in itertools.product(*[range(f, c + 1) for f, c in zip(floor, counts)]) if (s := int((lengths * t).sum())) <= budget)
    assert int((lengths * take).sum()) == best


def test_fit_of_large_budgets_is_close():
    rng = np.random.default_rng(2)
    lengths = np.arange(1, 3000)
    counts = rng.integers(1, 400, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    take = M.fit(lengths, counts, budget)
    assert (take <= counts).all() and budget - int((lengths * take).sum()) == 0
    assert (M.fit(np.array([1 << 20]), np.array([3]), (1 << 21) + 5) == [2]).all()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = [(i, " ".join(["w"] * int(rng.integers(1, 40))), "abcd"[min(3, int(rng.integers(0, 12)))]) for i in range(900)]
    out += [(1000 + i, "one copy of it", "a") for i in range(700)] + [(2000, None, "a"), (2001, "", "b"), (2002, "\x0b x\t\ny ", None), (None, "no id", "b"), (5, "again", "a"), (5, "again", "a")]
    return out


def test_mix(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, size int").repartition(5)
    monkeypatch.setattr(M, "BUCKET_ROWS", 64)
    got = M.mix_sources(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, M.mix_sources(docs.repartition(3)).collect()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + size(t)
    goal = plain_targets(words)
    taken = dict.fromkeys(words, 0)
    assert len(got) == len(rows) and {r["size"] for r in got if r["doc_id"] == 2002} == {2}
    for r in got:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == words[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in words if words[s] > 50)


def test_fit_keeps_little_of_a_budget_out_of_reach():
    """Only even lengths for an odd budget: every part is tried, and one number for each sum is kept."""
    lengths, counts = np.arange(2, 12_000, 2), np.full(5999, 9)
    budget = int((lengths * counts).sum() * 0.5) | 1
    take = M.fit(lengths, counts, budget)
    assert budget - int((lengths * take).sum()) == 1 and (take <= counts).all()


def test_repeated_rows_share_what_is_taken(spark):
    """Rows of one id and text: their copies add up to what the plan takes."""
    rows = [(1, "a b c", "x")] * 50 + [(1, "d e f", "x")] * 30 + [(None, "g h", "x")] * 20 + [(i, "w " * i, "yz"[i % 2]) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, out = M.mix_sources(docs).toPandas(), M.mixed(docs).toPandas()
    assert plan["copies"].sum() == out["copies"].sum() and (plan["copies"] * plan["size"]).sum() == (out["copies"] * out["size"]).sum() and out["copies"].max() <= 2


def test_mixed_rows_and_empty_table(spark, rows):
    docs = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, size int")
    out = M.mixed(docs)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies"] and out.filter("copies < 1").count() == 0
    assert M.mix_sources(docs.limit(0)).count() == 0 and M.mixed(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {r["copies"] * r["size"] for r in M.mix_sources(blank).collect()} == {0}
