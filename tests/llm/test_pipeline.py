"""Each stage against a plain version of what it decides, on its own input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from headway.llm.shared import materialize


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    good = ["river", "garden", "table", "window", "summer", "letter", "music", "paper", "stone", "apple", "cloud", "train"]
    bad = ["grobnak", "vilzort", "murgle"]
    say = lambda n: [good[i] for i in rng.integers(0, len(good), n)]
    items = [" ".join(f"term{rng.integers(0, 500)}" for _ in range(30)) for _ in range(4)]
    rows, labels = [], []
    for i in range(400):
        words = say(int(rng.integers(20, 60)))
        if i % 5 == 0:
            words[3:3] = [bad[j] for j in rng.integers(0, 3, 4)]
        if i % 17 == 1:
            words[5:5] = items[i % 4].split()
        if i % 13 == 2:
            words += [f"user{i}@mail{i % 5}.example.com"]
        rows.append((i, " ".join(words), "en", f"s{i % 3}" if i % 50 else None, 0))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(500, rows[1][1], "en", "s1", 0), (501, rows[3][1], "en", "s2", 0), (501, rows[3][1], "en", "s2", 0), (502, None, None, None, None), (503, "", "en", "s0", 0), (None, "no id but text", "en", "s0", 1)]
    rows.append((504, " ".join(f"long{k}" for k in range(130_000)), "en", "s1", 0))  # over 1 MB
    base = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages_in_order(spark, place):
    docs, cols = spark.read.parquet(f"{place}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    items = [r["text"] for r in spark.read.parquet(f"{place}/benchmark.parquet").collect()]
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "decontamination", "pii", "mixing"]
    before = [tuple(r) for r in docs.collect()]
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, place), "test")
        after = [tuple(r)[:5] for r in docs.select(cols).collect()]
        ids = [r[0] for r in after]
        if name != "mixing":
            assert docs.columns == cols
        if name == "toxicity":
            gone = {r[0] for r in before} - set(ids)
            assert gone == {i for i in range(400) if i % 5 == 0}
        if name == "near_copies":
            assert ids.count(501) == 0 and 500 not in ids and {1, 3} <= set(ids)
            assert len(set(r[1] for r in after)) == len([r for r in after])
        if name == "decontamination":
            leaks = {r[0] for r in before if any(t in (r[1] or "") for t in items)}
            assert leaks and set(ids) == {r[0] for r in before} - leaks
        if name == "pii":
            old = {r[0]: r[1] for r in before}
            for r in after:
                want = re.sub(r"\S+@\S+", "[EMAIL]", old[r[0]]) if old[r[0]] else old[r[0]]
                assert r[1] == want and r[4] == len(r[1] or "")
        if name == "mixing":
            assert set(after) <= set(before) and all(r["copies"] in (1, 2) for r in docs.collect())
        before = after


def test_run_equals_the_stages_and_reruns_agree(spark, place):
    a, b = (sorted(map(str, cp.run(spark, place).collect())) for _ in range(2))
    assert a == b and a


def test_clashing_columns_and_copies(spark, place):
    """Extra columns named as the operators' own come through every stage but the last unchanged."""
    extra = ["id", "h", "fp", "component", "label", "score", "overlaps", "spans", "n", "_id", "draw", "bucket", "size"]
    docs = spark.read.parquet(f"{place}/documents.parquet")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in extra])
    for name, stage in cp.STAGES:
        out = stage(spark, docs, place)
        if name != "mixing":
            assert out.columns == docs.columns
        kept = [c for c in extra if name != "mixing" or c != "size"]
        assert out.select(*[F.col(c) == f"own {c}" for c in kept]).distinct().collect() == [(True,) * len(kept)]


def test_empty_documents(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, place), "test")
    assert docs.count() == 0
