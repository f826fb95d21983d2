import functools
import itertools
import re

import numpy as np

from headway.llm import decontaminate as D


@functools.cache
def toks(text):
    return re.findall(r"[\u3000-\u9fff\u0e00-\u0ebf]|(?:(?![\u3000-\u9fff\u0e00-\u0ebf])[a-z0-9\u0080-\U0010ffff])+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or ""))


def plain(doc, item):
    """Whether some window of the item stands in the document with at most the allowed changes."""
    d, b = toks(doc), toks(item)
    if not b:
        return False
    n, allowed = D.allowed(len(b))
    # a window with so many changes keeps one of its allowed + 1 parts
    size = n // (allowed + 1)
    parts = {tuple(b[j : j + size]) for j in range(len(b) - size + 1)}
    starts = {i - k for i in range(len(d) - size + 1) if tuple(d[i : i + size]) in parts for k in range(n - size + 1)}
    return any(sum(x != y for x, y in zip(d[i : i + n], b[j : j + n])) <= allowed for i in starts if 0 <= i <= len(d) - n for j in range(len(b) - n + 1))


def test_masks_find_every_window():
    for changed in itertools.combinations(range(D.WINDOW), D.CHANGES):
        assert any(not {o + p for p in m} & set(changed) for m in D.MASKS for o in range(D.WINDOW - m[-1]))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "x-y", "it's"]
    say = lambda n: [vocab[i] for i in rng.integers(0, len(vocab), n)]
    items = [" ".join(say(n)) for n in (3, 5, 7, 9, 12, 13, 20, 35, 50)] + ["", None]
    items.append(items[6])
    docs = []
    for k in range(120):
        words = say(int(rng.integers(0, 60)))
        if k % 2:
            part = (items[k // 2 % 9] or "").split()
            for c in rng.integers(0, len(part), int(rng.integers(0, 5))):
                part[c] = "changed"
            cut = int(rng.integers(0, 4))
            words[len(words) // 2 : len(words) // 2] = [w.upper() + "," for w in part[cut:]] if k % 3 else part[cut:]
        docs.append(" ".join(words))
    docs += [None, "", items[7] + "\n" + items[8], "pad " * 50_000 + items[7]]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    for limit in (D.BLOCK_TOKENS, 60):
        got = {r["doc_id"]: {int(i) for o in r["overlaps"] for i in o["item"].split()} for r in D.search(frame, bench, limit=limit).collect()}
        for i, d in enumerate(docs[:-1]):
            assert got[i] == {j for j, t in enumerate(items) if plain(d, t)}, i
        assert 7 in got[len(docs) - 1]


def test_short_and_unspaced_items(spark):
    """At and past the old limits: 4 and 5 tokens, 8 and 9 with a change, and sentences without spaces."""
    han = "今天我们在学校的图书馆里读了一本关于古代历史的新书然后回家"
    items = ["big red bus", "one two three four", "one two three four five", "a b c d e f g h", "a b c d e f g h i", "k l m n o p q r s t u v", han, "สวัสดีตอนเช้าวันนี้อากาศดีมาก"]
    texts = ["the BIG red bus", "so one two three four", "a b c X e f g h i", "a b c X e f g h j", "k l m n o p q r X t u v", "k l m n o X q r X t u v", "他说" + han[:12] + "很" + han[13:] + "。", "ก" + items[7] + "ข", "one two, three: four-five", "repeat", "repeat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for limit in (D.BLOCK_TOKENS, 1):
        got = {r["doc_id"]: {int(o["item"]) for o in r["overlaps"]} for r in D.search(docs, bench, limit=limit).collect()}
        want = {i: {j for j, b in enumerate(items) if plain(t, b)} for i, t in enumerate(texts)}
        assert got == want and want[0] == {0} and want[2] == {4} and want[4] == {5} and want[5] == set() and want[6] == {6} and want[7] == {7} and want[8] == {1, 2}
    kept = {r["doc_id"] for r in D.without_passages(docs, bench).collect()}
    assert kept == {i for i in range(len(texts)) if not any(len(toks(items[j])) >= D.LEAST_TOKENS for j in want[i])}


def test_one_operator_for_all_blocks(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"item number {i} of some words") for i in range(12)], "item_id long, text string")
    found = D.search(docs, bench, limit=10)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert len(D.Blocks(docs, bench, "item_id", 10, 1).shared) == 12 and found.first()["overlaps"] == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.search(docs, bench).first()["overlaps"] == []
    assert D.search(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_blocks_are_read_once_for_a_group(spark, monkeypatch):
    import pyarrow as pa

    bench = spark.createDataFrame([(i, f"item number {i} " * 6) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    reads, load = [], D.pickle.loads
    for limit, group_bytes, batches_of in ((60, D.GROUP_BYTES, 1), (60, 1, 5), (D.BLOCK_TOKENS, D.GROUP_BYTES, 5)):
        blocks = D.Blocks(docs, bench, "item_id", limit, 1)
        monkeypatch.setattr(D, "GROUP_BYTES", group_bytes)
        monkeypatch.setattr(D.pickle, "loads", lambda raw: reads.append(1) or load(raw))
        reads.clear()
        batches = [pa.RecordBatch.from_pydict({"text": [f"some item number {i} " + f"item number {i} " * 6]}) for i in range(5)]
        groups = list(blocks.grouped(iter(batches), 0))
        found = {(g, k, item) for g, group in enumerate(groups) for k, _, item, _ in blocks.overlaps(D.Hasher(), group, 0)}
        assert len(groups) == batches_of and {str(i) for i in range(5)} <= {item for _, _, item in found}
        assert len(reads) == (1 if limit > 60 else len(blocks.shared) * batches_of)
        monkeypatch.undo()


def test_repeated_rows_and_null_ids_stay(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, f"a {item} b"), (1, f"a {item} b"), (None, item), (None, None), (2, "clean"), (2, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None)], "item_id long, text string")
    found = sorted((r["doc_id"] or 0, len(r["overlaps"])) for r in D.search(docs, bench).collect())
    assert found == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 0)]
    assert sorted(r["doc_id"] or 0 for r in D.without_passages(docs, bench).collect()) == [0, 2, 2]


def test_executors_need_not_have_the_package(tmp_path):
    """Workers that can't import the package find the passages: only the driver's path has it."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from headway.llm import decontaminate as D\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "item = 'one two three four five six seven eight nine ten eleven twelve thirteen'\n"
        "docs = spark.createDataFrame([(1, item), (2, 'x')], 'doc_id long, text string')\n"
        "bench = spark.createDataFrame([(7, item), (8, 'a b c ' * 30)], 'item_id long, text string')\n"
        "print('FOUND', [[len(r['overlaps']) for r in D.search(docs, bench, limit=n).orderBy('doc_id').collect()] for n in (10**6, 20)])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "FOUND [[1, 0], [1, 0]]" in out.stdout, out.stderr[-2000:]
