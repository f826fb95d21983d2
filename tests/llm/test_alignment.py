import functools
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_pieces import texts
from tokenizers import Tokenizer

from headway.llm import alignment, pieces
from headway.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@functools.cache
def libs():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_LEVEL))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


@pytest.fixture(scope="module")
def both():
    model = pieces.Model(public_tokenizers.path(pieces.MODEL))
    return alignment.ByteLevel(public_tokenizers.path(alignment.BYTE_LEVEL)), model, alignment.surfaces(model)


def spelled(tokens):
    """Ends of the tokens in bytes."""
    return np.cumsum([len(t) for t in tokens]).tolist()


def plain(both, text):
    """Groups as (A ids, B ids) by the contract, from the two libraries and sets of ends; none where a text has no tokens."""
    a, b = libs()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
    ids_b = b.encode(text) if text else []
    say_a, say_b = [both[0].tokens[i] for i in ids_a], [both[2][i] for i in ids_b]
    if not text or not (b"".join(say_a) == b"".join(say_b) == b" " + text.encode()):
        return []
    ends_a, ends_b = spelled(say_a), spelled(say_b)
    groups, i, j = [], 0, 0
    for end in sorted({*ends_a} & {*ends_b}):
        p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((ids_a[i:p], ids_b[j:q]))
        i, j = p, q
    return groups


def contract(both, docs):
    """{position: the query's columns} for a list of texts."""
    every = [plain(both, t or "") for t in docs]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in every]
    counts = Counter(pair for of in links for pair in of)
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = {}
    for k, (groups, of) in enumerate(zip(every, links)):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for (x, y), n in of.items() if counts[x, y] == top[x])
        out[k] = (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(of.values()), best, sum(n * counts[p] for p, n in of.items()), hashlib.sha256(line.encode()).hexdigest() if line else "")
    return out


def test_byte_level_ids_equal_the_library(both):
    coder, many = both[0].coder(), [*texts(11, 2000), " " * 4000, "a" * 20_000, "<|endoftext|> x"]
    assert all(coder.encode(t, disallowed_special=()) == libs()[0].encode(t, add_special_tokens=False).ids for t in many)


def test_another_file_is_an_error():
    with pytest.raises((ValueError, KeyError)):
        alignment.ByteLevel(public_tokenizers.path("word_bpe_49k.json"))


def test_groups_break_where_both_end():
    starts, ends = np.array([0, 2, 5, 0, 1, 5]), np.array([2, 5, 9, 1, 5, 9])
    order, group = alignment.coalesced(starts, ends)
    assert dict(zip(order.tolist(), group.tolist())) == {0: 0, 1: 0, 3: 0, 4: 0, 2: 1, 5: 1}


def test_equals_the_contract(spark, both, monkeypatch):
    """Odd texts in small blocks, repeated rows, nulls, null ids, U+2581, long runs whose tokens seldom end together, clashing names."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    docs = [*texts(12, 400), None, "", "▁", "a▁b", "same words here", "same words here", "=" * 5000, "-" * 3001 + " x", " " * 2500 + "y"]
    frame = spark.createDataFrame([(k if k % 7 else None, k, t, "x", 5) for k, t in enumerate(docs)], "doc_id long, k long, text string, groups_sha256 string, _at int").repartition(3)
    out = alignment.align(frame, *both[:2])
    assert out.columns == ["doc_id", "k", *alignment.ADDED]
    got = {r["k"]: tuple(r[c] for c in alignment.ADDED) for r in out.collect()}
    want = contract(both, docs)
    assert got == want and sum(w[3] > w[0] + w[1] for w in want.values()) > 3


def test_one_group_of_many_tokens(both):
    """A million links of one group are counted by their distinct ids."""
    group = np.zeros(2000, np.int64)
    side = np.arange(2000) < 1000
    key, times = alignment.expanded(group, side, np.where(side, 3, 4 + np.arange(2000) % 2), group)
    assert key.tolist() == [3 << 17 | 4, 3 << 17 | 5] and times.tolist() == [500_000, 500_000]


def test_empty_table(spark, both):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, *both[:2]).count() == 0


def test_query(spark, both):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = contract(both, [r["text"] for r in rows])
    got = {r["doc_id"]: tuple(r[c] for c in alignment.ADDED) for r in QUERIES["op12_alignment"](spark, SF).collect()}
    assert got == {r["doc_id"]: want[k] for k, r in enumerate(rows)}
