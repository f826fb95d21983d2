import zlib

import numpy as np
import pytest

from headway.llm import toxicity as X

BAD, GOOD = ["grobnak", "vilzort", "murgle"], ["hello", "river", "garden", "table", "window", "summer", "letter", "music", "paper", "stone"]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        words = [GOOD[j] for j in rng.integers(0, len(GOOD), rng.integers(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            for k in range(3):
                words.insert(int(rng.integers(0, len(words))), BAD[rng.integers(0, 3)])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark, corpus):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in corpus], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return X.fit(docs, labels)


def test_held_out_accuracy(spark, corpus, model):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] >= 0.7 for r in X.score(docs, model).collect()}
    held = [(got[i], bool(y)) for i, _, y in corpus if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.98


def test_disguised_words_are_restored(spark, model):
    decode = X.Decoder(model.chars)
    for word, want in [("gr0bn4k", "grobnak"), ("v.i.l.z.o.r.t", "vilzort"), ("muuurgle", "murgle"), ("v1lz0rt", "vilzort"), ("letter", "letter")]:
        assert decode(word) == want
    clean = "river garden table window summer "
    texts = [clean * 3, clean + "gr0bn4k v1lz0rt mu-r-g-le " + clean, clean + "g r o b n a k  v i l z o r t  m u r g l e " + clean, "", None, "  ", "a" * 200_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in X.score(rows, model).collect()}
    assert got[1] > 0.7 and got[2] > 0.7
    assert all(got[i] < 0.3 for i in (0, 3, 4, 5, 6)) and got[3] == got[4]


def scores(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in X.score(rows, model).collect()}
    return [got[i] for i in range(len(texts))]


def test_disguises_of_any_length(spark, model):
    """Long runs of spaced letters, and letters stretched beyond any bound."""
    clean = "river garden table window summer "
    text = clean + "garden grobnak table letter vilzort music murgle paper " + clean
    spaced = " ".join(text.replace(" ", ""))
    stretched = clean + f"gro{'b' * 90}nak vi{'l' * 40}zort m{'u' * 500}rgle " + clean
    got = scores(spark, model, [spaced, stretched, " ".join(clean.replace(" ", "") * 9), clean + "hello" + "o" * 300, "1 2 3 " * 50_000])
    assert min(got[:2]) > 0.7 and max(got[2:]) < 0.3
    assert X.Decoder(model.chars)("g" + "r1v3r" * 5000 + "n") == "g" + "river" * 5000 + "n"
    _, runs = X.disguised(*spans("a s s"))
    assert runs == [(0, "ass", 3)]


def apart(word, n=1, by=" "):
    return by.join(word[k : k + n] for k in range(0, len(word), n))


@pytest.mark.parametrize(
    "hide",
    [
        apart,
        lambda w: apart(w, 1, "  "),
        lambda w: apart(w, 1, "\u00a0"),
        lambda w: apart(w, 1, " \n "),
        lambda w: apart(w, 2),
        lambda w: apart(w, 1, "\u200b"),
        lambda w: apart(w, 3, "\u200d"),
        lambda w: apart(w, 4, "\u00ad"),
        lambda w: "".join(c * 2 for c in w),
        lambda w: w.translate(str.maketrans("aoek", "аоек")),
        lambda w: apart(w.translate(str.maketrans("aoek", "аоек")), 1, "   "),
        lambda w: apart(w, 1, "."),
    ],
)
def test_a_disguise_scores_as_the_plain_word(spark, model, hide):
    clean = "river garden table window summer letter music paper "
    texts = []
    for word in BAD:
        texts += [clean * 2 + word + " " + clean * 2, clean * 2 + hide(word) + " " + clean * 2, clean * 4]
    texts += [clean * 2 + hide("garden") + " " + clean * 2]
    got = scores(spark, model, texts)
    for k in range(len(BAD)):
        plain, hidden, without = got[3 * k : 3 * k + 3]
        assert abs(plain - hidden) < 0.05 and plain - without > 0.1
    assert abs(got[-1] - got[2]) < 0.05


def test_rows_repeated_and_without_ids(spark, model):
    texts = [(None, "grobnak vilzort murgle river"), (1, "river"), (1, "river"), (None, None), (None, "grobnak vilzort murgle river"), (2, "")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in texts], "doc_id long, text string, score double")
    got = [(r["doc_id"], r["score"]) for r in X.score(docs, model).collect()]
    assert sorted(str(i) for i, _ in got) == sorted(str(i) for i, _ in texts)
    assert sum(s > 0.7 for _, s in got) == 2 and len({s for i, s in got if i == 1}) == 1
    assert X.without_toxic(docs, model).count() == 4


def test_bytes_taken_out(spark):
    text = "a\u200bb c\u00a0d \u3000 é\u00ad日本\ufeff"
    raw = np.frombuffer((text + text).encode(), np.uint8)
    size = len(text.encode())
    data, offsets = X.cleaned(raw, np.array([0, size, 2 * size]))
    assert data.tobytes().decode() == "ab c d   é日本" * 2 and offsets.tolist() == [0, len(data) // 2, len(data)]


def spans(text):
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, first = X.word_spans(data, np.array([0, len(data)]))
    return data, starts, ends, first


def test_all_alphabets_and_leet(spark, model):
    """Letters outside a-z stand for themselves; words of little but leet are decoded; a final $$$ has both readings."""
    decode = X.Decoder(model.chars)
    assert [decode(w) for w in ("gr0ßn4k", "v.i.é.z.o.r.t", "mééérgle")] == ["großnak", "viézort", "mérgle"]
    words, runs = X.disguised(*spans("ok gr0ßn4k @$$h0l3 5h!7 $#!7 a$$$ gr0b$$$ g r ß b é éééé mééérg 455 $45.00 12:30"))
    assert [w for _, w in words] == ["gr0ßn4k", "@$$h0l3", "5h!7", "$#!7", "a$$$", "gr0b$$$", "gr0b", "ééé", "mééérg"]
    assert runs == [(0, "grßbé", 5)]


def test_empty_tables_and_one_class(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.score(docs, X.fit(docs, labels)).count() == 0
    docs = spark.createDataFrame([(i, "some text") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    assert all(0 <= r["score"] < 0.3 for r in X.score(docs, X.fit(docs, labels)).collect())


def test_viterbi_finds_the_best_path(model):
    """Against all paths of a small lattice."""
    import itertools

    decode = X.Decoder(model.chars)
    for word in ["g1t3r", "5t0n3", "r1v3r", "t4bl3"]:
        best = max(
            (sum(p for _, p in path) + sum(model.chars[a, b, c] for a, b, c in zip(k, k[1:], k[2:])), "".join(t for t, _ in path))
            for path in itertools.product(*decode.lattice(word))
            for k in [[0, 0, *[ord(c) - 96 for t, _ in path for c in t], 0]]
        )
        assert decode(word) == best[1]
