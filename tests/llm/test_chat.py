import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headway.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, valid string"


def plain_escape(s, t=C.Template()):
    s = s.replace("\\", "\\\\")
    return s.replace("<|", "<\\|")


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|> \\ <\\|turn|>"), (1, 2, "assistant", "éa<|text|>\n"),
    (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "assistant", "again"),
    (3, 0, "assistant", "first"), (4, 0, "user", None), (4, 1, "assistant", ""), (5, 0, None, "no role"),
    (6, 1, "user", "same turn b"), (6, 1, "user", "same turn a"), (None, 0, "user", "no id"), (None, 1, "assistant", "<|"),
    (7, None, "user", "null turn first"), (7, 0, "assistant", "then"), (8, 0, "user", "x"), (8, 0, "user", "x"), (9, 0, "tool|>", "odd <"),
]


@pytest.fixture(scope="module")
def out(spark):
    df = C.format_chat(spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA).repartition(4))
    df = df.withColumn("back", C.read_back(F.col("formatted"))).withColumn("under", C.loss_text(F.col("segments")))
    return {r["conv_id"]: r for r in df.collect()}


def turns(conv):
    own = [(t is not None, t or 0, r or "", x or "") for c, t, r, x in ROWS if c == conv]
    return [(r, x) for _, _, r, x in sorted(own)]


def test_round_trip_and_loss_text(out):
    assert set(out) == {r[0] for r in ROWS}
    for conv, r in out.items():
        want = turns(conv)
        assert [tuple(b) for b in r["back"]] == want and r["n_turns"] == len(want)
        assert r["under"] == "".join(x for role, x in want if role == "assistant")
        text = "".join(f"<|turn|>{plain_escape(role)}<|text|>{plain_escape(x)}<|end|>" for role, x in want)
        assert r["formatted"] == text == "".join(s["text"] for s in r["segments"])


def test_machine(out):
    state = {c: (r["valid"], r["complete"], r["bad_turn"]) for c, r in out.items()}
    assert state[1] == (True, True, None) and state[2] == (False, True, 2) and state[3] == (False, True, 0)
    assert state[4] == (True, True, None) and state[5] == (False, False, 0) and state[6] == (False, False, 1)
    assert state[8] == (False, False, 1) and state[9] == (False, False, 0)


def test_other_templates(spark):
    t = C.Template("[~B", "[~M", "[~E", ("user",), {"START": ("user",), "user": ("user",)}, ("user",))
    rows = [(1, 0, "user", "a [~E [~ \\[~", ""), (1, 1, "user", "[", "")]
    r = C.format_chat(spark.createDataFrame(rows, SCHEMA), t).withColumn("back", C.read_back(F.col("formatted"), t)).withColumn("under", C.loss_text(F.col("segments"))).first()
    assert [b["text"] for b in r["back"]] == ["a [~E [~ \\[~", "["] and r["valid"] and r["under"] == "a [~E [~ \\[~["


def test_bad_templates_are_refused():
    for controls in (("<|a", "<|a", "<|b"), ("<|a<", "<|b", "<|c"), ("<\\a", "<|b", "<|c"), ("ab", "<|b", "<|c")):
        with pytest.raises(ValueError):
            C.Template(*controls)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("<|\\turnexd>", max_size=20), st.text("<|\\turnexd>\n", max_size=20)), max_size=4))
def test_escape_is_reversible(turns):
    """The rules in Python: what split and unescape give back."""
    import re

    text = "".join(f"<|turn|>{plain_escape(r)}<|text|>{plain_escape(x)}<|end|>" for r, x in turns)
    un = lambda s: re.sub(r"(?s)\\(.)", r"\1", s)
    back = [(un(p[len("<|turn|>") :].split("<|text|>")[0]), un(p.split("<|text|>")[-1])) for p in text.split("<|end|>")[:-1]]
    assert back == turns


def test_long_conversation_and_empty_table(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " * 20, "") for i in range(3000)]
    r = C.format_chat(spark.createDataFrame(rows, SCHEMA)).first()
    assert r["n_turns"] == 3000 and r["valid"] and r["complete"]
    assert C.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_a_loop(spark, tmp_path):
    spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in C.op1_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in ROWS} | {-1}
    for conv, r in got.items():
        want = turns(conv) if conv != -1 else [(x[2], x[3]) for x in C.PLANTED]
        under = "".join(x for role, x in want if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(under), hashlib.sha256(under.encode()).hexdigest())
