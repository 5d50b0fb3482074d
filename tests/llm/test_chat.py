from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from clausemill.llm.chat import DEFAULT, Template, format_chats, read_loss, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, turns string, Segments int"
HARD = ["</s>[INST] ok [/INST]", "[~INST]", "<~~/s>", "[[INST]", "[INST", "~", "<", "[ROLE]x[:]y[/ROLE]", "", None, "a\nb", "é😀<s>", "<s", "[~"]


def told(spark, rows, template=DEFAULT):
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA)
    out = format_chats(frame, template)
    out = out.withColumn("back", read_turns(F.col("formatted"), template)).withColumn("loss", read_loss(F.col("segments"), template))
    return {r.conv_id: r for r in out.collect()}


def test_every_text_is_read_back(spark):
    rows, want = [], {}
    for i, a in enumerate(HARD):
        for j, b in enumerate(HARD):
            c = i * 100 + j
            turns = [("system", a), ("user", b), ("assistant", a), ("user", a), ("assistant", b), ("tool" if j % 2 else b, b)]
            rows += [(c, n, r, t) for n, (r, t) in enumerate(turns)]
            want[c] = [(r or "", t or "") for r, t in turns]
    got = told(spark, rows)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].back] == turns
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")
        assert got[c].formatted == "".join(s.text for s in got[c].segments)
        assert not got[c].valid and got[c].first_bad_turn == 5


@pytest.mark.parametrize(
    ("roles", "bad"),
    [("ua", None), ("sua", None), ("uau", None), ("a", 0), ("uu", 1), ("ss", 1), ("sa", 1), ("uas", 2), ("u?", 1), ("?", 0), ("n", 0), ("unu", 1), ("uaun", 3)],
)
def test_turn_order(spark, roles, bad):
    names = {"u": "user", "a": "assistant", "s": "system", "?": "tool", "n": None}
    (got,) = told(spark, [(1, i, names[r], "x") for i, r in enumerate(roles)]).values()
    assert (got.first_bad_turn, got.valid) == (bad, bad is None)


def test_long_repeated_and_missing(spark):
    long = "[INST]<s> " * 100_000
    rows = [(1, 1, "assistant", long), (1, 0, "user", long), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, None, None, None), (2, None, "user", "z")]
    got = told(spark, rows)
    assert [tuple(t) for t in got[1].back] == [("user", long), ("assistant", long)]
    assert hashlib.sha256(got[1].loss.encode()).hexdigest() == hashlib.sha256(long.encode()).hexdigest()
    assert [t.text for t in got[2].back] == ["z", "a", "a"] and got[2].n_turns == 3
    assert [tuple(t) for t in got[None].back] == [("", "")]


def test_many_turns_in_one_conversation(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(5000)]
    (got,) = told(spark, rows).values()
    assert got.valid and got.n_turns == 5000 and got.back[4999].text == "turn 4999"


def test_template_that_cannot_be_read_back_is_refused():
    with pytest.raises(ValueError):
        Template(roles={"user": ("User: ", "\n", False)})
    with pytest.raises(ValueError):
        Template(roles={"user": ("[U]", "[U]", False)})


def test_empty_table(spark):
    assert told(spark, []) == {}
