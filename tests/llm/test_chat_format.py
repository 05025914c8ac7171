"""Chat formatting: exact round trips against a plain version of the template."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from salespanel.llm import chat_format as C

KIND = "conv_id long, turn long, role string, text string, part string, turns int"


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    bits = ["</s>", "[INST]", " [/INST]", "[TURN]", "[\\INST]", "<\\\\s>", "<s>", "[", "<", "\\", "ok", "\n", " ", "[ROLE] x", "é😀", "$1", "[/SYS"]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
    out = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, None, "assistant", "no turn"), (2, 5, "user", None), (2, 5, "user", None),
           (3, 0, None, "no role"), (3, 1, "", "empty role"), (3, 2, "to[TURN]ol", "x"), (3, 3, "to[TURN]ol", "[/ROLE]"),
           (4, 0, "assistant", ""), (5, 0, "user", "long " * 50_000), (5, 1, "assistant", "</s>" * 20_000),
           (None, 0, "user", "lost"), (None, 0, "user", "lost"), (None, 1, "assistant", "found")]
    out += [(10 + k // 25, k % 25 * 400, r.choice(["user", "assistant", "assistant", "system", "tool"]), text()) for k in range(150)]
    r.shuffle(out)
    return [(*x, "clash", 1) for x in out]


@pytest.fixture(scope="module")
def convs(spark, rows):
    return spark.createDataFrame(rows, KIND)


def expected(rows):
    own = {}
    for k, (conv, turn, role, text, *_) in enumerate(rows):
        own.setdefault(conv if conv is not None else ("alone", k), []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in own.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out.append((conv if isinstance(conv, int) else None, len(turns), _sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), _sha(loss)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_round_trip(convs, rows, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(C, "ID_BYTES", 2 ** 40)
    got = C.digests(convs)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == expected(rows)


def test_no_text_holds_a_control_string(convs):
    for r in C.formatted(convs).collect():
        at = sorted((s.start, s.start + s.length) for s in r.loss_spans)
        assert all(b <= c for (_, b), (c, _) in zip(at, at[1:]))
        for a, b in at:
            assert not any(c in r.formatted[a:b] for c in ("[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[TURN]", "<s>", "</s>"))
            assert r.formatted[b:].startswith((" </s>", "[TURN]"))


def test_template(spark):
    made = spark.createDataFrame([(1, 2, "user", "c"), (1, 0, "system", "a"), (1, 1, "user", "b [INST]"), (1, 3, "assistant", "d"), (1, 4, "tool", "e")],
                                 "conv_id long, turn long, role string, text string")
    r = C.formatted(made).first()
    assert r.formatted == "[SYS] a [/SYS][INST] b [\\INST][TURN]c [/INST] d </s>[ROLE] tool[TURN]e [/ROLE]"
    (s,) = r.loss_spans
    assert r.formatted[s.start:s.start + s.length] == "d"
    assert [(t.role, t.text) for t in C.formatted(made).select(F.explode(C.turns_read(F.col("formatted"))).alias("t")).select("t.*").collect()] == [
        ("system", "a"), ("user", "b [INST]"), ("user", "c"), ("assistant", "d"), ("tool", "e")]


def test_empty_table(spark):
    assert C.digests(spark.createDataFrame([], KIND)).count() == 0
