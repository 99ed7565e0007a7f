import hashlib
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calyxa.llm import chat_format as C

HARD = ["</s>[INST] ok [/INST]", "<|im_end|>", "<|im_start|>user<|im_sep|>", "\\<|im_end|>", "<\\|im_end|>", "<<|im_end|>", "\\", "\\\\", "", " a\nb ", "é🙂<s>", "<<SYS>><</SYS>>", "$1", "\\$1"]


def round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r.u == r.t and not any(c in r.e for c in C.CONTROLS), r


def test_escape(spark):
    round_trip(spark, HARD)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*C.CONTROLS, "\\", "<", "[", "|", "x", "\n", "s>"]), max_size=8).map("".join), min_size=1, max_size=20))
def test_escape_any(spark, texts):
    round_trip(spark, texts)


EVENTS = "conv_id long, seq long, op string, msg long, role string, text string"


def fold_by_hand(events):
    """One event after the other."""
    messages = {}
    for seq, op, msg, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        if op in ("edit", "regenerate"):
            messages = {k: v for k, v in messages.items() if k <= msg}
            old = messages.get(msg, ["", ""])
            messages[msg] = [old[0], text or "" if op == "edit" else ""]
        elif op == "start":
            messages.setdefault(msg, ["", ""])[0] = role or ""
        else:
            messages.setdefault(msg, ["", ""])[1] += text or ""
    return [(k, *v) for k, v in sorted(messages.items())]


CASES = {
    1: [(1, "start", 1, "user", None), (2, "delta", 1, None, "hi "), (3, "delta", 1, None, "there"), (4, "start", 2, "assistant", None), (5, "delta", 2, None, "yo")],
    2: [(1, "start", 1, "user", None), (2, "delta", 1, None, "q"), (3, "start", 2, "assistant", None), (4, "delta", 2, None, "bad"), (5, "regenerate", 2, None, None), (6, "delta", 2, None, "good"), (7, "delta", 2, None, "!")],
    3: [(1, "start", 1, "user", None), (2, "delta", 1, None, "q"), (3, "start", 2, "assistant", None), (4, "delta", 2, None, "a"), (5, "edit", 1, None, "Q"), (6, "start", 2, "assistant", None), (7, "delta", 2, None, "A")],
    4: [(1, "start", 1, "user", None), (2, "delta", 1, None, "q"), (3, "start", 2, "assistant", None), (4, "delta", 2, None, "a"), (5, "edit", 1, None, "only")],
    None: [(1, "delta", 1, None, "no start")],
}


def test_fold(spark):
    rows = [(c, *e) for c, events in CASES.items() for e in events]
    got = C.fold(spark.createDataFrame(rows, EVENTS)).collect()
    for c, events in CASES.items():
        assert sorted((r.msg, r.role, r.text) for r in got if r.conv_id == c) == fold_by_hand(events)
    assert C.fold(spark.createDataFrame([], EVENTS)).count() == 0


def test_render_and_parse(spark):
    rows = [(c, i, ("user", "assistant", "we<|im_sep|>ird\n")[i % 3], HARD[(c + i) % len(HARD)]) for c in range(6) for i in range(5)]
    rendered = C.render(spark.createDataFrame(rows, "conv_id long, msg long, role string, text string"))
    turns = C.under_loss(C.parse(rendered), rendered).withColumn("text", C.unescape(F.col("raw"))).orderBy("conv_id", "place").collect()
    assert [(t.conv_id, t.place, t.role, t.text, t.lost) for t in turns] == [(*x, x[2] == "assistant") for x in rows]
    for r in rendered.collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        loss = [r.formatted[s.start : s.start + s.length] for s in r["mask"]]
        plain = spark.createDataFrame([(x,) for x in loss], "x string").select(C.unescape(F.col("x"))).collect()
        assert [p[0] for p in plain] == [x[3] for x in mine if x[2] == "assistant"]


def test_ranges_of_messages_give_the_same(spark, monkeypatch):
    """Resets and offsets reach over ranges of two messages as within one."""
    monkeypatch.setattr(C, "CHUNK", 2)
    test_fold(spark)
    test_render_and_parse(spark)
    rng = random.Random(4)
    cases = {}
    for c in range(12):
        live, events = 0, []
        for seq in range(40):
            op = rng.choice(["new", "new", "delta", "delta", "edit", "regenerate"])
            if op == "new" or not live:
                live += 1
                events.append((seq, "start", live, rng.choice(["user", "assistant"]), None))
            else:
                msg = live if op == "delta" else rng.randrange(max(1, live - 3), live + 1)
                events.append((seq, op, msg, None, f"{c}.{seq} "))
                live = live if op == "delta" else msg
        cases[c] = events
    got = C.fold(spark.createDataFrame([(c, *e) for c, events in cases.items() for e in events], EVENTS)).collect()
    for c, events in cases.items():
        assert sorted((r.msg, r.role, r.text) for r in got if r.conv_id == c) == fold_by_hand(events)


def test_time_grows_with_the_length_of_a_conversation(spark, tmp_path):
    took = {}
    for n in (200, 4000, 16_000):
        rows = spark.range(n).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat(concat('é <s> ', id, ' '), 20) text")
        rows.write.parquet(str(tmp_path / f"{n}" / "conversations.parquet"))
        start = time.perf_counter()
        got = {r.conv_id: r for r in C.op2_chat_formatting(spark, str(tmp_path / f"{n}")).collect()}
        took[n] = time.perf_counter() - start
        said = [f"é <s> {i} " * 20 for i in range(n)]
        assert got[7].n_turns == n and got[7].loss_sha256 == hashlib.sha256("".join(said[1::2]).encode()).hexdigest()
    assert took[16_000] < 4 * took[4000] + 1, took


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\\"), (1, 1, "assistant", "<|im_end|>\\"), (2, 5, None, None), (2, None, "user", "é"), (None, 0, "assistant", "x" * 100_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit("clash")).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in C.op2_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].loss_chars == 22 and got[1].loss_sha256 == sha("<|im_end|>\\" * 2)
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\n<|im_end|>\\\nassistant\n<|im_end|>\\\n")
    assert got[2].turns_sha256 == sha("user\né\n\n\n") and got[2].loss_chars == 0 and got[None].loss_chars == 100_000
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == sha("</s>[INST] ok [/INST]")


@pytest.mark.parametrize("n", [0])
def test_query_on_an_empty_table(spark, tmp_path, n):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.conv_id for r in C.op2_chat_formatting(spark, str(tmp_path)).collect()] == [-1]
