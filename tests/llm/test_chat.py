import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kilnframe.llm import chat, storage

SCHEMA = "conv_id long, turn long, role string, text string, tokens string, block int, start string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "s") for r in rows], SCHEMA)


def want(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(df).collect()}


@given(st.lists(st.tuples(st.text(), st.text(alphabet=st.sampled_from("\\#</turn>\n:a A é")))))
def test_turns_read_back(turns):
    window = "".join(chat.turn_text(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.read_turns(window)] == turns


@given(st.text(alphabet=st.sampled_from("\\#</turn>\n: x")))
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "\n</turn>" not in chat.escape(text).replace("\\</turn>", "")


@pytest.mark.parametrize(("budget", "history", "block", "bucket"), [(40, 20, 1, 2), (60, 0, 2, 3), (200, 60, 32, 1024), (8, 4, 1, 1)])
def test_round_trip_at_any_budget(spark, monkeypatch, budget, history, block, bucket):
    monkeypatch.setattr(chat, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(chat, "TURN_BUCKET", bucket)
    rng = random.Random(budget)
    rows = []
    for conv in range(12):
        for turn in range(rng.randrange(1, 25)):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, " ".join(rng.choices(["alpha", "\\### Assistant:", "</turn>", "\n", "ok"], k=rng.randrange(12)))))
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (None, 0, "user", "null conv"), (51, 2, "assistant", "b"), (51, 2, "assistant", "a"), (51, 2, "assistant", "a"), (51, None, "user", "first"), (52, 0, "assistant", "word " * 5000)]
    windows = chat.format_conversations(frame(spark, rows), budget=budget, history=history)
    assert got(windows) == want(rows)
    for w in windows.collect():
        turns = chat.read_turns(w["text"])
        own = turns[w["n_context"] :]
        assert own and (w["tokens"] <= budget or len(own) == 1)
        if w["n_context"] and w["conv_id"] is not None and w["conv_id"] < 12 and w["conv_id"] % 2:
            assert turns[0][0] == "system"
        assert [(s["begin"], s["end"]) for s in w["loss"]] == [(a, e) for r, _, a, e in own if r == "assistant"]


def test_repeats_leave_room_for_the_budget(spark):
    """A system turn of 1,500 tokens beside turns of 1,000 does not overrun 2,048; beside short ones it stays."""
    rows = [(1, 0, "system", "word " * 1500), (1, 1, "user", "word " * 1000), (1, 2, "assistant", "word " * 300), (1, 3, "user", "hi"), (1, 4, "assistant", "word " * 1900), (1, 5, "user", "word " * 2500)]
    windows = chat.format_conversations(frame(spark, rows), budget=2048, history=512).orderBy("position").collect()
    assert [w["position"] for w in windows] == sorted(w["position"] for w in windows)
    for w in windows:
        turns = chat.read_turns(w["text"])
        assert w["tokens"] <= 2048 or (len(turns) == 1 and w["n_context"] == 0)
    assert got(chat.format_conversations(frame(spark, rows), budget=2048, history=512)) == want(rows)


def test_system_turn_stands_anywhere(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_WINDOWS", 1)
    monkeypatch.setattr(chat, "TURN_BUCKET", 2)
    rows = [(1, None, "user", "before"), (1, 1, "user", "also before")] + [(1, 2, "system", "rules")] + [(1, 3 + i, ("user", "assistant")[i % 2], "some words here") for i in range(20)] + [(1, 99, "system", "other rules")]
    windows = chat.format_conversations(frame(spark, rows), budget=60, history=0).orderBy("position").collect()
    assert got(chat.format_conversations(frame(spark, rows), budget=60, history=0)) == want(rows)
    after = [w for w in windows if w["position"] > 2]
    assert after and all(chat.read_turns(w["text"])[0][:2] == ("system", "rules") for w in after)


def test_empty(spark):
    assert chat.digests(chat.format_conversations(frame(spark, []))).collect() == []


def test_query(spark, sf):
    rows = [tuple(r) for r in storage.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    found = {r["conv_id"]: r for r in chat.op9_chat_format(spark, sf).collect()}
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in found.items()} == want(rows)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in found.values())
