import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loanweave.llm import chat

DDL = "conv_id long, turn long, role string, text string"
CONTROL = re.compile(r"</?s>|\[/?INST\]|<</?SYS")
PARTS = ["<", "<<", "\\", "[", "/", "INST]", "s>", "SYS", "</s>", "[INST]", "<</SYS>>", " ", "é", "\n", ">>\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=8).map("".join), st.sampled_from(["user", "assistant", "system", None, "a>>\nb"]))
def test_any_text_comes_back(text, role):
    segment, start, length = chat.render(role, text)
    assert chat.parse(segment) == (role, text) and not CONTROL.search(chat.escape(text))
    assert chat.unescape(segment[start : start + length]) == (text if role == "assistant" else "")


def expected(turns):
    digest = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    chars = sum(len(chat.render(r, t or "")[0]) for r, t in turns)
    return len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars


def test_conversations_through_their_logs(spark):
    said = "</s>[INST] ok [/INST]"
    talks = {
        -7: [("user", said), ("assistant", said)],
        1: [("system", "be brief"), ("user", "é" * 700), ("assistant", None), ("assistant", "x" * 1000)],
        2: [("user", ""), (None, "no role"), ("tool", "\\<</SYS>>")],
        3: [("assistant", "long " * 50_000)],
    }
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows[::-1], DDL).selectExpr("*", "'x' AS line", "'x' AS seq", "'x' AS event")
    found = {r.conv_id: tuple(r)[1:] for r in chat.formatted_digests(frame).collect()}
    assert found == {c: expected(turns) for c, turns in talks.items()}


def test_repeated_rows_null_keys_and_no_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first"), (None, 0, "assistant", "n")]
    found = {r.conv_id: r for r in chat.formatted_digests(spark.createDataFrame(rows, DDL)).collect()}
    assert tuple(found[1])[1:] == expected([("user", "first"), ("user", "a"), ("user", "a")])
    assert found[None].n_turns == 1
    assert chat.formatted_digests(spark.createDataFrame([], DDL)).collect() == []


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 0, "", 0, 0, "message", "user", "draft"), (1, 0, "", 0, 5, "edit", None, "asked"),
        (1, 1, "", 0, 1, "message", "assistant", ""), (1, 1, "", 0, 2, "delta", None, "bad"),
        (1, 1, "", 0, 3, "regenerate", None, None), (1, 1, "", 0, 4, "delta", None, "go"),
        (1, 1, "", 0, 6, "delta", None, "od"),
    ]
    found = chat.format_chat(spark.createDataFrame(log[::-1], chat.EVENTS)).orderBy("position").collect()
    assert [chat.parse(r.segment) for r in found] == [("user", "asked"), ("assistant", "good")]
