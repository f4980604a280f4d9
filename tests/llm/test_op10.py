import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.chat import CONTROLS, PART, escape, format_messages, format_turn, read_turn, unescape
from larkspur.llm.queries import op10

from .helpers import CONVERSATIONS, SF, rows_of, sql_rows, with_clashes, write

TEXTS = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "|", ">", "[", "]", "/", "s", "a", "ß", "\n", "😀", "INST", "<|turn|>", "<|says|>", "<|end|>", "<|image:0|>", "<\\|end|>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS, TEXTS)
def test_round_trip(role, text):
    formatted, attached = format_turn(role, [{"kind": "text", "value": text, "units": None}])
    got_role, parts = read_turn(formatted)
    assert got_role == role and "".join(p["value"] for p in parts) == text and not attached
    body = escape(text)
    assert unescape(body) == text and not any(c in body for c in CONTROLS)


def test_parts_become_placeholders_in_order(spark):
    parts = [("text", "see ", None), ("image", "s3://a.png", 784 * 3 + 1), ("text", "<|image:0|>", None), ("audio", "b.wav", 1000), ("document", None, 4), ("text", None, None), ("image", "c.png", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (2, None, None, [])], f"conv_id long, turn long, role string, parts array<{PART}>")
    got = {(r["conv_id"], r["turn"]): r for r in format_messages(df, parts="parts").collect()}
    first = got[1, 0]
    assert first["formatted"] == "<|turn|>user<|says|>see <|image:0|><\\|image:0|><|audio:1|><|document:2|><|image:3|><|end|>"
    assert [(a["slot"], a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [(0, "image", "s3://a.png", 4), (1, "audio", "b.wav", 25), (2, "document", None, 2048), (3, "image", "c.png", 1)]
    assert first["expanded_tokens"] == 4 + 25 + 2048 + 1 and not first["loss"] and got[1, 1]["loss"]
    assert got[2, None]["formatted"] == "<|turn|><|says|><|end|>"
    role, back = read_turn(first["formatted"])
    assert role == "user" and [p.get("slot", p.get("value")) for p in back] == ["see ", 0, "<|image:0|>", 1, 2, 3]


def test_unknown_kind_is_an_error():
    with pytest.raises(AttributeError):
        format_turn("user", [{"kind": "video", "value": "x", "units": 1}])


def brute(rows):
    rows = [*rows, (-7, 0, "user", op10.PLANTED), (-7, 1, "assistant", op10.PLANTED)]
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        told = "".join(f"{role}\n{text}\n" for _, _, role, text in mine)
        loss = "".join(text for _, _, role, text in mine if role == "assistant")
        size = sum(len(format_turn(role, [{"kind": "text", "value": text, "units": None}])[0]) for _, _, role, text in mine)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(mine), sha(told), len(loss), sha(loss), size))
    return sorted(out, key=repr)


COLS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def test_agrees_with_sql(spark):
    assert rows_of(op10.run(spark, SF)) == sql_rows(SF, op10.SQL, "conversations")


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, tmp_path, clash):
    rows = [(1, 0, "user", "a <|x|> \\ b"), (1, 1, "assistant", None), (1, 1, "assistant", "same turn"), (1, None, "system", "[INST]"), (None, 0, "assistant", "no id"), (None, 1, None, "x"), (2, 0, None, None), (2, 0, None, None), (3, 0, "assistant", "é😀" * 60_000), (3, -1, "Assistant", "case"), (4, 5, "assistant", "\\\\|<|<s></s>"), (5, 0, "", "")]
    folder = write(tmp_path, conversations=with_clashes(CONVERSATIONS, rows) if clash else (CONVERSATIONS, rows))
    assert rows_of(op10.run(spark, folder), COLS) == brute(rows)
    assert rows_of(op10.run(spark, folder)) == sql_rows(folder, op10.SQL, "conversations")


def test_empty(spark, tmp_path):
    assert rows_of(op10.run(spark, write(tmp_path, conversations=(CONVERSATIONS, []))), COLS) == brute([])
