import hashlib
import json

from hypothesis import given
from hypothesis import strategies as st

from lumora.llm import chat


@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "a", "\n", "<", "|", "[", "é"])).map("".join))
def test_escape_is_reversible(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROL)


def test_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a\\n"), (2, 0, "user", None), (2, None, None, "x"), (3, 0, "assistant", ""), (3, 0, "assistant", "<|im_end|>\n"), (3, 0, "assistant", ""), (None, 5, "tool\n", "t" * 100_000)]
    got = {r.conv_id: r for r in chat.format_rows(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, record int")).collect()}
    want = {1: [("user", "a\\n"), ("assistant", "b")], 2: [("user", ""), ("", "x")], 3: [("assistant", "<|im_end|>\n"), ("assistant", ""), ("assistant", "")], None: [("tool\n", "t" * 100_000)]}
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.segment(*t)[0]) for t in turns)
    assert chat.format_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 4}, "messages"),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations"),
        ({"instruction": "q", "input": "", "output": "a"}, "instruction_input"),
        ({"prompt": "q", "completion": "a", "meta": {"k": [1]}}, "prompt_completion"),
        ({"question": "q", "answer": "a"}, "question_answer"),
        ({"other": 1}, "unknown"),
    ]
    df = spark.createDataFrame([(i, None, json.dumps(r)) for i, (r, _) in enumerate(records)] + [(99, None, None)], "conv_id long, turn long, record string")
    out = chat.format_records(df).collect()
    want = "".join(chat.segment(r, t)[0] for r, t in (("user", "q"), ("assistant", "a")))
    for i, (_, layout) in enumerate(records):
        own = sorted((r for r in out if r.conv_id == i), key=lambda r: r.part)
        assert {r.layout for r in own} == {layout}
        assert "".join(r.formatted for r in own) == (want if layout != "unknown" else "")
    assert chat.fingerprint(chat.paths({"b": [{"c": 1}], "a": 2})) == chat.fingerprint(chat.paths({"a": None, "b": [{"c": "x"}, {"c": 2}]}))


def test_roles_of_plain_rows_stay(spark):
    import hashlib

    said = [("human", "a"), ("gpt", "b"), ("assistant", "c"), ("bot", "d")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(said)]
    got = chat.format_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert (got.loss_chars, got.loss_sha256) == (1, hashlib.sha256(b"c").hexdigest())
    mapping = next(m for m in chat.MAPPINGS if m["name"] == "conversations")
    assert chat.turns_of({"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}, mapping) == [("user", "x"), ("assistant", "y")]
